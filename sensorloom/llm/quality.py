"""Quality classifier: nearest-neighbour voting on latent-semantic vectors.

Every text becomes a hashed vector of word counts, token shapes (letter case,
digits, marks) and repeats of the token before.  Labelled vectors of a bounded
sample give term weights and, by a singular value decomposition, a space of a few
dimensions.  The labelled vectors in that space are broadcast (at most
``max_train`` of them, whatever the length of their texts); every document is compared
with all of them in blocks, and its nearest neighbours vote with their similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import BYTE_VALUE, IS_WORD, LOWER, STEP, U64, blocks, mix, raw

#: Hashed dimensions of words and of shapes, and the one of repeats.
N_WORDS, N_SHAPES = 512, 511
DIM = N_WORDS + N_SHAPES + 1


def _classes() -> np.ndarray:
    c = np.arange(256, dtype=np.uint8)  # marks stand for themselves
    c[48:58], c[65:91], c[97:123], c[128:] = 1, 2, 3, 3
    return c


CLASS = _classes()
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def _run_hash(value: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Hash of the bytes of each owner (owners ascending, none empty)."""
    size = np.bincount(owner, minlength=n)
    begin = np.cumsum(size) - size
    power = np.cumprod(np.full(int(size.max()), STEP | U64(1), U64))
    return mix(np.add.reduceat(BYTE_VALUE[value] * power[np.arange(len(value)) - begin[owner]], begin) + size.astype(U64))


def features(texts: pa.Array) -> np.ndarray:
    """Counts (float32, a row each of DIM) of the texts of one block."""
    data, off = raw(texts)
    n = len(texts)
    out = np.zeros((n, DIM), np.float32)
    ink = ~SPACE[data]
    if not ink.any():
        return out
    begins = ink.copy()
    begins[1:] &= ~ink[:-1]
    inner = off[1:-1][off[1:-1] < len(data)]
    begins[inner] = ink[inner]
    token = np.cumsum(begins) - 1
    count = int(token[-1]) + 1
    doc = np.searchsorted(off, np.flatnonzero(begins), "right") - 1
    letters = ink & IS_WORD[data]
    shape = CLASS[data]
    turn = ink.copy()  # where a run of one class begins
    turn[1:] &= (shape[1:] != shape[:-1]) | begins[1:]
    shapes = _run_hash(shape[turn], token[turn], count)
    np.add.at(out, (doc, N_WORDS + (shapes % U64(N_SHAPES)).astype(np.int64)), 1)
    whole = _run_hash(LOWER[data[ink]], token[ink], count)
    same = np.flatnonzero((whole[1:] == whole[:-1]) & (doc[1:] == doc[:-1])) + 1
    np.add.at(out, (doc[same], DIM - 1), 1)
    if letters.any():
        named, owner = np.unique(token[letters], return_inverse=True)
        words = _run_hash(LOWER[data[letters]], owner, len(named))
        flat = doc[named] * DIM + (words % U64(N_WORDS)).astype(np.int64)
        out += np.bincount(flat, minlength=n * DIM).reshape(n, DIM).astype(np.float32)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def weigh(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Damped, weighted counts; words and shapes count alike."""
    x = np.log1p(x) * idf
    return np.concatenate([_unit(x[:, :N_WORDS]) * np.float32(0.5), _unit(x[:, N_WORDS:])], axis=1).astype(np.float32)


@dataclass
class Model:
    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float
    neighbours: int

    def project(self, x: np.ndarray) -> np.ndarray:
        return _unit(weigh(x, self.idf) @ self.basis)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Share of label 1 among the nearest neighbours, weighted by similarity."""
        if not len(self.labels):
            return np.ones(len(x))
        blank = ~x.any(axis=1)
        sim = self.project(x) @ self.vectors.T
        k = min(self.neighbours, sim.shape[1])
        near = np.argpartition(-sim, k - 1, axis=1)[:, :k]
        w = np.maximum(np.take_along_axis(sim, near, axis=1), 0).astype(np.float64) ** 4 + 1e-9
        s = (w * self.labels[near]).sum(axis=1) / w.sum(axis=1)
        return np.where(blank, self.prior, s)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, texts in blocks(batch.column(2), 1 << 20):
            x = features(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), batch.column(1).slice(at, len(texts)),
                                              pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "label", "x"])


def fit(docs: DataFrame, labels: DataFrame, *, max_train: int = 4000, dims: int = 64, neighbours: int = 15, id_col: str = "doc_id",
        text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit on about ``max_train`` labelled rows (a bounded sample, half of it for each
    label where there are enough, chosen by a hash of the id, so the same rows each time).

    ``labels`` holds ids and 0/1; null labels are ignored, an id with both counts as 0.
    Only the rows given are learned from: pass no held-out labels.  Without labels the model rejects
    nothing (score 1)."""
    lab = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")) \
        .agg(F.min(F.col(label_col).cast("int")).alias("label"))
    n = dict(lab.groupBy("label").count().collect())
    total = sum(n.values())
    share = {y: min(1.0, max_train / 2 / n[y]) for y in n}
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    pick = lab.where(F.expr("false") if not n else F.coalesce(*[F.when((F.col("label") == y) & (unit < share[y]), True) for y in n], F.lit(False)))
    # about max_train ids: a bounded side
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(pick), "doc_id") \
        .select("doc_id", "label", "text").mapInArrow(_counts, "doc_id long, label int, x binary").collect()
    rows.sort(key=lambda r: (r.doc_id, bytes(r.x)))
    prior = n.get(1, 0) / total if total else 1.0
    x = np.array([np.frombuffer(r.x, np.float32) for r in rows], np.float32).reshape(-1, DIM)
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 1
    w = weigh(x, idf)
    _, vec = np.linalg.eigh((w.T @ w).astype(np.float64))
    basis = np.ascontiguousarray(vec[:, ::-1][:, :dims], np.float32)
    return Model(idf, basis, _unit(w @ basis), np.array([r.label for r in rows], np.float64), prior, neighbours)


def score_udf(spark, model: Model):
    """Column function: text -> score; the model is broadcast once."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = np.zeros(len(texts))
            for at, part in blocks(texts, 1 << 20):
                for i in range(0, len(part), 512):
                    p = part.slice(i, 512)
                    out[at + i:at + i + len(p)] = shared.value.score(features(p))
            yield pa.array(np.clip(out, 0, 1))
    return F.arrow_udf(run, "double")


def score_documents(docs: DataFrame, model: Model, *, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """``row`` (the columns of ``docs`` as a struct, so no name can clash), ``score``
    and ``predicted`` (1 if the score is ``threshold`` or more).  Null and empty texts get the share of
    label 1 among the labels; repeated rows get the same score; an empty table gives no rows."""
    scored = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), score_udf(docs.sparkSession, model)(F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def training_part(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Labels that may be learned from: crc32 of the id as text, mod 4, is not 2."""
    return labels.where(F.crc32(F.col(id_col).cast("string")) % 4 != 2)


def keep_good(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """Documents that the classifier, fitted on the training part of ``labels``, accepts."""
    out = score_documents(docs, fit(docs, training_part(labels), **params))
    return out.where("predicted = 1").select("row.*")
