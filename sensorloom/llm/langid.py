"""Language identification: known words first, then shorter and shorter n-grams.

A text's words vote with their log frequency per language; a word that no
language knows is scored by its longest known character n-grams, from
``max_n`` down to 1.  The model is counted on a bounded sample of labelled documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import blocks

#: Signs for numbers (fractions, Roman numerals, raised digits) count as word characters, but are no letters.
NUMBER_SIGNS = "".join(c for c in map(chr, range(128, 0x110000)) if c.isnumeric() and not c.isalpha() and not c.isdecimal())
LETTERS = re.compile(rf"[^\W\d_{NUMBER_SIGNS}]+")
#: The same words of texts of ASCII alone (other characters as spaces), and of texts of the Basic Multilingual Plane alone (the letters
#: named, which is a look in a table for a character).
ASCII_LETTERS = "".join(c.lower() if c.isalpha() else " " for c in map(chr, range(128)))
PLANE_LETTERS = re.compile("[" + "".join(f"{re.escape(r[0])}-{re.escape(r[-1])}" for r in LETTERS.findall("".join(chr(i) for i in range(0x10000)))) + "]+")
BEYOND = re.compile("[\U00010000-\U0010ffff]")
#: Words whose scores a task keeps, at most.
CACHE = 300_000


def letter_runs(text: str) -> list[str]:
    """Runs of letters of the text in lower case, as ``LETTERS`` finds them."""
    if text.isascii():
        return text.translate(ASCII_LETTERS).split()
    low = text.lower()
    return (LETTERS if BEYOND.search(low) else PLANE_LETTERS).findall(low)


@dataclass
class Model:
    """Log probabilities per language (columns as ``langs``): ``rows`` of the table by word, and
    by n-gram for each length; the row before the last is zero, the last the prior."""

    langs: list[str]
    words: dict[str, int]
    grams: list[dict[str, int]]
    table: np.ndarray

    @classmethod
    def of(cls, langs: list[str], words: dict[str, np.ndarray], grams: list[dict[str, np.ndarray]], prior: np.ndarray) -> Model:
        rows: list[np.ndarray] = []

        def placed(part: dict[str, np.ndarray]) -> dict[str, int]:
            out = {k: len(rows) + i for i, k in enumerate(part)}
            rows.extend(part.values())
            return out
        words, grams = placed(words), [placed(g) for g in grams]
        return cls(langs, words, grams, np.array([*rows, np.zeros(len(langs)), prior]).reshape(len(rows) + 2, len(langs)))


class Scorer:
    """Predicts batches of texts; keeps the scores of the words met so far, a bounded number."""

    def __init__(self, model: Model):
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.at: dict[str, int] = dict(self.model.words)
        self.scores = self.model.table[:-1]
        self.size = len(self.scores)

    def back_off(self, word: str) -> list[int]:
        """Rows of the longest n-grams of the word that any language knows, else of shorter ones."""
        padded = f" {word} "
        for n in range(len(self.model.grams), 0, -1):
            get = self.model.grams[n - 1].get
            hits = [r for r in [get(padded[i:i + n]) for i in range(len(padded) - n + 1)] if r is not None]
            if hits:
                return hits
        return [len(self.model.table) - 2]

    def learn(self, words: list[str]) -> None:
        """An unseen word scores the mean of its n-grams."""
        hits = [self.back_off(w) for w in words]
        size = np.array([len(h) for h in hits])
        flat = self.model.table[np.fromiter(chain.from_iterable(hits), np.int64, int(size.sum()))]
        mean = np.add.reduceat(flat, np.cumsum(size) - size) / size[:, None]
        if self.size + len(mean) > len(self.scores):
            more = np.zeros((max(len(mean), len(self.scores)), flat.shape[1]))
            self.scores = np.concatenate([self.scores[:self.size], more])
        self.scores[self.size:self.size + len(mean)] = mean
        self.at.update(zip(words, range(self.size, self.size + len(mean))))
        self.size += len(mean)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, posterior) of each text; ``und`` and 0 for one without letters or an untrained model.
        Equal scores go to the first language by name."""
        found = [letter_runs(t) if t else [] for t in texts]
        if not self.model.langs or not any(found):
            return [("und", 0.0)] * len(texts)
        if len(self.at) > CACHE + len(self.model.words):
            self.reset()
        new = list(dict.fromkeys(w for words in found for w in words if w not in self.at))
        if new:
            self.learn(new)
        get = self.at.__getitem__
        out = []
        for words in found:
            if not words:
                out.append(("und", 0.0))
                continue
            rows = np.fromiter(map(get, words), np.int64, len(words))
            total = self.scores[rows].sum(axis=0) + self.model.table[-1]
            best = int(total.argmax())
            out.append((self.model.langs[best], float(1 / np.exp(np.minimum(total - total[best], 0)).sum())))
        return out


def _logs(rows: list, langs: list[str], smooth: float = 0.5) -> dict[str, np.ndarray]:
    """(lang, item, count) -> item -> log probability per language, additive smoothing."""
    at = {x: i for i, x in enumerate(langs)}
    counts: dict[str, np.ndarray] = {}
    for lang, item, n in rows:
        counts.setdefault(item, np.zeros(len(langs)))[at[lang]] += n
    total = sum(counts.values(), np.zeros(len(langs))) + smooth * (len(counts) + 1)
    return {k: np.log((v + smooth) / total) for k, v in counts.items()}


def _count(max_n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of words (n = 0) and n-grams of the task's documents, in bounded parts."""
        counts: Counter = Counter()

        def part():
            langs, ns, items = zip(*counts) if counts else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(ns, pa.int32()), pa.array(items, pa.string()),
                                               pa.array(list(counts.values()), pa.int64())], names=["lang", "n", "item", "count"])
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for w, c in Counter(letter_runs(text.as_py() or "")).items():
                    counts[lang, 0, w] += c
                    padded = f" {w} "
                    for n in range(1, max_n + 1):
                        for i in range(len(padded) - n + 1):
                            counts[lang, n, padded[i:i + n]] += c
                if len(counts) > 500_000:
                    yield part()
                    counts.clear()
        yield part()
    return run


def fit(docs: DataFrame, *, max_docs: int = 800, max_words: int = 30_000, max_grams: int = 10_000, max_n: int = 5, id_col: str = "doc_id",
        text_col: str = "text", lang_col: str = "lang") -> Model:
    """Count about ``max_docs`` labelled documents per language (a bounded sample by a hash of the id; whole
    texts) and keep the ``max_words`` commonest words and ``max_grams`` commonest
    n-grams of each length per language.  Rows with a null language or id are
    left out; only the rows given are learned from."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and id is not null")
    size = dict(rows.groupBy("lang").count().collect())
    unit = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    pick = F.lit(False)
    for lang, n in size.items():
        pick = pick | ((F.col("lang") == lang) & (unit < min(1.0, max_docs / n)))
    counted = rows.where(pick).select("lang", "text").mapInArrow(_count(max_n), "lang string, n int, item string, count long") \
        .groupBy("lang", "n", "item").agg(F.sum("count").alias("count"))
    top = counted.withColumn("r", F.expr("row_number() over (partition by lang, n order by count desc, item)")) \
        .where(F.col("r") <= F.when(F.col("n") == 0, max_words).otherwise(max_grams)).select("lang", "n", "item", "count").collect()
    langs = sorted({r.lang for r in top})
    by_n = [_logs([(r.lang, r.item, r["count"]) for r in top if r.n == n], langs) for n in range(max_n + 1)]
    prior = np.array([math.log(size[x] / sum(size.values())) for x in langs])
    return Model.of(langs, by_n[0], by_n[1:], prior)


def training_part(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents that may be learned from: crc32 of the id as text, mod 4, is not 2."""
    return docs.where(F.crc32(F.col(id_col).cast("string")) % 4 != 2)


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` of every whole text.  A null text and one without letters are ``und`` with
    score 0; repeated rows and null ids are returned as they are; an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value)
        for texts in batches:
            got = [g for _, part in blocks(texts, 1 << 20) for g in scorer.predict(part.to_pylist())]
            yield pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["lang", "score"])
    out = docs.select(F.col(id_col).alias("doc_id"), F.arrow_udf(run, "struct<lang:string,score:double>")(F.col(text_col)).alias("p"))
    return out.select("doc_id", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))
