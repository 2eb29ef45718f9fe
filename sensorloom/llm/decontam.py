"""Benchmark decontamination by a positional inverted index.

The training texts are cut into segments of whole documents.  For each segment
the index, a Parquet table in the shared folder, holds for every token the
places of its occurrences, counted through the segment.  Test windows are
looked up in it: term counts over the whole index order the terms of a window
from rarest to commonest, then every segment intersects the offset-adjusted
lists in that order and stops at the first empty one.  What is left are exact
phrase matches; the same lists, with a slop, give proximity matches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import shared_table
from .text import Words, binary_array, blocks

INDEX = "segment string, token long, n long, places binary, ord long, doc_id long, n_words long"
MATCH = "segment string, ord long, item_id long, exact boolean, first long, last long"
#: UTF-8 bytes of text in a segment (one document at least), and of test items in a block.
SEGMENT_BYTES, ITEM_BYTES = 16 << 20, 16 << 20


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, number = TaskContext.get().partitionId(), 0
    schema = pa.schema([("segment", pa.string()), ("token", pa.int64()), ("n", pa.int64()), ("places", pa.binary()),
                        ("ord", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64())])
    for batch in batches:
        for at, texts in blocks(batch.column(1), SEGMENT_BYTES):
            name = f"{part}-{number}"
            number += 1
            w = Words(texts)
            n = len(texts)
            blank = lambda m, t: pa.nulls(m, t)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * n), blank(n, pa.int64()), blank(n, pa.int64()), blank(n, pa.binary()), pa.array(np.arange(n)),
                 batch.column(0).slice(at, n), pa.array(np.diff(w.first))], schema=schema)
            order = np.argsort(w.hash, kind="stable").astype(np.int32)
            token = w.hash[order]
            bound = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1]))) if len(token) else np.zeros(0, np.int64)
            ends = np.append(bound, len(token))
            for i in range(0, len(bound), 100_000):
                j = min(i + 100_000, len(bound))
                m = j - i
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * m), pa.array(token[bound[i:j]].astype(np.int64)), pa.array(np.diff(ends[i:j + 1])),
                     binary_array(order[ends[i]:ends[j]], ends[i:j + 1] - ends[i]), blank(m, pa.int64()), blank(m, pa.int64()), blank(m, pa.int64())],
                    schema=schema)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store the positional index of every text.  Rows with ``token`` are posting
    lists (int32 word places in the segment); rows without are the documents in order."""
    return shared_table(docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(_postings, INDEX), "postings")


class Windows:
    """Distinct word windows of a block of test items: hashes (a row each, ``size``
    of them used) and the items that hold each."""

    def __init__(self, items: list[tuple[int, np.ndarray]], width: int):
        seen: dict[bytes, set] = {}
        for item, h in items:
            for i in range(max(1, len(h) - width + 1) if len(h) else 0):
                seen.setdefault(h[i:i + width].tobytes(), set()).add(item)
        self.terms = [np.frombuffer(k, np.uint64) for k in seen]
        self.items = [sorted(v) for v in seen.values()]
        self.vocabulary = np.unique(np.concatenate(self.terms)).astype(np.int64) if self.terms else np.zeros(0, np.int64)


def _item_blocks(items: DataFrame, width: int) -> Iterator[Windows]:
    """Blocks of test items, a bounded number of bytes on the driver at a time."""
    block, size = [], 0
    for item, text in items.select("item_id", "text").where("item_id is not null and text is not null").toLocalIterator():
        block.append((item, Words(pa.array([text])).hash))
        size += len(text)
        if size > ITEM_BYTES:
            yield Windows(block, width)
            block, size = [], 0
    if block:
        yield Windows(block, width)


def _matcher(windows, order, near_terms: int, slop: int):
    """Segment rows -> matches.  ``order``: places of a window's terms, rarest first."""
    def of_segment(name: str, lists: dict[int, np.ndarray], n_words: np.ndarray) -> pd.DataFrame | None:
        first = np.concatenate(([0], np.cumsum(n_words)))
        found = []
        for terms, items, by in zip(windows.value.terms, windows.value.items, order.value):
            got = lists.get(int(terms[by[0]].astype(np.int64)))
            if got is None:
                continue
            begin = got - by[0]
            exact = begin
            for o in by[1:]:
                at = lists.get(int(terms[o].astype(np.int64)))
                if at is None:
                    exact = exact[:0]
                    break
                i = np.searchsorted(at, exact + o)
                exact = exact[at[np.minimum(i, len(at) - 1)] == exact + o]
                if not len(exact):
                    break
            near = begin[~np.isin(begin, exact)] if len(by) > near_terms else begin[:0]
            for o in by[1:near_terms]:
                at = lists.get(int(terms[o].astype(np.int64)))
                if at is None or not len(near):
                    near = near[:0]
                    break
                i = np.minimum(np.searchsorted(at, near + o - slop), len(at) - 1)
                near = near[np.abs(at[i] - (near + o)) <= slop]
            for hit, is_exact in ((exact, True), (near, False)):
                if len(hit):
                    doc = np.searchsorted(first, hit + by[0], "right") - 1  # of the rarest term
                    lo, hi = hit - first[doc], hit + len(by) - first[doc]
                    if is_exact:
                        ok = (lo >= 0) & (hi <= n_words[doc])
                        doc, lo, hi = doc[ok], lo[ok], hi[ok]
                    for item in items:
                        found.append(np.column_stack([doc, np.full(len(doc), item), np.full(len(doc), is_exact), np.maximum(lo, 0), np.minimum(hi, n_words[doc])]))
        if not found:
            return None
        m = np.unique(np.concatenate(found).astype(np.int64), axis=0)  # by document, item, kind, place
        new = np.ones(len(m), bool)  # overlapping windows of an item make one passage
        new[1:] = (m[1:, :3] != m[:-1, :3]).any(axis=1) | (m[1:, 3] > m[:-1, 4])
        at = np.flatnonzero(new)
        last = np.maximum.reduceat(m[:, 4], at)
        return pd.DataFrame({"segment": name, "ord": m[at, 0], "item_id": m[at, 1], "exact": m[at, 2] == 1, "first": m[at, 3], "last": last})

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, lists, docs = None, {}, []
        schema = pa.schema([("segment", pa.string()), ("ord", pa.int64()), ("item_id", pa.int64()), ("exact", pa.bool_()), ("first", pa.int64()), ("last", pa.int64())])

        def flush():
            words = np.zeros(max((o for o, _ in docs), default=-1) + 1, np.int64)
            for o, n in docs:
                words[o] = n
            out = of_segment(name, lists, words) if lists else None
            if out is not None and len(out):
                yield pa.RecordBatch.from_pandas(out, schema=schema, preserve_index=False)

        for batch in frames:  # rows come sorted by segment; a segment may span batches
            seg, token, places, order_, n = (batch.column(i) for i in range(5))
            for i, s in enumerate(seg.to_pylist()):
                if s != name:
                    if name is not None:
                        yield from flush()
                    name, lists, docs = s, {}, []
                if token[i].is_valid:
                    lists[token[i].as_py()] = np.frombuffer(places[i].as_py(), np.int32).astype(np.int64)
                else:
                    docs.append((order_[i].as_py(), n[i].as_py()))
        if name is not None:
            yield from flush()
    return run


def find_matches(index: DataFrame, items: DataFrame, *, width: int = 13, near_terms: int = 4, slop: int = 8) -> DataFrame:
    """Passages of test items in the indexed texts: ``segment, ord, item_id, exact,
    first, last`` (word places in the document, ``last`` exclusive).

    Exact: all words of a window of ``width`` words (of the whole item if it has
    fewer) in a row.  Proximity: the ``near_terms`` rarest terms of a window, each
    within ``slop`` words of its place, without the exact phrase.  Test items are
    taken in blocks of bounded bytes; every block meets the whole index."""
    spark = index.sparkSession
    out = spark.createDataFrame([], MATCH)
    for block in _item_blocks(items, width):
        terms = spark.createDataFrame(pd.DataFrame({"token": block.vocabulary}), "token long")
        # the block's vocabulary is bounded by ITEM_BYTES, so it may be broadcast
        lists = index.where("token is not null").join(F.broadcast(terms), "token", "left_semi")
        count = {r[0]: r[1] for r in lists.groupBy("token").agg(F.sum("n")).toLocalIterator()}
        order = [sorted(range(len(t)), key=lambda o: (count.get(int(t[o].astype(np.int64)), 0), o)) for t in block.terms]
        there = [len(t) > 0 and int(t[o[0]].astype(np.int64)) in count for t, o in zip(block.terms, order)]
        block.terms, block.items, order = ([x for x, ok in zip(y, there) if ok] for y in (block.terms, block.items, order))
        if not block.terms:
            continue
        used = spark.createDataFrame(pd.DataFrame({"token": np.unique(np.concatenate(block.terms)).astype(np.int64)}), "token long")
        rows = index.where("token is not null").join(F.broadcast(used), "token", "left_semi").select("segment", "token", "places", "ord", "n_words") \
            .union(index.where("token is null").select("segment", "token", "places", "ord", "n_words"))
        dealt = rows.repartition("segment").sortWithinPartitions("segment")
        sc = spark.sparkContext
        out = out.union(dealt.mapInArrow(_matcher(sc.broadcast(block), sc.broadcast(order), near_terms, slop), MATCH))
    return out


def contamination(docs: DataFrame, items: DataFrame, *, width: int = 13, share: int = 20, id_col: str = "doc_id", text_col: str = "text",
                  near_terms: int = 4, slop: int = 8) -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_hit`` (words inside an exact
    match), ``items`` (sorted ids, as strings, of items that match exactly), ``n_near``
    (items that only match by proximity) and ``contaminated`` (a word in ``share`` or more is hit).

    A null or empty text has no words and is clean; items without words match
    nothing; rows that repeat an id stay separate; a null id is returned as it is; an empty table
    gives an empty result; other columns are ignored."""
    index = build_index(docs, id_col, text_col)
    found = shared_table(find_matches(index, items, width=width, near_terms=near_terms, slop=slop), "matches")
    spans = F.array_sort(F.collect_set(F.when(F.col("exact"), F.struct("first", "last"))))
    covered = F.aggregate(spans, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
                          lambda s, x: F.struct((s["n"] + F.greatest(x["last"] - F.greatest(x["first"], s["to"]), F.lit(0))).alias("n"),
                                                F.greatest(s["to"], x["last"]).alias("to")), lambda s: s["n"])
    exact_items = F.collect_set(F.when(F.col("exact"), F.col("item_id").cast("string")))
    near_items = F.collect_set(F.when(~F.col("exact"), F.col("item_id").cast("string")))
    per_doc = found.groupBy("segment", "ord").agg(covered.alias("n_hit"), F.array_sort(exact_items).alias("items"),
                                                  F.size(F.array_except(near_items, exact_items)).cast("long").alias("n_near"))
    rows = index.where("token is null").select("segment", "ord", "doc_id", "n_words").join(per_doc, ["segment", "ord"], "left")
    zero = F.lit(0).cast("long")
    n_hit = F.coalesce("n_hit", zero)
    return rows.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
                       F.coalesce("n_near", zero).alias("n_near"), ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, **params) -> DataFrame:
    """Documents without the contaminated ones (all rows of a contaminated id go;
    rows with a null id stay)."""
    bad = contamination(docs, items, **params).where("contaminated").select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(docs.columns)
