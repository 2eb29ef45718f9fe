"""Source divergence audit: how far the terms of a language's sources lie from each other.

Tokens come from one ``bytes.translate`` (letters lowered, separators blanked) and one
``bytes.split`` per text; a Counter per document gives its occurrences, and the number of documents of
a term.  Tasks add them up per (lang, source) and send sparse counts, which Spark sums.

Shares are integers: ``1 + floor(scale * (count + alpha) / (N + alpha * V))`` of the V kept terms of a language.
Distances of two sources sum over all kept terms, but only terms that occur in a block of
sources are looked at: all others add the same amount, which a product gives.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.topk import top_k_per_group
from .shared import shared_table
from .text import blocks

#: ASCII letters lowered, other ASCII characters blanked, bytes of all other characters kept.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
#: Terms held per task before their counts are sent.
HELD = 400_000
#: Sources and terms that one task of the distances looks at together.
SOURCES, TERMS = 64, 256

_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("occurrences", pa.int64()), ("documents", pa.int64())])


def terms(text: str) -> Counter:
    """Occurrences of the terms (UTF-8 bytes) of a text: runs of ASCII letters, lowered, and non-ASCII characters."""
    return Counter(text.encode().translate(TABLE).split())


def _send(held: dict) -> Iterator[pa.RecordBatch]:
    for (lang, source), (occurrences, documents) in held.items():
        names = list(occurrences)
        for i in range(0, len(names), 50_000):
            part = names[i:i + 50_000]
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * len(part), pa.string()), pa.array([source] * len(part), pa.string()), pa.array(part, pa.binary()).cast(pa.string()),
                pa.array([occurrences[t] for t in part], pa.int64()), pa.array([documents[t] for t in part], pa.int64())], schema=_COUNTS)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], tuple[dict, dict]] = {}
    n = 0
    for batch in batches:
        langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        texts = ((at + i, t) for at, part in blocks(batch.column(2)) for i, t in enumerate(part.to_pylist()))
        for row, text in texts:
            own, lang, source = terms(text), langs[row], sources[row]
            occurrences, documents = held.setdefault((lang, source), ({}, {}))
            n -= len(occurrences)
            for t, k in own.items():
                if t in occurrences:
                    occurrences[t] += k
                    documents[t] += 1
                else:
                    occurrences[t], documents[t] = k, 1
            n += len(occurrences)
            if n > HELD:
                yield from _send(held)
                held, n = {}, 0
    yield from _send(held)


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")).alias(c)


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, occurrences, documents`` summed over all whole texts; null lang, source and text count as empty."""
    rows = docs.select(_text("lang"), _text("source"), _text("text")).mapInArrow(_count, "lang string, source string, term string, occurrences long, documents long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("documents").alias("documents"))


def _share(count: str, total: str, size: str, alpha: int, scale: int) -> Column:
    """Exact integer share; the products are decimals, which hold what longs would not."""
    return F.expr(f"(cast({count} + {alpha} AS decimal(20,0)) * {scale}BD) div cast({total} + {alpha} * {size} AS decimal(20,0)) + 1")


def _distances(df: pd.DataFrame) -> pd.DataFrame:
    """Of every two sources of two blocks, over the terms of one bucket that occur in either: by how much their
    distance is more than with none of these terms in either source.  Each source has a row without a term."""
    lang, a, b = df.lang.iloc[0], df.block_a.iloc[0], df.block_b.iloc[0]
    number, first = np.unique(df.number.to_numpy(), return_index=True)
    none = df.none.to_numpy()[first]
    found = df[df.term.notna()]
    term, names = pd.factorize(found.term)
    share = np.repeat(none[:, None], len(names), axis=1)
    share[np.searchsorted(number, found.number.to_numpy()), term] = found.share.to_numpy()
    out = []
    left = np.flatnonzero(number // SOURCES == a)
    right = np.flatnonzero(number // SOURCES == b)
    for i in left:
        other = right[number[right] > number[i]] if a == b else right
        if len(other):
            far = np.abs(share[other] - share[i]) - np.abs(none[other] - none[i])[:, None]
            out.append(pd.DataFrame({"lang": lang, "a": number[i], "b": number[other], "over": far.sum(axis=1)}))
    return pd.concat(out) if out else pd.DataFrame({"lang": [], "a": [], "b": [], "over": []})


def audit(docs: DataFrame, *, least_documents: int = 30, alpha: int = 5, scale: int = 1_000_000_000, top: int = 50) -> DataFrame:
    """``lang, source, part, item, value, rank``.

    Kept terms of a language occur in ``least_documents`` of its documents at least.  Part ``pair``: the distance of the
    source's shares from those of each other source of the language, all ranks.  Part ``term``: kept terms whose
    share in the source lies above the language's, by how much, to rank ``top``.  Ranks go by value, descending,
    then item.  Every (lang, source) that occurs is a group, with or without terms; a language without kept
    terms has distances of 0.  Null text, lang and source count as empty; repeated rows count as often as they
    occur; an empty table gives no rows; other columns are ignored."""
    counts = shared_table(term_counts(docs), "divergence-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("documents").alias("documents"), F.sum("occurrences").alias("in_lang"))
    kept = shared_table(kept.where(F.col("documents") >= least_documents).drop("documents"), "divergence-kept")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("size"), F.sum("in_lang").alias("lang_total"))
    own = shared_table(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "occurrences", "in_lang"), "divergence-own")
    totals = own.groupBy("lang", "source").agg(F.sum("occurrences").alias("total"))
    groups = docs.select(_text("lang"), _text("source")).distinct()
    groups = groups.join(sizes, "lang", "left").join(totals, ["lang", "source"], "left").na.fill(0, ["size", "lang_total", "total"])
    none = F.when(F.col("size") > 0, _share("0L", "total", "size", alpha, scale)).otherwise(0).alias("none")
    groups = groups.withColumn("number", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1)
    groups = shared_table(groups.select("*", none, F.count("*").over(Window.partitionBy("lang")).alias("n_sources")), "divergence-groups")
    return _pairs(own, groups, alpha, scale).unionByName(_terms(own, groups, alpha, scale, top))


def _pairs(own: DataFrame, groups: DataFrame, alpha: int, scale: int) -> DataFrame:
    """The distance of every two sources of a language, in both directions."""
    source = ["lang", "number", "none", F.floor(F.col("number") / SOURCES).alias("_block"), F.floor((F.col("n_sources") - 1) / SOURCES).alias("_last")]
    buckets = F.ceil(F.col("size") / TERMS)
    rows = own.join(groups, ["lang", "source"]).select(
        *source, "term", _share("occurrences", "total", "size", alpha, scale).alias("share"), F.pmod(F.xxhash64("term"), buckets).alias("bucket"))
    rows = rows.unionByName(groups.where("size > 0").select(*source, F.explode(F.sequence(F.lit(0).cast("long"), buckets - 1)).alias("bucket")), allowMissingColumns=True)
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), "_last")).alias("_other"))
    rows = rows.select("lang", "term", "number", "none", "share", "bucket", F.least("_block", "_other").alias("block_a"), F.greatest("_block", "_other").alias("block_b"))
    parts = rows.groupBy("lang", "bucket", "block_a", "block_b").applyInPandas(_distances, "lang string, a long, b long, over long")
    over = parts.groupBy("lang", "a", "b").agg(F.sum("over").alias("over"))
    over = over.union(over.select("lang", "b", "a", "over"))
    one = groups.select("lang", F.col("number").alias("a"), "source", F.col("none").alias("none_a"), "size")
    two = groups.select("lang", F.col("number").alias("b"), F.col("source").alias("item"), F.col("none").alias("none_b"))
    pairs = one.join(two, "lang").where("a <> b").join(over, ["lang", "a", "b"], "left")
    value = F.coalesce("over", F.lit(0)) + F.col("size") * F.abs(F.col("none_a") - F.col("none_b"))
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.cast("long").alias("value")).withColumn("rank", F.row_number().over(w))


def _terms(own: DataFrame, groups: DataFrame, alpha: int, scale: int, top: int) -> DataFrame:
    """Terms with a greater share in the source than in its language."""
    rows = own.join(groups, ["lang", "source"])
    value = _share("occurrences", "total", "size", alpha, scale) - _share("in_lang", "lang_total", "size", alpha, scale)
    rows = rows.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), value.alias("value")).where("value > 0")
    return top_k_per_group(rows, ["lang", "source", "part"], [F.desc("value"), F.asc("item")], top)
