"""Threshold-scaled sketches: every shingle hash below a fixed fraction is kept, and the least ones of short texts.

DataFrame functions only.  Sketches of any texts can be merged, and
compared whatever the lengths: the share of a sketch found in another estimates
the share of its shingles found there.  A sketch of fewer than LEAST hashes has all of its text;
any other has all hashes up to the fraction, or up to its largest one if that is more.  Two sketches
are held against each other up to the smaller of these limits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Shingle hashes are kept below this fraction of the hash range.
FRACTION = 0.25
SHINGLE = 5
#: Where fewer lie there, the so many least hashes are kept.
LEAST = 16


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def _top(fraction: float) -> int:
    return -(1 << 63) + int(fraction * (1 << 64))


def _limit(s: Column) -> Column:
    """Up to where a sketch has all hashes of its text."""
    return F.when(F.size(s) < LEAST, F.lit((1 << 63) - 1)).otherwise(F.greatest(F.array_max(s), F.lit(_top(FRACTION))))


def _common(a: Column, b: Column, body) -> Column:
    """``body`` of both sketches up to the smaller limit."""
    def upto(s, top):
        return F.filter(s, lambda h: h <= top)
    return _let(F.least(_limit(a), _limit(b)), lambda top: _let(F.struct(upto(a, top).alias("a"), upto(b, top).alias("b")), lambda x: body(x["a"], x["b"])))


def sketch(text: Column, shingle: int = SHINGLE, fraction: float = FRACTION) -> Column:
    """Sorted distinct hashes (longs) of the text's ``shingle``-word runs that lie in the
    lowest ``fraction``, or the LEAST least ones (all, if there are fewer) where fewer lie there, so only null and
    wordless texts have an empty sketch; a text of fewer words, but not none, has one run."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    limit = _top(fraction)

    def kept(hashes):
        low = F.array_sort(F.array_distinct(F.filter(hashes, lambda h: h < F.lit(limit))))
        return _let(low, lambda s: F.when(F.size(s) >= LEAST, s).otherwise(F.slice(F.array_sort(F.array_distinct(hashes)), 1, LEAST)))

    def of(w):
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (shingle - 1)), lambda i: F.xxhash64(F.slice(w, i, shingle)))
        return F.when(F.size(w) >= shingle, _let(hashes, kept)) \
            .when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))
    return _let(words, of)


def as_text(s: Column) -> Column:
    """Sixteen hex digits per hash, in order."""
    return F.array_join(F.transform(s, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two sketches; two empty ones are alike."""
    def of(x, y):
        return _let(F.size(F.array_intersect(x, y)), lambda n: F.when(F.size(x) + F.size(y) == 0, F.lit(1.0)).otherwise(n / (F.size(x) + F.size(y) - n)))
    return _common(a, b, of)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that are in b; 0 for an empty sketch, null where b's sketch
    does not reach up to a's least hash and so says nothing of it."""
    def of(x, y):
        return F.when(F.size(x) > 0, F.size(F.array_intersect(x, y)) / F.size(x))
    return F.when(F.size(a) == 0, F.lit(0.0)).otherwise(_common(a, b, of))


def merge(a: Column, b: Column) -> Column:
    """Sketch of the union of two texts' shingles."""
    return _common(a, b, lambda x, y: F.array_sort(F.array_union(x, y)))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, sketch`` (sorted longs) of every whole text.  Null ids and repeated rows are returned as
    they are, other columns are ignored, an empty table gives no rows."""
    return docs.select(F.col(id_col).alias("doc_id"), sketch(F.col(text_col)).alias("sketch"))


def with_next(docs: DataFrame, per_part: int = 2000, max_parts: int = 10_000) -> DataFrame:
    """Each row of (doc_id, text) with its ``sketch`` and the next row's text and sketch (``next``:
    struct), by descending ``doc_id`` and text; after the last comes the first.

    Rows are dealt to ranges of ids (about ``per_part`` rows, more where that makes over
    ``max_parts`` ranges; the range limits, ids themselves, are all that is collected), so each text is
    shuffled once and no task holds more than a range.  A range also gets the largest row
    of the range below, which follows its last row.  Null ids come after all others; null texts count as empty."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    n, top, n_all = rows.agg(F.count("doc_id"), F.max("doc_id"), F.count("*")).first()
    parts = min(max_parts, max(1, -(-n // per_part)))
    steps = [i / parts for i in range(1, parts)] + [1.0]
    limits = sorted({*rows.agg(F.percentile_approx("doc_id", steps, max(10_000, 10 * parts))).first()[0], top}) if n else []
    ids = F.array(*[F.lit(x) for x in limits]).cast("array<bigint>")
    part = F.when(F.col("doc_id").isNull(), -1).otherwise(F.size(F.filter(ids, lambda b: b < F.col("doc_id"))))
    own = rows.select("doc_id", "text", part.alias("part"), F.lit(False).alias("copy"))
    heads = rows.where(F.col("doc_id").isin(limits)).groupBy("doc_id").agg(F.max("text").alias("text")).select("doc_id", "text", part.alias("part"))
    # the largest of all follows the last range: that of null ids, if there are any, else the lowest
    copies = heads.withColumn("part", F.when(F.col("part") < len(limits) - 1, F.col("part") + 1).otherwise(F.lit(0 if n_all == n else -1)))
    if n_all > n:
        lowest = rows.where("doc_id is null").agg(F.max("text").alias("text"))
        copies = copies.union(lowest.select(F.lit(None).cast("long"), "text", F.lit(0 if n else -1)))
    both = own.union(copies.select("doc_id", "text", "part", F.lit(True)))
    both = both.select("doc_id", "text", "part", "copy", sketch(F.col("text")).alias("sketch"))
    w = Window.partitionBy("part").orderBy("copy", F.desc_nulls_last("doc_id"), F.desc("text"))
    return both.withColumn("next", F.lead(F.struct("text", "sketch")).over(w)).where("not copy").select("doc_id", "text", "sketch", "next")
