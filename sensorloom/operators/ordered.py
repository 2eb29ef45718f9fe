"""Exact per-key order logic without one task per key.

``lag(x) over (partition by key order by o)`` puts all rows of a key into
one task.  Here every key is split into order buckets (a coarse function of
the order, e.g. the event day or ``seq >> 20``): the window runs inside
(key, bucket), and the first rows of a bucket take what they need from the
earlier buckets through a per-(key, bucket) summary (one row per bucket)
with a small window over buckets.  The summary is aggregated from the
windowed rows, which are already partitioned by (key, bucket), so the data
is shuffled once; the summary is joined back on (key, bucket).  Output
equals the plain window; no task holds more than one bucket of one key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _join_carry(rows: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    cond = F.col("_b").eqNullSafe(F.col("_kb"))
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return rows.join(carry, cond, "inner")


def _all_columns(df: DataFrame) -> Column:
    """An aggregate that reads every column.  With it (and one that reads a window's output) the summary branch
    keeps the columns and the exchange of the row branch; without it column pruning would make them differ and scan twice."""
    return F.max(F.hash(*[F.col(f.name) for f in df.schema.fields if "map<" not in f.dataType.simpleString()])).alias("_read")


def prev_by_key(df: DataFrame, key: str, order: list[str], bucket: Column, cols: list[str],
                prefix: str = "prev_") -> DataFrame:
    """Add ``prev_<c>`` for each ``c`` in ``cols`` and ``has_prev``.

    ``order`` columns sort ascending with NULLs first; ``bucket`` must be
    monotone in ``order`` (non-decreasing)."""
    b = df.withColumn("_b", bucket)
    ordc = [F.col(o).asc_nulls_first() for o in order]
    w = Window.partitionBy(key, "_b").orderBy(*ordc)
    rows = b.select("*", *[F.lag(c).over(w).alias(f"_lag_{c}") for c in cols],
                    F.row_number().over(w).alias("_rn"))
    last_key = F.struct(*[F.col(o) for o in order])
    summary = rows.groupBy(key, "_b").agg(_all_columns(df), F.max("_rn").alias("_n"), *[F.max_by(F.col(c), last_key).alias(f"_last_{c}") for c in cols]) \
                  .where(F.col("_read").isNotNull() & (F.col("_n") > 0))
    wb = Window.partitionBy(key).orderBy(F.col("_b").asc_nulls_first())
    carry = summary.select(F.col(key).alias(f"_k_{key}"), F.col("_b").alias("_kb"),
                           *[F.lag(f"_last_{c}").over(wb).alias(f"_carry_{c}") for c in cols],
                           (F.row_number().over(wb) > 1).alias("_has_carry"))
    j = _join_carry(rows, carry, [key])
    first = F.col("_rn") == 1
    return j.select(
        *[F.col(c) for c in df.columns],
        *[F.when(first, F.col(f"_carry_{c}")).otherwise(F.col(f"_lag_{c}")).alias(f"{prefix}{c}") for c in cols],
        (~first | F.col("_has_carry")).alias("has_prev"))


def running_by_key(df: DataFrame, keys: list[str], order: list[str], bucket: Column,
                   count_as: str | None = "rank", max_of: dict[str, str] | None = None) -> DataFrame:
    """Exact running aggregates per key in ``order``: the 1-based row rank
    (``count_as``) and running maxima (``max_of``: output -> input column)."""
    max_of = max_of or {}
    b = df.withColumn("_b", bucket)
    ordc = [F.col(o).asc_nulls_first() for o in order]
    w = Window.partitionBy(*keys, "_b").orderBy(*ordc).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = b.select("*", F.count(F.lit(1)).over(w).alias("_lc"),
                    *[F.max(src).over(w).alias(f"_lm_{o}") for o, src in max_of.items()])
    summary = rows.groupBy(*keys, "_b").agg(F.max("_lc").alias("_n"), _all_columns(df),
                                            *[F.max(f"_lm_{o}").alias(f"_m_{o}") for o in max_of]).where(F.col("_read").isNotNull())
    wb = Window.partitionBy(*keys).orderBy(F.col("_b").asc_nulls_first()) \
               .rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_b").alias("_kb"),
                           F.coalesce(F.sum("_n").over(wb), F.lit(0)).alias("_cn"),
                           *[F.max(f"_m_{o}").over(wb).alias(f"_cm_{o}") for o in max_of])
    j = _join_carry(rows, carry, keys)
    out = [F.col(c) for c in df.columns]
    if count_as:
        out.append((F.col("_cn") + F.col("_lc")).alias(count_as))
    out += [F.greatest(F.col(f"_cm_{o}"), F.col(f"_lm_{o}")).alias(o) for o in max_of]
    return j.select(*out)


def run_lengths(df: DataFrame, key: str, order: str, value: str, bucket: Column,
                out: str = "run_length") -> DataFrame:
    """Length of the current run of equal ``value`` (null-safe) per key in
    ``order`` — gaps and islands in one bucketed pass.

    Inside (key, bucket): local rank L, local break flag (value differs from
    the previous row; unknown for the bucket's first row) and the last local
    break.  Per bucket: size, first/last value, last local break.  Over the
    buckets of a key (small): rows before the bucket, whether the bucket's
    first row breaks, and the global rank of the latest break before the
    bucket (a running max, since break ranks grow).  Then
    ``run_length = rank - island_start + 1``."""
    b = df.withColumn("_b", bucket)
    w = Window.partitionBy(key, "_b").orderBy(F.col(order).asc_nulls_first())
    wr = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = b.select("*", F.row_number().over(w).alias("_lrank"), F.lag(value).over(w).alias("_pv"))
    local_brk = (F.col("_lrank") > 1) & ~F.col("_pv").eqNullSafe(F.col(value))
    rows = rows.withColumn("_lbrk", F.max(F.when(local_brk, F.col("_lrank"))).over(wr))
    summary = rows.groupBy(key, "_b").agg(
        F.max("_lrank").alias("_n"), _all_columns(df), F.min_by(F.col(value), F.col(order)).alias("_first"),
        F.max_by(F.col(value), F.col(order)).alias("_last"), F.max("_lbrk").alias("_max_lbrk")).where(F.col("_read").isNotNull())
    wb = Window.partitionBy(key).orderBy(F.col("_b").asc_nulls_first())
    before = wb.rowsBetween(Window.unboundedPreceding, -1)
    s = summary.select(key, "_b", "_max_lbrk",
                       F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_cn"),
                       (F.row_number().over(wb) == 1).alias("_is_first"),
                       F.lag("_last").over(wb).alias("_prev_last"), "_first")
    first_brk = F.col("_is_first") | ~F.col("_first").eqNullSafe(F.col("_prev_last"))
    s = s.withColumn("_first_brk", first_brk)
    lb = F.col("_cn") + F.coalesce(F.col("_max_lbrk"), F.when(F.col("_first_brk"), F.lit(1)))
    s = s.withColumn("_brk_rank", lb)
    carry = s.select(F.col(key).alias(f"_k_{key}"), F.col("_b").alias("_kb"), "_cn", "_first_brk",
                     F.max("_brk_rank").over(wb.rowsBetween(Window.unboundedPreceding, -1)).alias("_start_in"))
    j = _join_carry(rows, carry, [key])
    start = (F.when(F.col("_lbrk").isNotNull(), F.col("_cn") + F.col("_lbrk"))
             .when(F.col("_first_brk"), F.col("_cn") + 1).otherwise(F.col("_start_in")))
    return j.select(*[F.col(c) for c in df.columns], (F.col("_cn") + F.col("_lrank") - start + 1).alias(out))
