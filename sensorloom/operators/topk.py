"""Top-k per group without sorting a whole group in one task.

``row_number() over (partition by g order by ...)`` sends every row of a
group to one task; a group holding a third of the rows is then a single
task.  ``top_k_per_group`` ranks first inside (group, salt) buckets, keeps
k rows per bucket, and ranks the survivors (at most ``k * salts`` per
group) per group.  The global top k of a group is always among the
per-bucket top k, so the result is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, salts: int = 64,
                    salt_cols: list[str] | None = None, rank_as: str = "rank") -> DataFrame:
    """Rows ranked 1..k per ``keys`` by ``order`` (must be a total order for
    a deterministic result, e.g. end with a unique tie-breaker)."""
    if k < 1:
        raise ValueError("k must be at least 1")
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in (salt_cols or df.columns)]), F.lit(salts))
    s = df.withColumn("_salt", salt)
    w1 = Window.partitionBy(*keys, "_salt").orderBy(*order)
    pre = s.withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= k).drop("_r1", "_salt")
    w2 = Window.partitionBy(*keys).orderBy(*order)
    return pre.withColumn(rank_as, F.row_number().over(w2)).where(F.col(rank_as) <= k)


def clamp(n: int, lo: int = 1, hi: int = 10) -> int:
    """``max(lo, min(n, hi))`` — the result-count clamp of the search tool."""
    return max(lo, min(int(n), hi))
