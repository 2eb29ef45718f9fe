"""Ordered rules over readings: change detection and interval sampling.

Scale note.  A window ``partition by asset`` sends every reading of one
asset to one task; with a handful of assets (or one asset holding a third
of all rows) that task is the whole job.  ``changes_only`` therefore splits
each asset's series into time buckets: the previous value inside a bucket
comes from ``lag`` partitioned by (asset, bucket); the first row of a bucket
compares with the last value of the asset's previous non-empty bucket,
taken from a per-(asset, bucket) summary (one row per bucket, built with a
partial aggregate).  The result is exact and no task ever holds more than
one bucket of one asset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import prev_by_key


def event_time(text_col: str = "timestamp") -> Column:
    """Typed event time from the text timestamp (unparsable -> NULL)."""
    return F.col(text_col).try_cast("timestamp_ntz")


def changes_only(df: DataFrame, key: str = "asset_id", value: str = "value", ts: str = "event_time",
                 tiebreak: str = "offset_id", bucket: str = "day") -> DataFrame:
    """Keep a reading only when its value differs (null-safe) from the
    previous reading of the same key; the first reading of a key is kept.

    Order is (``ts``, ``tiebreak``).  ``bucket`` is a ``date_trunc`` unit
    bounding the rows any one task sees for a hot key."""
    p = prev_by_key(df, key, [ts, tiebreak], F.date_trunc(bucket, F.col(ts)), [value], prefix="_prev_")
    keep = ~F.col("has_prev") | ~F.col(f"_prev_{value}").eqNullSafe(F.col(value))
    return p.where(keep).drop(f"_prev_{value}", "has_prev")


def sample_interval(df: DataFrame, interval_ms: int, key: str = "asset_id", value: str = "value",
                    ts: str = "event_time", tiebreak: str = "offset_id") -> DataFrame:
    """One value per key and interval: the last reading of each tumbling
    window (``max_by`` is a partial aggregate, so hot keys combine map-side).

    The interval is whole seconds (``interval_ms // 1000``); below one
    second the reference's flow would poll every 0 s, so it is rejected."""
    if interval_ms < 1000:
        raise ValueError("interval_ms must be at least 1000 (whole seconds)")
    secs = interval_ms // 1000
    g = (df.where(F.col(ts).isNotNull())
         .groupBy(key, F.window(ts, f"{secs} seconds").alias("w"))
         .agg(F.max_by(F.col(value), F.struct(ts, tiebreak)).alias(value), F.count(F.lit(1)).alias("n_readings")))
    return g.select(key, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    value, "n_readings")
