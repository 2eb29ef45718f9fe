"""Queries: change detection and interval sampling of readings."""

from __future__ import annotations

from ..operators import timeseries as TS
from .registry import register

TS_SQL = "TRY_CAST(timestamp AS TIMESTAMP)"


@register("changes_only", f"""
SELECT offset_id, source_type, asset_id, timestamp, quality, value, unit FROM (
  SELECT *, LAG(value) OVER w AS prev, ROW_NUMBER() OVER w AS rn FROM readings
  WINDOW w AS (PARTITION BY asset_id ORDER BY {TS_SQL} ASC NULLS FIRST, offset_id))
WHERE rn = 1 OR prev IS DISTINCT FROM value
""", ["readings"])
def changes_only(fx):
    r = fx.readings().withColumn("event_time", TS.event_time())
    return TS.changes_only(r).drop("event_time")


@register("sampled", f"""
SELECT asset_id, window_start, window_start + INTERVAL 1 HOUR AS window_end, value, n_readings FROM (
  SELECT asset_id, time_bucket(INTERVAL 1 HOUR, {TS_SQL}) AS window_start, value,
    ROW_NUMBER() OVER (PARTITION BY asset_id, time_bucket(INTERVAL 1 HOUR, {TS_SQL}) ORDER BY {TS_SQL} DESC, offset_id DESC) AS rn,
    COUNT(*) OVER (PARTITION BY asset_id, time_bucket(INTERVAL 1 HOUR, {TS_SQL})) AS n_readings
  FROM readings WHERE {TS_SQL} IS NOT NULL)
WHERE rn = 1
""", ["readings"])
def sampled(fx):
    r = fx.readings().withColumn("event_time", TS.event_time())
    return TS.sample_interval(r, 3_600_000)
