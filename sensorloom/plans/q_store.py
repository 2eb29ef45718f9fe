"""Queries over the document store: scan, filters, latest-n, dashboard JSON."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import readings as R
from ..operators import store as S
from ..session import scratch_path
from .registry import register

COLS = "offset_id, source_type, asset_id, timestamp, quality, value, unit"
DEPLOYED_SQL = ("SELECT offset_id, COALESCE(source_type, 'unknown') AS source_type, COALESCE(asset_id, 'unknown') AS asset_id, "
                "timestamp, quality, value, unit FROM readings WHERE quality <> 'bad'")


def raw_collection(fx):
    """Readings appended to a collection, with deterministic document ids."""
    return S.with_doc_id(fx.readings(), deterministic_from=["offset_id"], namespace="readings")


def processed_collection(fx):
    """Output of the deployed chain (cleansing + normalisation) as stored."""
    df = R.preprocess(fx.readings(), cleansing=True, normalization=True).df
    return S.with_doc_id(df, deterministic_from=["offset_id"], namespace="processed")


def nested_collection(fx):
    """Transformed readings stored with the values under ``data`` (dotted paths)."""
    t = R.preprocess(fx.readings(), transformation=True).df
    t = t.select("offset_id", "source_type", "asset_id", "timestamp", "quality",
                 F.struct("value_deg", "value_rad").alias("data"), "unit")
    return S.with_doc_id(t, deterministic_from=["offset_id"], namespace="nested")


@register("collection_scan", f"SELECT {COLS} FROM readings", ["readings"])
def collection_scan(fx):
    return S.scan(raw_collection(fx))


@register("latest_n", f"""
SELECT * FROM ({DEPLOYED_SQL}) ORDER BY timestamp DESC NULLS LAST, offset_id DESC LIMIT 10
""", ["readings"])
def latest_n(fx):
    return S.latest(processed_collection(fx), 10, tiebreak=["offset_id"])


@register("dashboard_json", f"""
SELECT offset_id, CAST(json_object('offset_id', offset_id, 'source_type', source_type, 'asset_id', asset_id,
  'timestamp', timestamp, 'quality', quality, 'value', value, 'unit', unit) AS VARCHAR) AS json
FROM ({DEPLOYED_SQL}) ORDER BY timestamp DESC NULLS LAST, offset_id DESC LIMIT 100
""", ["readings"])
def dashboard_json(fx):
    return S.dashboard_json(processed_collection(fx), 100, tiebreak=["offset_id"])


@register("doc_filter_eq", f"SELECT {COLS} FROM readings WHERE quality = 'good'", ["readings"])
def doc_filter_eq(fx):
    return S.query_documents(raw_collection(fx), {"quality": "good"}, limit=None)


@register("doc_filter_and", f"SELECT {COLS} FROM readings WHERE source_type = 'opcua' AND asset_id = 'asset_3'",
          ["readings"])
def doc_filter_and(fx):
    return S.query_documents(raw_collection(fx), {"source_type": "opcua", "asset_id": "asset_3"}, limit=None)


@register("doc_filter_gt", """
SELECT offset_id, source_type, asset_id, timestamp, quality, value AS value_deg,
  round(TRY_CAST(value AS DOUBLE) * 0.0174533, 6) AS value_rad, unit
FROM readings WHERE TRY_CAST(value AS DOUBLE) > 90
""", ["readings"])
def doc_filter_gt(fx):
    out = S.query_documents(nested_collection(fx), {"data.value_deg": {"$gt": 90}}, limit=None)
    return out.select("offset_id", "source_type", "asset_id", "timestamp", "quality",
                      F.col("data.value_deg").alias("value_deg"), F.col("data.value_rad").alias("value_rad"), "unit")


TIER2 = {
    "$or": [{"quality": {"$in": ["bad", None]}}, {"unit": {"$exists": False}}],
    "value": {"$nin": ["READY", "true"]},
    "asset_id": {"$regex": "^ASSET_1", "$options": "i"},
    "source_type": {"$ne": "mqtt"},
    "$nor": [{"value": {"$lt": 1}}],
}


@register("doc_filter_tier2", f"""
SELECT {COLS} FROM readings
WHERE (quality = 'bad' OR quality IS NULL OR unit IS NULL)
  AND (value IS NULL OR value NOT IN ('READY', 'true'))
  AND coalesce(regexp_matches(asset_id, '(?i)^ASSET_1'), false)
  AND source_type IS DISTINCT FROM 'mqtt'
  AND NOT coalesce(TRY_CAST(value AS DOUBLE) < 1, false)
""", ["readings"])
def doc_filter_tier2(fx):
    return S.query_documents(raw_collection(fx), TIER2, limit=None)


@register("doc_filter_default", """
SELECT least(100, count(*)) AS n_returned, CAST(0 AS BIGINT) AS n_others FROM readings WHERE quality = 'good'
""", ["readings"])
def doc_filter_default(fx):
    """The store's default limit: how many of the matches are returned, and how many rows that are none."""
    got = S.query_documents(raw_collection(fx), {"quality": "good"})
    others = got.join(fx.readings().where("quality = 'good'").select("offset_id"), "offset_id", "left_anti")
    return got.agg(F.count(F.lit(1)).alias("n_returned")).join(others.agg(F.count(F.lit(1)).alias("n_others")))


@register("processed_messages", f"""
SELECT CAST(offset_id AS VARCHAR) AS key, to_json({{'offset_id': offset_id, 'source_type': source_type, 'asset_id': asset_id,
  'timestamp': timestamp, 'quality': quality, 'value': value, 'unit': unit}}) AS value FROM ({DEPLOYED_SQL})
""", ["readings"])
def processed_messages(fx):
    """Processed readings as JSON messages keyed by their id (message sink)."""
    from ..streaming.chain import to_json_messages
    return to_json_messages(processed_collection(fx).select(*COLS.split(", ")), key_cols=["offset_id"])


@register("random_doc_ids", """
SELECT count(*) AS n_documents, count(*) AS n_ids, 36 AS id_length FROM readings
""", ["readings"])
def random_doc_ids(fx):
    """Random document ids: as many as documents, all of the length of a UUID."""
    d = S.with_doc_id(fx.readings())
    return d.agg(F.count("*").alias("n_documents"), F.count_distinct("_id").alias("n_ids"), F.max(F.length("_id")).alias("id_length"))


@register("appended_collection", "SELECT * FROM readings", ["readings"])
def appended_collection(fx):
    """Documents inserted in two batches, read back without their ids."""
    path = scratch_path(fx.spark, "runs", f"append-{uuid.uuid4().hex[:12]}")
    r = S.with_doc_id(fx.readings())
    bad = F.coalesce(F.col("quality") == "bad", F.lit(False))
    S.append(r.where(~bad), path)
    S.append(r.where(bad), path)
    return S.scan(fx.spark.read.parquet(path))
