"""Queries over the readings stream: steps, chains, envelopes, parsing."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..operators import readings as R
from .registry import register

RAD_SQL = "round(TRY_CAST(value AS DOUBLE) * 0.0174533, 6)"


@register("cleanse", "SELECT * FROM readings WHERE quality <> 'bad'", ["readings"])
def cleanse(fx):
    return R.preprocess(fx.readings(), cleansing=True).df


@register("null_checks", """
SELECT * FROM readings WHERE quality <> 'bad' AND asset_id IS NOT NULL AND value IS NOT NULL
""", ["readings"])
def null_checks(fx):
    schema = {"asset_id": "VARCHAR", "value": "VARCHAR"}
    return R.preprocess(fx.readings(), cleansing=True, source_schema=schema).df


@register("impute", """
SELECT offset_id, source_type, asset_id, timestamp, COALESCE(quality, 'imputed') AS quality,
  COALESCE(value, '0.0') AS value, COALESCE(unit, 'unknown') AS unit FROM readings
""", ["readings"])
def impute(fx):
    return R.preprocess(fx.readings(), imputation=True).df


@register("normalize", """
SELECT offset_id, COALESCE(source_type, 'unknown') AS source_type, COALESCE(asset_id, 'unknown') AS asset_id,
  timestamp, quality, value, unit FROM readings
""", ["readings"])
def normalize(fx):
    return R.preprocess(fx.readings(), normalization=True).df


@register("transform", f"""
SELECT offset_id, source_type, asset_id, timestamp, quality, value AS value_deg, {RAD_SQL} AS value_rad, unit
FROM readings
""", ["readings"])
def transform(fx):
    return R.preprocess(fx.readings(), transformation=True).df


@register("chain_all", f"""
SELECT offset_id, COALESCE(source_type, 'unknown') AS source_type, COALESCE(asset_id, 'unknown') AS asset_id,
  timestamp, COALESCE(quality, 'imputed') AS quality, COALESCE(value, '0.0') AS value_deg,
  round(TRY_CAST(COALESCE(value, '0.0') AS DOUBLE) * 0.0174533, 6) AS value_rad, COALESCE(unit, 'unknown') AS unit
FROM readings WHERE quality <> 'bad'
""", ["readings"])
def chain_all(fx):
    return R.preprocess(fx.readings(), cleansing=True, imputation=True, normalization=True,
                        transformation=True).df


@register("chain_deployed", """
SELECT offset_id, COALESCE(source_type, 'unknown') AS source_type, COALESCE(asset_id, 'unknown') AS asset_id,
  timestamp, quality, value, unit FROM readings WHERE quality <> 'bad'
""", ["readings"])
def chain_deployed(fx):
    """The chain as deployed in the reference broker: cleansing + normalisation."""
    return R.preprocess(fx.readings(), cleansing=True, normalization=True).df


@register("per_asset_chain", """
SELECT r.offset_id, CASE WHEN f.normalize THEN COALESCE(r.source_type, 'unknown') ELSE r.source_type END AS source_type,
  r.asset_id, r.timestamp,
  CASE WHEN f.imputation THEN COALESCE(r.quality, 'imputed') ELSE r.quality END AS quality,
  CASE WHEN f.imputation THEN COALESCE(r.value, '0.0') ELSE r.value END AS value,
  CASE WHEN f.imputation THEN COALESCE(r.unit, 'unknown') ELSE r.unit END AS unit,
  CASE WHEN f.transformation THEN round(TRY_CAST(CASE WHEN f.imputation THEN COALESCE(r.value, '0.0') ELSE r.value END AS DOUBLE) * 0.0174533, 6) END AS value_rad
FROM readings r JOIN pipeline_flags f ON r.asset_id = f.asset_id
WHERE NOT f.cleansing OR r.quality <> 'bad'
""", ["readings", "pipeline_flags"])
def per_asset_chain(fx):
    """Each asset's flags select the steps for its readings (one plan)."""
    return R.preprocess_by_flags(fx.readings(), fx.asset_flags())


@register("unassigned_readings", "SELECT * FROM readings WHERE asset_id IS NULL OR CAST(substr(asset_id, 7) AS BIGINT) % 5 = 3", ["readings"])
def unassigned_readings(fx):
    """Readings that the per-asset chain does not process: no asset, or one without settings (every fifth here)."""
    configured = fx.asset_flags().where(F.substring("asset_id", 7, 20).cast("long") % 5 != 3)
    return R.unassigned(fx.readings(), configured)
