"""Queries over message sources: JSON parsing, envelopes, captured payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import messages as M
from .registry import register

CLOCK = "2024-02-01T00:00:00.000Z"   # fixed processing clock for envelope tests
MQTT_FILTER = "plant/+/click"
HTTP_PATH = "/ingest/purchase"


def captured_mqtt(fx):
    """Landing table of MQTT messages (topic + payload) from ``events``."""
    e = fx.events
    topic = F.concat(F.lit("plant/line"), (F.col("user_id") % 4).cast("string"), F.lit("/"), F.col("event_type"))
    return e.select("event_id", "ts", topic.alias("topic"), F.col("props").alias("payload"))


def captured_http(fx):
    e = fx.events
    return e.select("event_id", "ts", F.concat(F.lit("/ingest/"), F.col("event_type")).alias("path"),
                    F.when(F.col("event_id") % 4 == 0, "GET").otherwise("POST").alias("method"),
                    F.col("props").alias("body"))


ISO_MS_SQL = "strftime({c}, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"
ISO_PY_SQL = ("CASE WHEN {c} IS NULL THEN NULL WHEN strftime({c}, '%f') = '000000' THEN strftime({c}, '%Y-%m-%dT%H:%M:%S') "
              "ELSE strftime({c}, '%Y-%m-%dT%H:%M:%S.%f') END")


@register("json_readings", """
SELECT offset_id, json_extract_string(value, '$.source_type') AS source_type, json_extract_string(value, '$.asset_id') AS asset_id,
  json_extract_string(value, '$.timestamp') AS timestamp, json_extract_string(value, '$.quality') AS quality,
  json_extract_string(value, '$.value') AS value, json_extract_string(value, '$.unit') AS unit
FROM raw_messages WHERE json_valid(value)
""", ["raw_messages"])
def json_readings(fx):
    good, _ = M.split_readings(fx.raw_messages())
    return good


@register("json_rejects", "SELECT offset_id, value AS raw_value FROM raw_messages WHERE NOT json_valid(value)",
          ["raw_messages"])
def json_rejects(fx):
    _, rejects = M.split_readings(fx.raw_messages())
    return rejects


@register("envelope_opcua", f"""
SELECT offset_id, CAST(json_object('source_type', 'opcua', 'asset_id', asset_id,
  'timestamp', {ISO_PY_SQL.format(c="TRY_CAST(timestamp AS TIMESTAMP)")}, 'quality', 'good', 'value', value, 'unit', NULL) AS VARCHAR) AS message
FROM readings
""", ["readings"])
def envelope_opcua(fx):
    r = fx.readings().withColumn("ts", F.col("timestamp").try_cast("timestamp_ntz"))
    return M.opcua_envelope(r, keep=["offset_id"], with_key=False)


@register("envelope_kafka", f"""
SELECT offset_id, 'opcua' AS source_type, coalesce(nullif(asset_id, ''), 'unknown') AS asset_id,
  '{CLOCK}' AS timestamp, value AS data, nullif(unit, '') AS unit, coalesce(nullif(quality, ''), 'good') AS quality,
  CAST(json_object('source_type', 'opcua', 'asset_id', coalesce(nullif(asset_id, ''), 'unknown'), 'timestamp', '{CLOCK}',
    'data', value, 'unit', nullif(unit, ''), 'quality', coalesce(nullif(quality, ''), 'good')) AS VARCHAR) AS message
FROM readings
""", ["readings"])
def envelope_kafka(fx):
    env = M.kafka_envelope(fx.readings(), "opcua", topic="asset_id", payload="value", now=CLOCK, keep=["offset_id"])
    return M.to_message(env, ["source_type", "asset_id", "timestamp", "data", "unit", "quality"])


@register("envelope_other", f"""
SELECT offset_id, '{CLOCK}' AS timestamp, coalesce(nullif(asset_id, ''), 'unknown') AS source, value AS readings
FROM readings
""", ["readings"])
def envelope_other(fx):
    return M.other_envelope(fx.readings(), topic="asset_id", payload="value", now=CLOCK, keep=["offset_id"])


@register("mqtt_topic", f"""
SELECT event_id, 'mqtt' AS source_type, topic AS asset_id, {ISO_MS_SQL.format(c="ts")} AS timestamp, props AS data,
  CAST(NULL AS VARCHAR) AS unit, 'good' AS quality
FROM (SELECT *, 'plant/line' || CAST(user_id % 4 AS VARCHAR) || '/' || event_type AS topic FROM events)
WHERE regexp_full_match(topic, 'plant/[^/]*/click')
""")
def mqtt_topic(fx):
    msgs = M.mqtt_messages(captured_mqtt(fx), MQTT_FILTER)
    return M.kafka_envelope(msgs, "mqtt", topic="topic", payload="payload", unit=None, quality=None,
                            now=M.iso_utc_millis("ts"), keep=["event_id"])


@register("modbus_registers", f"""
SELECT event_id, CAST(address AS INTEGER) AS address, 'modbus' AS source_type, 'hr' || CAST(address AS VARCHAR) AS asset_id,
  {ISO_MS_SQL.format(c="ts")} AS timestamp, 'good' AS quality, CAST(reg AS VARCHAR) AS value, CAST(NULL AS VARCHAR) AS unit
FROM (SELECT event_id, ts, unnest(generate_series(0, 9)) AS address, unnest([r0, r1, r2, r3, r4, r5, r6, r7, r8, r9]) AS reg FROM modbus_polls)
""", ["modbus_polls"])
def modbus_registers(fx):
    regs = M.modbus_registers(fx.modbus_polls(), [f"r{i}" for i in range(10)])
    return regs.select("event_id", "address", F.lit("modbus").alias("source_type"),
                       F.concat(F.lit("hr"), F.col("address").cast("string")).alias("asset_id"),
                       M.iso_utc_millis("ts").alias("timestamp"), F.lit("good").alias("quality"),
                       F.col("register_value").cast("string").alias("value"),
                       F.lit(None).cast("string").alias("unit"))


@register("http_bodies", f"""
SELECT event_id, 'http' AS source_type, 'unknown' AS asset_id, {ISO_MS_SQL.format(c="ts")} AS timestamp, props AS data,
  CAST(NULL AS VARCHAR) AS unit, 'good' AS quality
FROM events WHERE '/ingest/' || event_type = '{HTTP_PATH}' AND event_id % 4 <> 0
""")
def http_bodies(fx):
    reqs = M.http_bodies(captured_http(fx), HTTP_PATH)
    return M.kafka_envelope(reqs, "http", topic=F.lit(None).cast("string"), payload="body", unit=None,
                            quality=None, now=M.iso_utc_millis("ts"), keep=["event_id"])


@register("tcp_lines", f"""
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, 'tcp' AS source_type, 'unknown' AS asset_id, '{CLOCK}' AS timestamp, line AS data,
  CAST(NULL AS VARCHAR) AS unit, 'good' AS quality
FROM (SELECT doc_id, unnest(generate_series(1, len(parts))) AS line_no, unnest(parts) AS line
      FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))
""")
def tcp_lines(fx):
    lines = M.tcp_lines(fx.documents)
    return M.kafka_envelope(lines, "tcp", topic=F.lit(None).cast("string"), payload="line", unit=None,
                            quality=None, now=CLOCK, keep=["doc_id", "line_no"])


@register("union_sources", f"""
SELECT 'r' || CAST(offset_id AS VARCHAR) AS msg_id, source_type, asset_id, timestamp, quality, value, unit FROM readings
UNION ALL
SELECT 'm' || CAST(event_id AS VARCHAR), 'mqtt', topic, {ISO_MS_SQL.format(c="ts")}, 'good', props, CAST(NULL AS VARCHAR)
FROM (SELECT *, 'plant/line' || CAST(user_id % 4 AS VARCHAR) || '/' || event_type AS topic FROM events)
WHERE regexp_full_match(topic, 'plant/[^/]*/click')
""", ["readings"])
def union_sources(fx):
    """Readings of two bridges (typed value vs flow ``data``) in one schema."""
    r = fx.readings().select(F.concat(F.lit("r"), F.col("offset_id").cast("string")).alias("msg_id"),
                             "source_type", "asset_id", "timestamp", "quality", "value", "unit")
    m = mqtt_topic(fx).select(F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("msg_id"),
                              "source_type", "asset_id", "timestamp", "data", "unit", "quality")
    return M.union_readings(r, m).select("msg_id", "source_type", "asset_id", "timestamp", "quality",
                                         "value", "unit")
