"""Message sources: JSON readings, protocol envelopes and captured payloads.

All of these are per-row projections (no shuffle); they run unchanged on a
batch table or a streaming DataFrame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql import types as T

from ..schemas import READING, READING_FIELDS

# Fixed values of the reference envelopes.
OPCUA = "opcua"
GOOD = "good"
UNKNOWN = "unknown"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def falsy_default(c, default) -> Column:
    """JavaScript ``x || default`` for text: NULL and '' take the default."""
    return F.coalesce(F.nullif(_col(c), F.lit("")), F.lit(default) if not isinstance(default, Column) else default)


def iso_utc_millis(ts) -> Column:
    """``Date.toISOString()``: millisecond precision and a ``Z`` suffix."""
    return F.date_format(_col(ts), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def iso_python(ts) -> Column:
    """``datetime.isoformat()`` of a naive timestamp: fraction only when
    the microseconds are not zero."""
    t = _col(ts)
    base = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    frac = F.date_format(t, "SSSSSS")
    return F.when(t.isNull(), F.lit(None).cast("string")) \
            .when(frac == "000000", base).otherwise(F.concat(base, F.lit("."), frac))


# -- SRC-1 / SRC-2 --------------------------------------------------------

CORRUPT = "_corrupt_record"
_READING_WITH_CORRUPT = T.StructType(READING.fields + [T.StructField(CORRUPT, T.StringType())])


def parse_readings(raw: DataFrame, value_col: str = "value", keep=("offset_id",)) -> DataFrame:
    """JSON text -> six string columns plus ``_malformed``.

    Missing fields are NULL, extra fields are ignored, numbers and booleans
    keep their JSON text.  One parse: PERMISSIVE ``from_json`` puts the raw
    text of an unparsable message into a corrupt-record field.  A message
    that is valid JSON but not an object (no reading) is malformed too; a
    NULL message (tombstone) gives a row of NULLs."""
    v = F.col(value_col)
    parsed = F.from_json(v, _READING_WITH_CORRUPT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    # The parsed struct comes out of a one-element ``explode``: a filter on a
    # generator's output cannot be pushed below the generator, so the good /
    # reject filters do not copy ``from_json`` into a pushed-down Filter and
    # every message is parsed exactly once.
    p = raw.select(*keep, v.alias("_raw"), F.explode(F.array(parsed)).alias("_p"))
    bad = F.col(f"_p.{CORRUPT}").isNotNull() | (F.col("_raw").isNotNull() & F.col("_p").isNull())
    return p.select(*keep, *[F.col(f"_p.{f}").alias(f) for f in READING_FIELDS], bad.alias("_malformed"), "_raw")


def split_readings(raw: DataFrame, value_col: str = "value", keep=("offset_id",)):
    """(good readings, rejects) — rejects carry the raw text for the
    processing log.  One scan feeds both when the parsed frame is reused."""
    p = parse_readings(raw, value_col, keep)
    good = p.where(~F.col("_malformed")).drop("_malformed", "_raw")
    rejects = p.where(F.col("_malformed")).select(*keep, F.col("_raw").alias("raw_value"))
    return good, rejects


# -- SRC-3: change-notification envelope -----------------------------------

def opcua_envelope(df: DataFrame, asset_col: str = "asset_id", ts_col: str = "ts",
                   value_col: str = "value", keep=(), with_key: bool = True) -> DataFrame:
    """One JSON message per value change; key is a random UUID."""
    msg = F.struct(F.lit(OPCUA).alias("source_type"), _col(asset_col).cast("string").alias("asset_id"),
                   iso_python(ts_col).alias("timestamp"), F.lit(GOOD).alias("quality"),
                   _col(value_col).cast("string").alias("value"),
                   F.lit(None).cast("string").alias("unit"))
    cols = [*keep, F.to_json(msg, {"ignoreNullFields": "false"}).alias("message")]
    if with_key:
        cols.insert(0, F.expr("uuid()").alias("key"))
    return df.select(*cols)


# -- PRJ-1 / PRJ-2: flow envelopes ------------------------------------------

def kafka_envelope(df: DataFrame, protocol: str, *, topic="topic", payload="payload", unit="unit",
                   quality="quality", now=None, keep=()) -> DataFrame:
    """Kafka-target envelope.  ``now`` is the clock (a Column or ISO text);
    default is the processing time."""
    now_c = iso_utc_millis(F.current_timestamp()) if now is None else (
        now if isinstance(now, Column) else F.lit(now))
    unit_c = F.nullif(_col(unit), F.lit("")) if unit is not None else F.lit(None).cast("string")
    qual_c = falsy_default(quality, GOOD) if quality is not None else F.lit(GOOD)
    fields = [F.lit(protocol).alias("source_type"), falsy_default(topic, UNKNOWN).alias("asset_id"),
              now_c.alias("timestamp"), _col(payload).alias("data"), unit_c.alias("unit"),
              qual_c.alias("quality")]
    return df.select(*keep, *fields)


def to_message(df: DataFrame, cols, name: str = "message") -> DataFrame:
    """Add a JSON text column of ``cols`` (nulls written as null)."""
    return df.withColumn(name, F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}))


def other_envelope(df: DataFrame, *, topic="topic", payload="payload", now=None, keep=()) -> DataFrame:
    """Envelope for non-Kafka targets: ``{timestamp, source, readings}``."""
    now_c = iso_utc_millis(F.current_timestamp()) if now is None else (
        now if isinstance(now, Column) else F.lit(now))
    return df.select(*keep, now_c.alias("timestamp"), falsy_default(topic, UNKNOWN).alias("source"),
                     _col(payload).alias("readings"))


# -- SRC-4..7: captured protocol payloads -----------------------------------

def mqtt_filter_regex(topic_filter: str) -> str:
    """MQTT subscription filter -> anchored regex (``+`` one level, ``#`` rest)."""
    import re
    parts = []
    levels = topic_filter.split("/")
    for i, lv in enumerate(levels):
        if lv == "#":
            if i != len(levels) - 1:
                raise ValueError("'#' must be the last level of an MQTT filter")
            parts.append(None)
            break
        parts.append("[^/]*" if lv == "+" else re.escape(lv))
    if parts and parts[-1] is None:
        head = "/".join(parts[:-1])
        return "^" + (head + "(/.*)?" if head else ".*") + "$"
    return "^" + "/".join(parts) + "$"


def mqtt_messages(captured: DataFrame, topic_filter: str, topic="topic") -> DataFrame:
    """Captured MQTT messages matching a subscription filter."""
    return captured.where(_col(topic).rlike(mqtt_filter_regex(topic_filter)))


def modbus_registers(polls: DataFrame, registers, keep=("event_id", "ts"), start_address: int = 0) -> DataFrame:
    """One reading per holding register of each poll (address = position)."""
    arr = F.array(*[_col(r) for r in registers])
    return polls.select(*keep, F.posexplode(arr).alias("pos", "reg")).select(
        *keep, (F.col("pos") + start_address).alias("address"), F.col("reg").alias("register_value"))


def http_bodies(requests: DataFrame, path: str, path_col="path", method_col="method") -> DataFrame:
    """Captured HTTP requests accepted by an ``http in`` node (POST on path)."""
    return requests.where((_col(path_col) == path) & (F.lower(_col(method_col)) == "post"))


def tcp_lines(chunks: DataFrame, text_col="text", keep=("doc_id",)) -> DataFrame:
    """UTF-8 text stream -> one row per line (1-based line number)."""
    return chunks.select(*keep, F.posexplode(F.split(_col(text_col), "\n", -1)).alias("pos", "line")) \
                 .select(*keep, (F.col("pos") + 1).alias("line_no"), "line")


def union_readings(*frames: DataFrame) -> DataFrame:
    """Readings of several bridges into one schema; flow envelopes carry
    the payload under ``data``, so ``value = coalesce(value, data)``."""
    out = None
    for f in frames:
        if "data" in f.columns:
            data = F.col("data").cast("string")
            value = F.coalesce(F.col("value"), data) if "value" in f.columns else data
            f = f.withColumn("value", value).drop("data")
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out
