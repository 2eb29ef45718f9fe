"""Stateful streaming operators: interval sampling with late readings, RPC
timeouts, and an idempotent document sink.  (Change detection: ``keyed``.)"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.store import with_doc_id
from .keyed import stream_folder


EPOCH = "1970-01-01 00:00:00"


def _micros(ts: str, ntz: bool):
    """Microseconds since the epoch; of a naive time as it stands, whatever the session's zone is."""
    return F.timestamp_diff("MICROSECOND", F.lit(EPOCH).cast("timestamp_ntz"), F.col(ts)) if ntz else F.unix_micros(F.col(ts))


def _windows_of(ts: str, ntz: bool, secs: int):
    """(start, end) of the tumbling window of a time."""
    micros = _micros(ts, ntz)
    start = micros - F.pmod(micros, F.lit(secs * 1_000_000))
    if ntz:
        epoch = F.lit(EPOCH).cast("timestamp_ntz")
        return F.timestamp_add("MICROSECOND", start, epoch), F.timestamp_add("MICROSECOND", start + secs * 1_000_000, epoch)
    return F.timestamp_micros(start), F.timestamp_micros(start + secs * 1_000_000)


def sampled_sink(readings: DataFrame, path: str, checkpoint: str, interval_ms: int, delay_s: int = 600, key: str = "asset_id", value: str = "value",
                 ts: str = "event_time", tiebreak: str = "offset_id", fmt: str = "parquet", available_now: bool = True):
    """Sample a stream by tumbling windows and lose no reading.

    The watermark of a micro-batch is the newest time of all earlier ones less ``delay_s``.  A reading whose window ends at or
    before it is late: it goes whole to ``late``, and is merged into its window all the same.  Each micro-batch N
    writes partial windows (``windows``), its late readings and the newest time so far (``marks``) to folders
    ``batch_id=N`` of its stream, so a replayed batch replaces itself.  ``sampled_windows`` merges the partial windows,
    ``close_windows`` ends the stream.  Readings without a time are in no window."""
    if interval_ms < 1000:
        raise ValueError("interval_ms must be at least 1000 (whole seconds)")
    own = os.path.join(path, stream_folder(checkpoint))
    ntz = dict(readings.dtypes)[ts] == "timestamp_ntz"
    start, end = _windows_of(ts, ntz, interval_ms // 1000)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        top = spark.read.format(fmt).load(os.path.join(own, "marks", f"batch_id={batch_id - 1}")).first()[0] if batch_id else None
        newest = F.lit(top).cast("long")
        late = F.coalesce(_micros("window_end", ntz) <= newest - int(delay_s) * 1_000_000, F.lit(False))
        rows = batch.where(F.col(ts).isNotNull()).withColumns({"window_start": start, "window_end": end}).withColumn("_late", late).persist()
        try:
            parts = rows.groupBy(key, "window_start", "window_end").agg(
                F.max(F.struct(F.col(ts).alias("time"), F.col(tiebreak).alias("tie"), F.col(value).alias("value"))).alias("last"),
                F.count(F.lit(1)).alias("n_readings"), F.count_if("_late").alias("n_late"))
            for name, df in (("windows", parts), ("late", rows.where("_late").select(*batch.columns, "window_start", "window_end")),
                             ("marks", rows.agg(F.greatest(F.max(_micros(ts, ntz)), newest).alias("newest")))):
                df.write.mode("overwrite").format(fmt).save(os.path.join(own, name, f"batch_id={batch_id}"))
        finally:
            rows.unpersist()

    w = readings.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()


def sampled_windows(spark, path: str, checkpoint: str, key: str = "asset_id", value: str = "value", delay_s: int = 600, fmt: str = "parquet") -> DataFrame:
    """Every window so far: ``key, window_start, window_end, value`` (the last reading's), ``n_readings, n_late`` and ``closed``
    (the watermark has passed it)."""
    own = os.path.join(path, stream_folder(checkpoint))
    parts = spark.read.format(fmt).load(os.path.join(own, "windows"))
    newest = spark.read.format(fmt).load(os.path.join(own, "marks")).agg(F.max("newest")).first()[0]
    out = parts.groupBy(key, "window_start", "window_end").agg(F.max("last").alias("last"), F.sum("n_readings").alias("n_readings"), F.sum("n_late").alias("n_late"))
    end = _micros("window_end", dict(parts.dtypes)["window_end"] == "timestamp_ntz")
    closed = F.coalesce(end <= F.lit(newest).cast("long") - int(delay_s) * 1_000_000, F.lit(False))
    return out.select(key, "window_start", "window_end", F.col("last.value").alias(value), "n_readings", "n_late", closed.alias("closed"))


def late_readings(spark, path: str, checkpoint: str, fmt: str = "parquet") -> DataFrame:
    """Readings that came after their window was closed."""
    return spark.read.format(fmt).load(os.path.join(path, stream_folder(checkpoint), "late")).drop("batch_id")


def close_windows(spark, path: str, checkpoint: str, fmt: str = "parquet", **kw) -> DataFrame:
    """End of the stream: all its windows, open ones too, written once as ``closed``; a second call writes the same."""
    target = os.path.join(path, stream_folder(checkpoint), "closed")
    sampled_windows(spark, path, checkpoint, fmt=fmt, **kw).drop("closed").write.mode("overwrite").format(fmt).save(target)
    return spark.read.format(fmt).load(target)


def rpc_stream(requests: DataFrame, responses: DataFrame, timeout_s: int = 300, delay: str = "0 seconds", heartbeats: DataFrame | None = None) -> DataFrame:
    """Stream-stream left outer join: ``ok`` or ``error`` for a request answered within the timeout, ``timeout`` for
    any other once the watermark passes it.

    The watermark follows the traffic of both sides; ``heartbeats`` (``beat_at``) are times that move it on when
    there is none, so that the last requests of a quiet evening time out too.  They are in neither result nor join."""
    # rows without an id, and heartbeats, have keys that match nothing: with a null key they would be filtered out before they move the watermark
    known = F.concat(F.lit("id:"), F.col("id").cast("string"))
    q = requests.withColumns({"_key": F.coalesce(known, F.lit("request without id")), "_beat": F.lit(False)})
    r = responses.select(F.coalesce(known, F.lit("response without id")).alias("_rid"), "recv_at", "error_code")
    if heartbeats is not None:
        # of the time, not a constant: in a micro-batch of beats alone the join of two constants would be planned away, watermark and all
        beat = lambda side: F.concat(F.lit(f"{side} beat "), F.col("beat_at").cast("string"))
        q = q.unionByName(heartbeats.select(F.col("beat_at").alias("sent_at"), beat("request").alias("_key"), F.lit(True).alias("_beat")), allowMissingColumns=True)
        r = r.unionByName(heartbeats.select(beat("response").alias("_rid"), F.col("beat_at").alias("recv_at")), allowMissingColumns=True)
    q, r = q.withWatermark("sent_at", delay), r.withWatermark("recv_at", delay)
    cond = (F.col("_key") == F.col("_rid")) & (F.col("recv_at") >= F.col("sent_at")) & \
           (F.col("recv_at") <= F.col("sent_at") + F.expr(f"INTERVAL {int(timeout_s)} SECONDS"))
    # the condition on both sides keeps the filter above the join
    j = q.join(r, cond, "leftOuter").where(F.when(F.col("recv_at").isNull(), ~F.col("_beat")).otherwise(True))
    status = F.when(F.col("recv_at").isNull(), "timeout").when(F.col("error_code").isNotNull(), "error").otherwise("ok")
    return j.drop("_rid", "_key", "_beat").withColumn("status", status)


def document_sink(df: DataFrame, collection_path: str, checkpoint: str, namespace: str,
                  key_cols: list[str], fmt: str = "parquet", available_now: bool = True,
                  dedupe_on: str | None = None, dedupe_delay: str = "10 minutes"):
    """Continuous append of a stream into a collection.  Document ids are a
    hash of (namespace, key columns), and each micro-batch overwrites only
    its own ``stream=S/batch_id=N`` folder, S being a hash of namespace and
    checkpoint: a replayed batch replaces itself instead of duplicating
    documents, and streams that share a collection, or a redeployment with a
    new checkpoint, never overwrite one another."""
    stream = hashlib.sha256(f"{namespace}\x01{checkpoint}".encode()).hexdigest()[:16]

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        docs = with_doc_id(batch, deterministic_from=key_cols, namespace=namespace)
        docs.write.mode("overwrite").format(fmt).save(os.path.join(collection_path, f"stream={stream}", f"batch_id={batch_id}"))

    if dedupe_on:
        # drop redelivered messages (same key) that arrive within the delay
        df = df.withWatermark(dedupe_on, dedupe_delay).dropDuplicatesWithinWatermark(key_cols)
    w = df.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()
