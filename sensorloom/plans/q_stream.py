"""Streaming queries: each lands ``raw_messages`` as JSON lines in a fresh
folder below the session's checkpoint folder, runs the streaming plan with
``availableNow`` and returns the sink read back (a batch DataFrame)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import timeseries as TS
from ..session import scratch_path
from ..streaming import chain as CH
from ..streaming import keyed as KE
from ..streaming import registry as RG
from ..streaming import sources as SRC
from ..streaming import stateful as ST
from .registry import register

DEPLOYED = {"cleansing": True, "normalization": True}

PARSED_SQL = """parsed AS (
  SELECT offset_id, json_extract_string(value, '$.source_type') AS source_type, json_extract_string(value, '$.asset_id') AS asset_id,
    json_extract_string(value, '$.timestamp') AS timestamp, json_extract_string(value, '$.quality') AS quality,
    json_extract_string(value, '$.value') AS value, json_extract_string(value, '$.unit') AS unit
  FROM raw_messages WHERE json_valid(value))"""
DEPLOYED_SQL = """SELECT offset_id, COALESCE(source_type, 'unknown') AS source_type, COALESCE(asset_id, 'unknown') AS asset_id,
  timestamp, quality, value, unit FROM parsed WHERE quality <> 'bad'"""


def _run_dir(fx, what: str) -> str:
    return scratch_path(fx.spark, "runs", f"{what}-{uuid.uuid4().hex[:12]}")


def land(fx, base: str) -> str:
    path = f"{base}/landing"
    fx.raw_messages().write.mode("error").json(path)
    return path


def _await(q):
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


def _readings_stream(fx, landing):
    msgs = SRC.json_messages(fx.spark, landing)
    return CH.parsed_readings(msgs)


@register("stream_chain", "WITH " + PARSED_SQL + "\n" + DEPLOYED_SQL, ["raw_messages"])
def stream_chain(fx):
    """Deployed chain (cleansing + normalisation) as one streaming query."""
    base = _run_dir(fx, "chain")
    landing = land(fx, base)
    q = CH.start_chain(fx.spark, SRC.json_messages(fx.spark, landing), f"{base}/sink", DEPLOYED,
                       source_name=landing, checkpoint=f"{base}/ckpt")
    _await(q)
    return fx.spark.read.parquet(f"{base}/sink")


def _two_batches(fx, streams: dict) -> None:
    """Land the messages of each stream (folder -> condition on them, start function) in two parts, and run the streams side by side over
    each part, with the same checkpoints."""
    for part in (0, 1):
        for base, (where, _) in streams.items():
            fx.raw_messages().where(f"(offset_id div 2) % 2 = {part} AND {where}").write.mode("append").json(f"{base}/landing")
        running = [start(_readings_stream(fx, f"{base}/landing").withColumn("event_time", TS.event_time())) for base, (_, start) in streams.items()]
        for q in running:
            _await(q)


@register("stream_changes", "WITH " + PARSED_SQL + """
SELECT offset_id, source_type, asset_id, timestamp, quality, value, unit FROM (
  SELECT *, LAG(value) OVER w AS prev, ROW_NUMBER() OVER w AS rn FROM parsed
  WINDOW w AS (PARTITION BY offset_id % 2, asset_id ORDER BY (offset_id // 2) % 2, TRY_CAST(timestamp AS TIMESTAMP) ASC NULLS FIRST, offset_id))
WHERE rn = 1 OR prev IS DISTINCT FROM value
""", ["raw_messages"])
def stream_changes(fx):
    """Change detection with one value of state per asset: two streams (even and odd messages), each over two
    micro-batches, into one collection."""
    base = _run_dir(fx, "changes")
    parts = max(4, fx.tasks("events", rows=500_000) // 2)  # of each of two streams that run side by side
    _two_batches(fx, {f"{base}/{s}": (f"offset_id % 2 = {s}", lambda r, s=s: KE.changes_sink(r, f"{base}/sink", f"{base}/{s}/ckpt", partitions=parts)) for s in (0, 1)})
    return fx.spark.read.parquet(f"{base}/sink").drop("event_time", "stream", "batch_id")


SAMPLED_SQL = """,
t AS (SELECT *, TRY_CAST(timestamp AS TIMESTAMP) AS event_time, (offset_id // 2) % 2 AS part, time_bucket(INTERVAL 1 HOUR, TRY_CAST(timestamp AS TIMESTAMP)) AS window_start
  FROM parsed WHERE TRY_CAST(timestamp AS TIMESTAMP) IS NOT NULL),
s AS (SELECT *, window_start + INTERVAL 1 HOUR AS window_end, part = 1 AND window_start + INTERVAL 1 HOUR <= (SELECT max(event_time) FROM t WHERE part = 0) - INTERVAL 10 MINUTE AS late FROM t)
"""


@register("stream_sampled", "WITH " + PARSED_SQL + SAMPLED_SQL + """
SELECT asset_id, window_start, window_end, max_by(value, (event_time, offset_id)) FILTER (WHERE rn = 1) AS value, count(*) AS n_readings, count(*) FILTER (WHERE late) AS n_late FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY asset_id, window_start ORDER BY event_time DESC, offset_id DESC) AS rn FROM s)
GROUP BY asset_id, window_start, window_end
""", ["raw_messages"])
def stream_sampled(fx):
    """Hourly samples over two micro-batches: every window of the input, with the number of late readings."""
    base = _run_dir(fx, "sampled")
    _two_batches(fx, {base: ("true", lambda r: ST.sampled_sink(r, f"{base}/out", f"{base}/ckpt", 3_600_000))})
    return ST.close_windows(fx.spark, f"{base}/out", f"{base}/ckpt")


@register("stream_late", "WITH " + PARSED_SQL + SAMPLED_SQL + """
SELECT offset_id, source_type, asset_id, timestamp, quality, value, unit, window_start FROM s WHERE late
""", ["raw_messages"])
def stream_late(fx):
    """Readings that came after their window was closed, in a table of their own."""
    base = _run_dir(fx, "late")
    _two_batches(fx, {base: ("true", lambda r: ST.sampled_sink(r, f"{base}/out", f"{base}/ckpt", 3_600_000))})
    return ST.late_readings(fx.spark, f"{base}/out", f"{base}/ckpt").drop("event_time", "window_end")


@register("stream_sink", "WITH " + PARSED_SQL + """
SELECT *, sha256(concat_ws(chr(1), 'processed', CAST(offset_id AS VARCHAR))) AS _id FROM (""" + DEPLOYED_SQL + ")",
          ["raw_messages"])
def stream_sink(fx):
    """Processed stream appended to a collection with replay-safe ids."""
    base = _run_dir(fx, "sink")
    landing = land(fx, base)
    from ..operators import readings as R
    processed = R.preprocess(_readings_stream(fx, landing), cleansing=True, normalization=True).df
    q = ST.document_sink(processed, f"{base}/collection", f"{base}/ckpt", "processed", ["offset_id"])
    _await(q)
    return fx.spark.read.parquet(f"{base}/collection").drop("stream", "batch_id")


@register("stream_rejects", "SELECT offset_id, value AS raw_value FROM raw_messages WHERE NOT json_valid(value)", ["raw_messages"])
def stream_rejects(fx):
    """Malformed messages of the stream, kept by a sink of their own."""
    base = _run_dir(fx, "rejects")
    bad = CH.rejected_messages(SRC.json_messages(fx.spark, land(fx, base)))
    q = (bad.writeStream.format("parquet").option("path", f"{base}/sink").option("checkpointLocation", f"{base}/ckpt")
         .outputMode("append").trigger(availableNow=True).start())
    _await(q)
    return fx.spark.read.parquet(f"{base}/sink")


@register("stream_taps", "WITH " + PARSED_SQL + """
SELECT 'cleansed' AS stage, offset_id, source_type, asset_id, timestamp, quality, value, unit FROM parsed WHERE quality <> 'bad'
UNION ALL SELECT 'processed', * FROM (""" + DEPLOYED_SQL + ")", ["raw_messages"])
def stream_taps(fx):
    """An intermediate stage materialised beside the processed readings, from the same micro-batches."""
    base = _run_dir(fx, "taps")
    _await(CH.start_chain(fx.spark, SRC.json_messages(fx.spark, land(fx, base)), f"{base}/processed", DEPLOYED,
                          taps={"cleansed": f"{base}/cleansed"}, checkpoint=f"{base}/ckpt"))
    out = [fx.spark.read.parquet(f"{base}/{name}").drop("stream", "batch_id").select(F.lit(name).alias("stage"), "*")
           for name in ("cleansed", "processed")]
    return out[0].unionByName(out[1])


@register("stream_readers", "WITH " + PARSED_SQL + """
SELECT 'deployed' AS chain, offset_id, source_type, asset_id, timestamp, quality, value, unit FROM (""" + DEPLOYED_SQL + """)
UNION ALL SELECT 'imputed', offset_id, source_type, asset_id, timestamp, coalesce(quality, 'imputed'), coalesce(value, '0.0'), coalesce(unit, 'unknown') FROM parsed
""", ["raw_messages"])
def stream_readers(fx):
    """Two chains that read the same topic, each with its own checkpoint; each is deployed twice, and the second
    deployment (same source, sink and steps, so the same checkpoint) adds nothing."""
    base = _run_dir(fx, "readers")
    landing = land(fx, base)
    out = None
    for name, flags in (("deployed", DEPLOYED), ("imputed", {"imputation": True})):
        for _ in range(2):
            _await(CH.start_chain(fx.spark, SRC.json_messages(fx.spark, landing), f"{base}/{name}", flags, source_name=landing))
        df = fx.spark.read.parquet(f"{base}/{name}").select(F.lit(name).alias("chain"), "*")
        out = df if out is None else out.unionByName(df)
    return out


@register("stream_rpc", """
WITH q AS (SELECT o_orderkey AS id, o_orderstatus AS method, CAST(o_orderdate AS TIMESTAMP) + to_seconds(o_orderkey % 86400) AS sent_at, o_orderdate FROM orders),
r AS (SELECT q.id, q.sent_at + to_seconds(5 * date_diff('day', CAST(o_orderdate AS DATE), CAST(min(l_shipdate) AS DATE))) AS recv_at, max(l_returnflag) = 'R' AS failed
  FROM q JOIN lineitem ON l_orderkey = q.id GROUP BY q.id, q.sent_at, o_orderdate)
SELECT q.id, method, CASE WHEN r.id IS NULL THEN 'timeout' WHEN failed THEN 'error' ELSE 'ok' END AS status
FROM q LEFT JOIN r ON r.id = q.id AND recv_at >= sent_at AND recv_at <= sent_at + INTERVAL 300 SECOND
""")
def stream_rpc(fx):
    """Requests answered within 300 s, with an error, or not at all: a heartbeat after the last message lets the open ones time out."""
    base = _run_dir(fx, "rpc")
    orders = fx.orders.select("o_orderkey", "o_orderstatus", "o_orderdate", F.timestamp_add("SECOND", F.col("o_orderkey") % 86400, F.col("o_orderdate").cast("timestamp")).alias("sent_at"))
    ships = fx.lineitem.groupBy("l_orderkey").agg(F.min("l_shipdate").alias("ship"), F.max("l_returnflag").alias("flag"))
    answers = ships.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    sides = {"req": orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("method"), "sent_at"),
             "resp": answers.select(F.col("o_orderkey").alias("id"), F.timestamp_add("SECOND", 5 * F.date_diff(F.col("ship").cast("date"), F.col("o_orderdate").cast("date")), F.col("sent_at")).alias("recv_at"),
                                    F.when(F.col("flag") == "R", -32601).alias("error_code"))}
    beats = fx.spark.createDataFrame([], "beat_at timestamp")
    for name, df in {**sides, "beat": beats}.items():
        df.write.parquet(f"{base}/{name}")
    schemas = {"req": sides["req"].schema, "resp": sides["resp"].schema, "beat": beats.schema}

    def run():
        req, resp, beat = (fx.spark.readStream.schema(schemas[n]).parquet(f"{base}/{n}") for n in ("req", "resp", "beat"))
        out = ST.rpc_stream(req, resp, heartbeats=beat)
        _await(out.writeStream.format("parquet").option("path", f"{base}/sink").option("checkpointLocation", f"{base}/ckpt")
               .outputMode("append").trigger(availableNow=True).start())

    run()
    last = fx.spark.read.parquet(f"{base}/req").select("sent_at").union(fx.spark.read.parquet(f"{base}/resp").select("recv_at"))
    last.agg((F.max("sent_at") + F.expr("INTERVAL 1 DAY")).alias("beat_at")).write.mode("append").parquet(f"{base}/beat")
    run()
    return fx.spark.read.parquet(f"{base}/sink").select("id", "method", "status")


@register("deployments", """
WITH r AS (SELECT 'opcua.s' || s_suppkey || '.raw' AS source, CASE WHEN s_suppkey % 5 = 0 THEN 'nowhere' ELSE 'opcua.s' || s_suppkey || '.processed' END AS sink, s_suppkey FROM supplier
  UNION ALL SELECT 'absent.s' || s_suppkey, 'opcua.s' || s_suppkey || '.processed', s_suppkey FROM supplier),
t AS (SELECT c, source, sink, CASE WHEN source LIKE 'absent%' THEN 'missing source' WHEN sink = 'nowhere' OR s_suppkey % 3 = 0 THEN 'missing sink'
  WHEN c = 2 AND s_suppkey % 2 = 0 THEN 'exists' ELSE 'deployed' END AS status FROM r, (SELECT unnest([1, 2]) AS c) WHERE c = 2 OR s_suppkey % 2 = 0)
SELECT c AS call, source, sink, 'cleansing,normalization' AS steps, status FROM t
""", ["topics"])
def deployments(fx):
    """Two calls to the registry: the second asks again for what the first deployed, and for more; missing topics are refused."""
    registry = _run_dir(fx, "registry")
    key = F.col("s_suppkey").cast("string")
    own = F.concat(F.lit("opcua.s"), key, F.lit(".processed"))
    asked = fx.supplier.select("s_suppkey", F.concat(F.lit("opcua.s"), key, F.lit(".raw")).alias("source"), F.when(F.col("s_suppkey") % 5 == 0, "nowhere").otherwise(own).alias("sink")) \
        .unionByName(fx.supplier.select("s_suppkey", F.concat(F.lit("absent.s"), key).alias("source"), own.alias("sink")))
    asked = asked.withColumn("steps", F.lit("cleansing,normalization"))
    out = [RG.deploy(asked.where(part), fx.topics(), registry) for part in ("s_suppkey % 2 = 0", "true")]
    return out[0].withColumn("call", F.lit(1)).unionByName(out[1].withColumn("call", F.lit(2))).drop("deployment")
