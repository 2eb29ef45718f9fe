"""Node tree materialised browse; streaming RPC timeout join."""

import os
import uuid

from pyspark.sql import functions as F

from helpers import spark_bag
from sensorloom.operators import audit as AU
from sensorloom.operators import tree as TR
from sensorloom.session import scratch_path
from sensorloom.streaming import keyed as KE
from sensorloom.streaming import stateful as ST


def test_materialized_browse_equals_plain(fx):
    nodes = fx.nodes()
    assert spark_bag(TR.browse(nodes)) == spark_bag(TR.browse(nodes, materialize=False))
    assert spark_bag(TR.browse(nodes, "ns=2;s=R1", descend="objects")) == \
        spark_bag(TR.browse(nodes, "ns=2;s=R1", max_depth=5, descend="objects", materialize=False))


def test_bridge_browse_has_no_depth_limit(spark):
    rows = [(None if i == 0 else f"n{i - 1}", f"n{i}", "x", "Variable" if i == 9 else "Object", "v") for i in range(10)]
    edges = spark.createDataFrame([*rows, ("n3", "n2", "again", "Object", "v")], "parent_id string, node_id string, name string, node_class string, value string")
    got = TR.browse(edges, descend="objects")
    assert [(r.node_id, r.depth) for r in TR.variables(got).collect()] == [("n9", 9)]
    assert got.count() == 10
    assert TR.browse(edges).agg(F.max("depth")).first()[0] == 5


def test_recursive_browse_equals_the_levels(spark, fx):
    edges = fx.nodes()
    for start, depth in ((None, 5), (None, 1), ("ns=2;s=R1", 2), ("none", 5)):
        assert spark_bag(TR.browse_lazy(edges, start, depth)) == spark_bag(TR.browse(edges, start, depth).select("parent_id", "node_id", "name", "node_class", "value", "depth"))
    ring = spark.createDataFrame([(None, "a", "x", "Object", None), ("a", "b", "x", "Object", "v"), ("b", "a", "x", "Object", None)],
                                 "parent_id string, node_id string, name string, node_class string, value string")
    assert [r.depth for r in TR.browse_lazy(ring).orderBy("depth").collect()] == [0, 1, 2, 3, 4, 5]


def test_rpc_stream_matches_batch_pairs(spark, fx):
    base = scratch_path(spark, "tests", f"rpc-{uuid.uuid4().hex}")
    req = fx.rpc_requests().withColumn("sent_at", F.col("sent_at").cast("timestamp"))
    resp = fx.rpc_responses().withColumn("recv_at", F.col("recv_at").cast("timestamp"))
    req.write.parquet(os.path.join(base, "req"))
    resp.write.parquet(os.path.join(base, "resp"))
    rs = spark.readStream.schema(req.schema).parquet(os.path.join(base, "req"))
    ps = spark.readStream.schema(resp.schema).parquet(os.path.join(base, "resp"))
    timeout = 30 * 86400
    out = ST.rpc_stream(rs, ps, timeout_s=timeout)
    q = (out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/ck")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = spark.read.parquet(f"{base}/out")
    batch = AU.rpc_pairs(req, resp, timeout_s=timeout)
    # every matched pair is emitted exactly as in batch; unmatched requests are
    # emitted as timeouts once the watermark passes (a subset at the end of input)
    matched = got.where(F.col("status") != "timeout")
    assert spark_bag(matched) == spark_bag(batch.where(F.col("status") != "timeout"))
    emitted_timeouts = got.where(F.col("status") == "timeout").select("id")
    assert emitted_timeouts.join(batch.where(F.col("status") == "timeout").select("id"), "id", "left_anti").count() == 0


def test_per_asset_chain_as_stream_static_join(spark, fx):
    from sensorloom.operators import readings as R
    from sensorloom.streaming import chain as CH
    from sensorloom.streaming import sources as SRC
    base = scratch_path(spark, "tests", f"perasset-{uuid.uuid4().hex}")
    landing = os.path.join(base, "landing")
    fx.raw_messages().write.json(landing)
    stream = CH.parsed_readings(SRC.json_messages(spark, landing))
    out = R.preprocess_by_flags(stream, fx.asset_flags())
    q = (out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/ck")
         .trigger(availableNow=True).start())
    q.awaitTermination(300)
    batch = R.preprocess_by_flags(CH.parsed_readings(spark.read.schema(SRC.MESSAGE).json(landing)), fx.asset_flags())
    assert spark_bag(spark.read.parquet(f"{base}/out")) == spark_bag(batch)


def test_stream_change_state_carries_across_micro_batches(spark, fx):
    """Four files written in offset order, one file per micro-batch: the
    per-asset state must carry the last value from batch to batch."""
    import time as _time

    from sensorloom.operators import timeseries as TS
    from sensorloom.streaming import chain as CH
    from sensorloom.streaming import sources as SRC
    base = scratch_path(spark, "tests", f"chg-{uuid.uuid4().hex}")
    landing = os.path.join(base, "landing")
    raw = fx.raw_messages()
    n = raw.count()
    for i in range(4):
        part = raw.where((F.col("offset_id") >= i * n // 4) & (F.col("offset_id") < (i + 1) * n // 4)).coalesce(1)
        part.write.mode("append").json(landing)
        _time.sleep(1.1)  # distinct modification times keep the file order
    stream = CH.parsed_readings(SRC.json_messages(spark, landing, max_files_per_trigger=1))
    q = KE.changes_sink(stream.withColumn("event_time", TS.event_time()), f"{base}/out", f"{base}/ck")
    q.awaitTermination(300)
    assert len(q.recentProgress) >= 4
    batch = CH.parsed_readings(spark.read.schema(SRC.MESSAGE).json(landing)).withColumn("event_time", TS.event_time())
    expected = TS.changes_only(batch)
    assert spark_bag(spark.read.parquet(f"{base}/out").drop("stream", "batch_id")) == spark_bag(expected)


def test_stream_sampling_keeps_late_readings(spark, fx):
    """Files of rising times but for some old readings in the last one: they are in the late table and in their windows."""
    from sensorloom.operators import timeseries as TS
    from sensorloom.streaming import chain as CH
    from sensorloom.streaming import sources as SRC
    base = scratch_path(spark, "tests", f"smp-{uuid.uuid4().hex}")
    landing = os.path.join(base, "landing")
    raw = fx.raw_messages()
    last = raw.agg(F.max("offset_id")).first()[0]
    back = (F.col("offset_id") % 37 == 5) & (F.col("offset_id") < last // 2)  # sent long ago, come last
    args = (spark, f"{base}/out", f"{base}/ck")
    for i, part in enumerate((raw.where(~back & (F.col("offset_id") < last // 2)), raw.where(F.col("offset_id") >= last // 2), raw.where(back))):
        part.write.mode("append").json(landing)
        stream = CH.parsed_readings(SRC.json_messages(spark, landing)).withColumn("event_time", TS.event_time())
        q = ST.sampled_sink(stream, f"{base}/out", f"{base}/ck", 3_600_000)
        q.awaitTermination(300)
        if i == 1:
            assert ST.sampled_windows(*args).where("closed").count() > 0
    batch = CH.parsed_readings(spark.read.schema(SRC.MESSAGE).json(landing)).withColumn("event_time", TS.event_time())
    expected = TS.sample_interval(batch, 3_600_000)
    for _ in range(2):  # closing twice gives the same
        closed = ST.close_windows(*args)
        assert spark_bag(closed.drop("n_late")) == spark_bag(expected.select("asset_id", "window_start", "window_end", "value", "n_readings"))
    late = ST.late_readings(*args)
    assert late.count() == closed.agg(F.sum("n_late")).first()[0] > 0
    assert late.where(~back).join(batch.agg(F.max("event_time").alias("m")), F.col("window_end") > F.col("m")).count() == 0


def test_stream_rpc_times_out_by_heartbeat(spark):
    import datetime as dt
    base = scratch_path(spark, "tests", f"beat-{uuid.uuid4().hex}")
    t0 = dt.datetime(2024, 1, 1)
    at = lambda s: t0 + dt.timedelta(seconds=s)
    req = spark.createDataFrame([(1, "a", at(0)), (2, "b", at(10)), (3, "c", at(20)), (None, "d", at(30))], "id long, method string, sent_at timestamp")
    resp = spark.createDataFrame([(1, at(5), None), (2, at(400), None), (3, at(320), -32601), (9, at(1), None)], "id long, recv_at timestamp, error_code int")
    req.write.parquet(f"{base}/req")
    resp.write.parquet(f"{base}/resp")
    beats = spark.createDataFrame([], "beat_at timestamp")
    beats.write.parquet(f"{base}/beat")

    def run():
        out = ST.rpc_stream(spark.readStream.schema(req.schema).parquet(f"{base}/req"), spark.readStream.schema(resp.schema).parquet(f"{base}/resp"),
                            heartbeats=spark.readStream.schema(beats.schema).parquet(f"{base}/beat"))
        out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/ck") \
            .trigger(availableNow=True).start().awaitTermination(300)
        return {(r.id, r.method): r.status for r in spark.read.parquet(f"{base}/out").collect()}

    assert run().get((1, "a")) == "ok"
    for s in (900, 1800):
        spark.createDataFrame([(at(s),)], "beat_at timestamp").write.mode("append").parquet(f"{base}/beat")
        got = run()
    assert got == {(1, "a"): "ok", (2, "b"): "timeout", (3, "c"): "error", (None, "d"): "timeout"}


def test_results_do_not_depend_on_session_time_zone(spark):
    from conftest import SF_SMALL

    from __spark_entry__ import queries
    names = ["stream_sampled", "sampled", "envelope_opcua", "mqtt_topic"]
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        base = {n: spark_bag(queries()[n](spark, SF_SMALL)) for n in names}
        spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")  # +05:30: not a whole hour
        for n in names:
            assert spark_bag(queries()[n](spark, SF_SMALL)) == base[n], n
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
