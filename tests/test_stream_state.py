"""Keyed state over many micro-batches, and the deployment registry."""

import datetime as dt
import os
import random
import uuid

import pytest

from helpers import bag, spark_bag

from sensorloom.session import commit_folder, scratch_path
from sensorloom.streaming import chain as CH
from sensorloom.streaming import keyed as KE
from sensorloom.streaming import registry as RG
from sensorloom.streaming import sources as SRC

SCHEMA = "asset_id string, value string, event_time timestamp_ntz, offset_id long, batch_id_in string"


def test_two_streams_of_ten_micro_batches_into_one_collection(spark):
    base = scratch_path(spark, "tests", f"keyed-{uuid.uuid4().hex}")
    rng = random.Random(3)
    want = []
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for s in "xy":
            last = {}
            for b in range(10):
                rows = [(rng.choice(["hot", "hot", "a", None, "quiet"] if b == 0 else ["hot", "hot", "a", None]), rng.choice(["1", "2", "NaN", None]),
                         rng.choice([None, dt.datetime(2024, 1, 1, 0, rng.randrange(60))]), 1000 * b + i, s) for i in range(30)]
                spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/{s}")
                for r in sorted(rows, key=lambda r: (r[2] is not None, r[2] or dt.datetime.min, r[3])):
                    if r[0] not in last or last[r[0]] != r[1]:
                        want.append(r)
                    last[r[0]] = r[1]
            stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{base}/{s}")
            q = KE.changes_sink(stream, f"{base}/out", f"{base}/ck-{s}")
            q.awaitTermination(300)
            assert q.exception() is None and len([p for p in q.recentProgress if p.numInputRows]) == 10
            # unchanged keys are not written again: no micro-batch updates more keys than it has
            for p in q.recentProgress[1:]:
                assert all(o.numRowsUpdated <= 3 for o in p.stateOperators)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    got = spark.read.parquet(f"{base}/out")
    assert len({r.stream for r in got.select("stream").distinct().collect()}) == 2
    got = got.drop("stream", "batch_id")
    assert spark_bag(got) == bag(got.columns, want)


def test_registry(spark):
    registry = scratch_path(spark, "tests", f"registry-{uuid.uuid4().hex}")
    topics = spark.createDataFrame([("in",), ("out",), ("out",)], "topic string")
    assert RG.deploy_one(spark, "in", "out", ["cleansing"], topics, registry)[1] == "deployed"
    first = RG.deployed(spark, registry).collect()
    assert RG.deploy_one(spark, "in", "out", ["cleansing"], topics, registry)[1] == "exists"
    assert RG.deployed(spark, registry).collect() == first
    assert RG.deploy_one(spark, "in", "out", ["imputation"], topics, registry)[1] == "deployed"
    for source, sink, why in (("gone", "out", "missing source"), ("in", "gone", "missing sink")):
        with pytest.raises(RG.DeploymentRefused, match=why):
            RG.deploy_one(spark, source, sink, [], topics, registry)
    assert RG.deployed(spark, registry).count() == 2
    odd = spark.createDataFrame([(None, "out", None), ("in", None, "x"), ("in", "out", None), ("in", "out", None)], "source string, sink string, steps string")
    assert sorted(r.status for r in RG.deploy(odd, topics, registry).collect()) == ["deployed", "missing sink", "missing source"]


def test_commit_never_overwrites(spark):
    base = scratch_path(spark, "tests", f"commit-{uuid.uuid4().hex}")
    for n in (1, 2):
        spark.range(n).write.parquet(os.path.join(base, "staged", str(n)))
    commit_folder(spark, os.path.join(base, "staged", "1"), os.path.join(base, "calls", "c"))
    with pytest.raises(Exception, match="FileAlreadyExists|exists"):
        commit_folder(spark, os.path.join(base, "staged", "2"), os.path.join(base, "calls", "c"))
    assert spark.read.parquet(os.path.join(base, "calls", "c")).count() == 1


def test_concurrent_calls_agree(spark):
    registry = scratch_path(spark, "tests", f"race-{uuid.uuid4().hex}")
    row = spark.createDataFrame([("d", "in", "out", "", "deployed", "c", 1)], RG.ENTRY)
    for call, at in (("late", 9), ("early", 3)):
        from pyspark.sql import functions as F
        row.withColumns({"call": F.lit(call), "called_at": F.lit(at).cast("long")}).write.parquet(os.path.join(registry, "calls", call))
    held = RG.deployed(spark, registry).collect()
    assert [(r.deployment, r.call) for r in held] == [("d", "early")]


def test_chain_asks_the_registry(spark, fx):
    base = scratch_path(spark, "tests", f"chain-{uuid.uuid4().hex}")
    fx.raw_messages().write.json(f"{base}/landing")
    topics = spark.createDataFrame([(f"{base}/landing",), (f"{base}/sink",)], "topic string")
    messages = SRC.json_messages(spark, f"{base}/landing")
    with pytest.raises(RG.DeploymentRefused):
        CH.start_chain(spark, messages, f"{base}/sink", {}, source_name="nowhere", registry=f"{base}/registry", topics=topics)
    counts = set()
    for _ in range(2):
        CH.start_chain(spark, messages, f"{base}/sink", {"cleansing": True}, source_name=f"{base}/landing", registry=f"{base}/registry",
                       topics=topics).awaitTermination(300)
        counts.add(spark.read.parquet(f"{base}/sink").count())
    assert len(counts) == 1 and RG.deployed(spark, f"{base}/registry").count() == 1


def test_last_value_takes_rows_as_they_are(spark):
    """A key's rows are plain rows; the state is asked once and written once."""
    from pyspark.sql import Row

    class State:
        calls, held = [], None

        def get(self):
            self.calls.append("get")
            return self.held

        def update(self, new):
            self.calls.append("update")
            self.held = new

    p = KE.LastValue("value", ["event_time", "offset_id"])
    p.last = State()
    at = lambda t, i, v: Row(event_time=t, offset_id=i, value=v)
    rows = [at(2, 5, "b"), at(1, 9, "a"), at(None, 7, None), at(1, 3, "a"), at(2, 6, None)]
    assert [r.offset_id for r in p.handleInputRows(("x",), iter(rows), None)] == [7, 3, 5, 6]
    assert p.last.held == (None,) and p.last.calls == ["get", "update"]
    assert [r.offset_id for r in p.handleInputRows(("x",), iter([at(3, 1, None), at(float("nan"), 2, "c")]), None)] == [2, 1]
    p.last.calls.clear()
    assert list(p.handleInputRows(("x",), iter([at(4, 1, None)]), None)) == [] and p.last.calls == ["get"]


def test_state_partitions_follow_the_rows(fx):
    n = fx.events.count()
    assert fx.tasks("events", rows=n) == 1 and fx.tasks("events", rows=10) == -(-n // 10)
