"""Bucketed window helpers equal the plain windows they replace."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from helpers import spark_bag
from sensorloom.operators import audit as AU
from sensorloom.operators import timeseries as TS
from sensorloom.operators.ordered import prev_by_key, running_by_key
from sensorloom.operators.topk import top_k_per_group


def _readings(fx):
    return fx.readings().withColumn("event_time", TS.event_time())


def test_changes_only_any_bucket_equals_plain_lag(fx):
    r = _readings(fx)
    w = Window.partitionBy("asset_id").orderBy(F.col("event_time").asc_nulls_first(), "offset_id")
    plain = (r.withColumn("_p", F.lag("value").over(w)).withColumn("_n", F.row_number().over(w))
             .where((F.col("_n") == 1) | ~F.col("_p").eqNullSafe(F.col("value"))).drop("_p", "_n"))
    expected = spark_bag(plain)
    for bucket in ("minute", "hour", "day", "month"):
        assert spark_bag(TS.changes_only(r, bucket=bucket)) == expected, bucket


def test_prev_by_key_tiny_buckets(fx):
    calls = fx.tool_calls()
    w = Window.partitionBy("run_id").orderBy("seq")
    plain = calls.select("*", F.lag("tool").over(w).alias("prev_tool"),
                         (F.row_number().over(w) > 1).alias("has_prev"))
    got = prev_by_key(calls, "run_id", ["seq"], F.shiftright("seq", 3), ["tool"])
    assert spark_bag(got) == spark_bag(plain)


def test_running_by_key_tiny_buckets(fx):
    calls = fx.tool_calls().withColumn("x", F.when(F.col("tool") == "click", F.col("seq")))
    w = Window.partitionBy("run_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    plain = calls.select("*", F.count(F.lit(1)).over(w).alias("rank"), F.max("x").over(w).alias("mx"))
    got = running_by_key(calls, ["run_id"], ["seq"], F.shiftright("seq", 2), max_of={"mx": "x"})
    assert spark_bag(got) == spark_bag(plain)


def test_tool_runs_guard_three_equals_gaps_and_islands(fx, monkeypatch):
    calls = fx.tool_calls()
    monkeypatch.setattr(AU, "SEQ_BUCKET_BITS", 2)
    got = AU.tool_runs(calls, guard=3)
    w = Window.partitionBy("run_id").orderBy("seq")
    p = calls.withColumn("brk", F.when(F.lag("tool").over(w).eqNullSafe(F.col("tool")), 0).otherwise(1))
    p = p.withColumn("island", F.sum("brk").over(w))
    p = p.withColumn("n_consecutive", F.row_number().over(Window.partitionBy("run_id", "island").orderBy("seq")))
    plain = p.where(F.col("n_consecutive") >= 3).select("run_id", "seq", "tool", "n_consecutive")
    assert spark_bag(got) == spark_bag(plain)


def test_top_k_per_group_equals_row_number(fx):
    r = fx.readings()
    order = [F.col("timestamp").desc(), F.col("offset_id").asc()]
    got = top_k_per_group(r, ["asset_id"], order, 3, salts=7)
    plain = r.withColumn("rank", F.row_number().over(Window.partitionBy("asset_id").orderBy(*order))) \
             .where(F.col("rank") <= 3)
    assert spark_bag(got) == spark_bag(plain)


def test_run_lengths_tiny_buckets_equal_plain(fx):
    from sensorloom.operators.ordered import run_lengths
    calls = fx.tool_calls()
    w = Window.partitionBy("run_id").orderBy("seq")
    p = calls.withColumn("brk", F.when(F.lag("tool").over(w).eqNullSafe(F.col("tool")), 0).otherwise(1))
    p = p.withColumn("island", F.sum("brk").over(w))
    plain = p.withColumn("run_length", F.row_number().over(Window.partitionBy("run_id", "island").orderBy("seq"))) \
             .select(*calls.columns, "run_length")
    for bits in (0, 1, 3, 20):
        assert spark_bag(run_lengths(calls, "run_id", "seq", "tool", F.shiftright("seq", bits))) == spark_bag(plain), bits
