"""Operations rules: topics, streams, sinks, readiness, capabilities, gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as SC

# Connector state that counts as healthy, and the name part
# that marks a sink connector.
RUNNING = "RUNNING"
SINK_MARKER = "mongo-sink"

CONNECTOR_STATUS = T.MapType(T.StringType(), T.StructType([
    T.StructField("status", T.StructType([
        T.StructField("connector", T.StructType([T.StructField("state", T.StringType())])),
        T.StructField("tasks", T.ArrayType(T.StructType([T.StructField("id", T.IntegerType()),
                                                         T.StructField("state", T.StringType())]))),
    ])),
]))


def topic_inventory(topics: DataFrame) -> DataFrame:
    """User topics and their partition counts, sorted by name.

    Accepts ``(topic, partitions)`` or one row per ``(topic, partition)``."""
    t = topics.where(~SC.is_internal_topic("topic"))
    if "partition" in t.columns:
        t = t.groupBy("topic").agg(F.count_distinct("partition").alias("partitions"))
    return t.select("topic", "partitions").orderBy("topic")


def streams_of(pipelines: DataFrame, raw_col: str = "raw_topic", sink_col: str = "sink_topic") -> DataFrame:
    """Streams a deployed processor registers: the raw stream reads the
    source topic, the processed stream writes the sink topic."""
    return pipelines.select(F.explode(F.array(
        F.struct(SC.stream_name(raw_col, "_raw").alias("stream"), F.col(raw_col).alias("topic")),
        F.struct(SC.stream_name(raw_col, "_processed").alias("stream"), F.col(sink_col).alias("topic")),
    )).alias("s")).select("s.*")


def topic_guard(candidates: DataFrame, streams: DataFrame) -> DataFrame:
    """Topics still used by a stream cannot be dropped: ``droppable`` and
    the blocking streams (few per topic), comma-separated."""
    blockers = streams.groupBy("topic").agg(F.array_join(F.array_sort(F.collect_set("stream")), ",").alias("blockers"))
    j = candidates.select("topic").join(blockers, "topic", "left")
    return j.select("topic", F.col("blockers").isNull().alias("droppable"), "blockers")


def readiness(pipelines: DataFrame, topics: DataFrame, sinks: DataFrame) -> DataFrame:
    """A pipeline is deployed when its raw and processed topics exist and
    its sink connector is RUNNING; ``missing`` lists what is not."""
    t = topics.select("topic").distinct()
    raw = t.select(F.col("topic").alias("raw_topic"), F.lit(True).alias("raw_ok"))
    proc = t.select(F.col("topic").alias("sink_topic"), F.lit(True).alias("processed_ok"))
    s = sinks.select("connector", F.col("state").alias("sink_state"))
    p = pipelines.withColumn("connector", SC.connector_name("sink_topic"))
    j = p.join(raw, "raw_topic", "left").join(proc, "sink_topic", "left").join(s, "connector", "left")
    raw_ok = F.coalesce(F.col("raw_ok"), F.lit(False))
    proc_ok = F.coalesce(F.col("processed_ok"), F.lit(False))
    sink_ok = F.coalesce(F.col("sink_state") == RUNNING, F.lit(False))
    missing = F.array_join(F.array_compact(F.array(
        F.when(~raw_ok, F.lit("raw_topic")), F.when(~proc_ok, F.lit("processed_topic")),
        F.when(~sink_ok, F.lit("sink_running")))), ",")
    return j.select("asset", "raw_topic", "sink_topic", raw_ok.alias("raw_ok"), proc_ok.alias("processed_ok"),
                    "sink_state", (raw_ok & proc_ok & sink_ok).alias("ready"), missing.alias("missing"))


def sink_health(status_docs: DataFrame, json_col: str = "status_json") -> DataFrame:
    """Connector status documents -> one row per sink connector with its
    task roll-up; non-sink connectors are dropped."""
    m = F.from_json(F.col(json_col), CONNECTOR_STATUS)
    e = status_docs.select(F.explode(m).alias("connector", "v"))
    e = e.where(F.col("connector").contains(SINK_MARKER))
    tasks = F.coalesce(F.col("v.status.tasks"), F.array().cast(CONNECTOR_STATUS.valueType["status"].dataType["tasks"].dataType))
    state = F.col("v.status.connector.state")
    return e.select("connector", state.alias("state"), F.size(tasks).alias("n_tasks"),
                    F.size(F.filter(tasks, lambda t: F.coalesce(t["state"] != RUNNING, F.lit(True)))).alias("not_running_tasks"),
                    F.coalesce((state == RUNNING) & F.forall(tasks, lambda t: F.coalesce(t["state"] == RUNNING, F.lit(False))),
                               F.lit(False)).alias("healthy"))


def capabilities(tools: DataFrame) -> DataFrame:
    """Server namespace -> its tool names (distinct, sorted; bounded by the
    server's tool count, not by rows)."""
    return tools.groupBy("server").agg(F.count_distinct("tool").alias("n_tools"),
                                       F.array_join(F.array_sort(F.collect_set("tool")), ",").alias("tools"))


def capability_map(tools: DataFrame) -> DataFrame:
    """The one-row map form ``{server: [tools]}`` (as the agent sees it)."""
    per = tools.groupBy("server").agg(F.array_sort(F.collect_set("tool")).alias("tools"))
    return per.agg(F.map_from_entries(F.collect_list(F.struct("server", "tools"))).alias("capabilities"))


def gap_analysis(technologies: DataFrame, tools: DataFrame) -> DataFrame:
    """Technology covered only by a server namespace of the same
    (normalised) name; a tool that merely mentions it does not count."""
    norm = lambda c: F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]", "")
    servers = tools.select(F.col("server").alias("covered_by")).distinct().withColumn("_k", norm(F.col("covered_by")))
    t = technologies.select("technology").distinct().withColumn("_k", norm(F.col("technology")))
    j = t.join(servers, "_k", "left")
    return j.select("technology", "covered_by", F.col("covered_by").isNull().alias("gap"))
