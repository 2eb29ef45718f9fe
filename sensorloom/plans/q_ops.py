"""Queries: topics, stream guard, readiness, sink health, capabilities, gaps, scalar ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as SC
from ..operators import ops as OP
from .registry import register


def pipelines(fx):
    k = F.col("s_suppkey").cast("string")
    return fx.supplier.select(F.concat(F.lit("s"), k).alias("asset"),
                              SC.topic_name(F.lit("opcua"), F.concat(F.lit("s"), k), F.lit("raw")).alias("raw_topic"),
                              SC.topic_name(F.lit("opcua"), F.concat(F.lit("s"), k), F.lit("processed")).alias("sink_topic"))


def deployed_pipelines(fx):
    p = pipelines(fx).withColumn("connector", SC.connector_name("sink_topic"))
    return p.join(fx.sinks().select("connector"), "connector", "left_semi").drop("connector")


def tool_registry(fx):
    """Tools per server namespace: the event types of the customers of each nation."""
    users = fx.customer.join(fx.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.lower("n_name").alias("server"))
    return fx.events.join(users, F.col("user_id") == F.col("c_custkey")).select("server", F.col("event_type").alias("tool"))


def connector_status_docs(fx):
    k = F.col("s_suppkey")
    ks = k.cast("string")
    sink = k % 3 != 0
    name = F.when(sink, F.concat(F.lit("mongo-sink-opcua-s"), ks, F.lit("-processed"))) \
            .otherwise(F.concat(F.lit("jdbc-source-s"), ks))
    state = F.when(~sink, "RUNNING").when(k % 4 == 0, "FAILED").when(k % 4 == 1, "PAUSED").otherwise("RUNNING")
    tstate = F.when(k % 5 == 0, "FAILED").otherwise(state)
    tasks = F.when(k % 7 == 0, F.lit("[]")).otherwise(F.concat(F.lit('[{"id":0,"state":"'), tstate, F.lit('"}]')))
    doc = F.concat(F.lit('{"'), name, F.lit('":{"status":{"connector":{"state":"'), state,
                   F.lit('"},"tasks":'), tasks, F.lit("}}}"))
    return fx.supplier.select(doc.alias("status_json"))


PIPES_SQL = """p AS (SELECT 's' || CAST(s_suppkey AS VARCHAR) AS asset, 'opcua.s' || CAST(s_suppkey AS VARCHAR) || '.raw' AS raw_topic,
  'opcua.s' || CAST(s_suppkey AS VARCHAR) || '.processed' AS sink_topic FROM supplier)"""


@register("topic_inventory", """
SELECT topic, partitions FROM topics WHERE NOT (starts_with(topic, '__') OR starts_with(topic, 'agentic_ksql'))
""", ["topics"])
def topic_inventory(fx):
    return OP.topic_inventory(fx.topics())


@register("partition_counts", """
SELECT 'opcua.s' || s_suppkey || '.raw' AS topic, CAST(1 + s_suppkey % 5 AS BIGINT) AS partitions FROM supplier
""")
def partition_counts(fx):
    """Partition counts from one row per (topic, partition) and replica; internal topics left out."""
    s = fx.supplier.withColumn("topic", F.concat(F.lit("opcua.s"), F.col("s_suppkey").cast("string"), F.lit(".raw")))
    rows = s.select("topic", F.explode(F.sequence(F.lit(0), (F.col("s_suppkey") % 5).cast("int"))).alias("partition"))
    hidden = fx.supplier.select(F.concat(F.lit("__internal"), F.col("s_suppkey").cast("string")).alias("topic"), F.lit(0).alias("partition"))
    return OP.topic_inventory(rows.unionByName(rows).unionByName(hidden))


@register("topic_guard", f"""
WITH {PIPES_SQL},
d AS (SELECT * FROM p WHERE 'mongo-sink-' || replace(sink_topic, '.', '-') IN (SELECT connector FROM sinks)),
st AS (SELECT translate(raw_topic, '.-', '__') || '_raw' AS stream, raw_topic AS topic FROM d
       UNION ALL SELECT translate(raw_topic, '.-', '__') || '_processed', sink_topic FROM d),
b AS (SELECT topic, string_agg(stream, ',' ORDER BY stream) AS blockers FROM (SELECT DISTINCT stream, topic FROM st) GROUP BY topic)
SELECT t.topic, b.blockers IS NULL AS droppable, b.blockers FROM topics t LEFT JOIN b ON t.topic = b.topic
WHERE NOT (starts_with(t.topic, '__') OR starts_with(t.topic, 'agentic_ksql'))
""", ["topics", "sinks"])
def topic_guard(fx):
    cands = fx.topics().where(~SC.is_internal_topic("topic"))
    return OP.topic_guard(cands, OP.streams_of(deployed_pipelines(fx)))


@register("deploy_ready", f"""
WITH {PIPES_SQL}
SELECT p.asset, p.raw_topic, p.sink_topic, r.topic IS NOT NULL AS raw_ok, q.topic IS NOT NULL AS processed_ok, s.state AS sink_state,
  (r.topic IS NOT NULL AND q.topic IS NOT NULL AND coalesce(s.state = 'RUNNING', false)) AS ready,
  concat_ws(',', CASE WHEN r.topic IS NULL THEN 'raw_topic' END, CASE WHEN q.topic IS NULL THEN 'processed_topic' END,
            CASE WHEN NOT coalesce(s.state = 'RUNNING', false) THEN 'sink_running' END) AS missing
FROM p LEFT JOIN (SELECT DISTINCT topic FROM topics) r ON r.topic = p.raw_topic
LEFT JOIN (SELECT DISTINCT topic FROM topics) q ON q.topic = p.sink_topic
LEFT JOIN sinks s ON s.connector = 'mongo-sink-' || replace(p.sink_topic, '.', '-')
""", ["topics", "sinks"])
def deploy_ready(fx):
    return OP.readiness(pipelines(fx), fx.topics(), fx.sinks())


@register("sink_health", """
SELECT 'mongo-sink-opcua-s' || CAST(s_suppkey AS VARCHAR) || '-processed' AS connector, state,
  CASE WHEN s_suppkey % 7 = 0 THEN 0 ELSE 1 END AS n_tasks,
  CASE WHEN s_suppkey % 7 = 0 THEN 0 WHEN tstate <> 'RUNNING' THEN 1 ELSE 0 END AS not_running_tasks,
  state = 'RUNNING' AND (s_suppkey % 7 = 0 OR tstate = 'RUNNING') AS healthy
FROM (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'PAUSED' ELSE 'RUNNING' END AS state,
  CASE WHEN s_suppkey % 5 = 0 THEN 'FAILED' ELSE CASE s_suppkey % 4 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'PAUSED' ELSE 'RUNNING' END END AS tstate
  FROM supplier WHERE s_suppkey % 3 <> 0)
""")
def sink_health(fx):
    return OP.sink_health(connector_status_docs(fx))


TOOLS_SQL = """(SELECT lower(n_name) AS server, event_type AS tool FROM events
  JOIN customer ON user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


@register("capabilities", f"""
SELECT server, count(DISTINCT tool) AS n_tools, string_agg(DISTINCT tool, ',' ORDER BY tool) AS tools FROM {TOOLS_SQL} GROUP BY server
""")
def capabilities(fx):
    return OP.capabilities(tool_registry(fx))


@register("gap_analysis", f"""
WITH tech AS (SELECT DISTINCT ' ' || n_name AS technology FROM nation UNION SELECT DISTINCT p_brand FROM part),
srv AS (SELECT DISTINCT server FROM {TOOLS_SQL})
SELECT t.technology, s.server AS covered_by, s.server IS NULL AS gap
FROM tech t LEFT JOIN srv s ON regexp_replace(lower(trim(t.technology)), '[^a-z0-9]', '', 'g') = regexp_replace(lower(trim(s.server)), '[^a-z0-9]', '', 'g')
""")
def gap_analysis(fx):
    """Technologies (nations and brands) against the server namespaces in use."""
    tech = fx.nation.select(F.concat(F.lit(" "), "n_name").alias("technology")).unionByName(fx.part.select(F.col("p_brand").alias("technology")))
    return OP.gap_analysis(tech, tool_registry(fx))


@register("scalars_topics", r"""
SELECT topic, translate(topic, '.-', '__') AS stream_base, translate(topic, '.-', '__') || '_raw' AS raw_stream,
  translate(topic, '.-', '__') || '_processed' AS processed_stream, 'mongo-sink-' || replace(topic, '.', '-') AS connector,
  nullif(regexp_extract(topic, '^([^.]+)\.(.+)\.(raw|processed)$', 1), '') AS protocol,
  nullif(regexp_extract(topic, '^([^.]+)\.(.+)\.(raw|processed)$', 2), '') AS asset,
  nullif(regexp_extract(topic, '^([^.]+)\.(.+)\.(raw|processed)$', 3), '') AS stage,
  (starts_with(topic, '__') OR starts_with(topic, 'agentic_ksql')) AS internal
FROM topics
""", ["topics"])
def scalars_topics(fx):
    t = fx.topics()
    parts = SC.topic_parts("topic")
    return t.select("topic", SC.stream_base("topic").alias("stream_base"),
                    SC.stream_name("topic", "_raw").alias("raw_stream"),
                    SC.stream_name("topic", "_processed").alias("processed_stream"),
                    SC.connector_name("topic").alias("connector"),
                    parts["protocol"].alias("protocol"), parts["asset"].alias("asset"), parts["stage"].alias("stage"),
                    SC.is_internal_topic("topic").alias("internal"))


def _hex4(i):
    return f"CAST(CAST(('0x' || substr(md5(shell_id), {1 + 4 * i}, 4)) AS INTEGER) % 10000 AS VARCHAR)"


@register("scalars_ids", r"""
SELECT shell_id, rtrim(translate(to_base64(encode(shell_id)), '+/', '-_'), '=') AS b64_id,
  'https://example.com/ids/aas/' || concat_ws('_', """ + ", ".join(f"lpad({_hex4(i)}, 4, '0')" for i in range(4)) + r""") AS numeric_iri,
  coalesce(nullif(regexp_replace(regexp_extract(rtrim(shell_id, '/'), '[^/]*$', 0), '[^\w\-.]', '_', 'g'), ''), 'unnamed') AS file_name,
  CASE WHEN starts_with(id_short, 'ns=') THEN id_short ELSE 'ns=2;s=' || id_short END AS node_path,
  CASE WHEN starts_with(id_short, 'ns=') THEN id_short ELSE 'ns=2;s=' || id_short END || ';datatype=String' AS node_topic,
  regexp_extract(regexp_extract('ns=2;s=' || id_short, '[^/]*$', 0), '[^=]*$', 0) AS display_name,
  CAST(s_suppkey * 250 // 1000 AS BIGINT) AS interval_s
FROM shells
""", ["shells"])
def scalars_ids(fx):
    s = fx.shells()
    return s.select("shell_id", SC.b64url_id("shell_id").alias("b64_id"),
                    SC.repeatable_numeric_iri("shell_id", is_submodel=False).alias("numeric_iri"),
                    SC.safe_filename("shell_id").alias("file_name"), SC.node_path("id_short").alias("node_path"),
                    SC.node_topic("id_short").alias("node_topic"), SC.display_name("id_short").alias("display_name"),
                    SC.ms_to_seconds(F.col("s_suppkey") * 250).alias("interval_s"))
