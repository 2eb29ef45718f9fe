"""Queries over the node tree: browse, variables, batch read, snapshot."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tree as TR
from .registry import register

REC = """WITH RECURSIVE t AS (
  SELECT node_id, name, node_class, value, 0 AS depth FROM nodes WHERE {start}
  UNION ALL SELECT n.node_id, n.name, n.node_class, n.value, t.depth + 1 FROM nodes n JOIN t ON n.parent_id = t.node_id
  WHERE t.depth < 5)"""


@register("node_browse", REC.format(start="parent_id IS NULL") + " SELECT node_id, name, node_class, depth FROM t",
          ["nodes"])
def node_browse(fx):
    return TR.browse_lazy(fx.nodes()).select("node_id", "name", "node_class", "depth")


@register("node_variables", """WITH RECURSIVE t AS (
  SELECT node_id, name, node_class, value, 0 AS depth FROM nodes WHERE parent_id IS NULL
  UNION ALL SELECT n.node_id, n.name, n.node_class, n.value, t.depth + 1 FROM nodes n JOIN t ON n.parent_id = t.node_id WHERE t.node_class = 'Object')"""
          + " SELECT node_id, name, value, depth FROM t WHERE node_class = 'Variable'", ["nodes"])
def node_variables(fx):
    """Variables of the whole tree, recursing into Objects only (bridge)."""
    return TR.variables(TR.browse(fx.nodes(), None, descend="objects")).select("node_id", "name", "value", "depth")


def read_requests(fx):
    o = fx.orders
    nid = F.concat(F.when(F.col("o_orderstatus") == "P", "ns=2;s=N").otherwise("ns=2;s=C"),
                   F.col("o_custkey").cast("string"))
    return o.select(F.col("o_orderkey").alias("req_pos"), nid.alias("node_id"))


@register("node_batch_read", """
SELECT q.req_pos, q.node_id, n.name, n.value, CASE WHEN n.node_id IS NULL THEN 'not found' END AS error
FROM (SELECT o_orderkey AS req_pos, CASE WHEN o_orderstatus = 'P' THEN 'ns=2;s=N' ELSE 'ns=2;s=C' END || CAST(o_custkey AS VARCHAR) AS node_id
      FROM orders) q
LEFT JOIN nodes n ON q.node_id = n.node_id
""", ["nodes"])
def node_batch_read(fx):
    return TR.batch_read(read_requests(fx), fx.nodes())


def node_readings(fx):
    """Value changes of customer variables: order totals over time."""
    return fx.orders.select(F.concat(F.lit("ns=2;s=C"), F.col("o_custkey").cast("string")).alias("node_id"),
                            F.col("o_orderdate").alias("ts"), "o_orderkey", F.col("o_totalprice").alias("value"))


@register("node_snapshot", REC.format(start="parent_id IS NULL") + """
, lv AS (SELECT node_id, value AS latest_value FROM (
    SELECT 'ns=2;s=C' || CAST(o_custkey AS VARCHAR) AS node_id, o_totalprice AS value,
      ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1)
SELECT t.node_id, t.name, coalesce(CAST(lv.latest_value AS VARCHAR), t.value) AS value,
  CASE WHEN lv.latest_value IS NOT NULL THEN 'reading' ELSE 'static' END AS source
FROM t LEFT JOIN lv ON t.node_id = lv.node_id WHERE t.node_class = 'Variable'
""", ["nodes"])
def node_snapshot(fx):
    return TR.snapshot(fx.nodes(), node_readings(fx), None, tiebreak="o_orderkey")
