"""OPC UA style node tree over an edge table.

``edges(parent_id, node_id, name, node_class, value)``; roots have a NULL
parent.  Browsing is an unrolled self-join, one level per join, to a fixed
depth (the reference stops after depth 5: six levels 0..5).  The levels
share their sub-plans, so Spark reuses each level's exchange instead of
recomputing it; AQE picks broadcast or sort-merge per level from runtime
sizes and splits a skewed parent (one parent with a third of all
children) across tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

MAX_DEPTH = 5            # fixed value: deepest level browsed (levels 0..5)
NOT_FOUND = "not found"


def browse(edges: DataFrame, start: str | None = None, max_depth: int | None = None,
           descend: str = "all", materialize: bool = True) -> DataFrame:
    """Nodes below ``start`` (children of ``start`` have depth 0).

    ``start=None`` browses from the roots (NULL parent).  ``descend='all'``
    recurses into every child (reader, levels 0 to MAX_DEPTH unless said otherwise); ``'objects'`` recurses only into
    Object nodes (bridge), to any depth unless ``max_depth`` is given.  Every level is checkpointed to the session's
    checkpoint folder (a reliable checkpoint: survives lost executors), so it is one join on the level above, and
    the browse stops at the first empty level; a node met before (a cycle) is not met again.
    ``materialize=False`` (with a limit only) leaves everything to one lazy plan."""
    if max_depth is None and descend == "all":
        max_depth = MAX_DEPTH
    if max_depth is None and not materialize:
        raise ValueError("an unlimited browse needs its levels materialised")
    e = edges.select("parent_id", "node_id", "name", "node_class", "value")
    lvl = (e.where(F.col("parent_id").isNull()) if start is None else e.where(F.col("parent_id") == start)) \
        .withColumn("depth", F.lit(0))
    if materialize:
        ensure_checkpoint_dir(edges.sparkSession)
        lvl = lvl.checkpoint(eager=True)
    out, d = lvl, 0
    while max_depth is None or d < max_depth:
        d += 1
        frontier = lvl if descend == "all" else lvl.where(F.col("node_class") == "Object")
        lvl = (e.alias("c").join(frontier.select(F.col("node_id").alias("_p")), F.col("c.parent_id") == F.col("_p"))
               .select("c.*").withColumn("depth", F.lit(d)))
        if max_depth is None:
            lvl = lvl.join(out.select("node_id"), "node_id", "left_anti").select(*lvl.columns)
        if materialize:
            lvl = lvl.checkpoint(eager=True)
            if lvl.isEmpty():
                break
        out = out.unionByName(lvl)
    return out


def browse_lazy(edges: DataFrame, start: str | None = None, max_depth: int = MAX_DEPTH) -> DataFrame:
    """The reader's browse to ``max_depth`` as one recursive query: nothing runs while the plan is built, and the levels run one after
    the other when it does.  Spark ends a recursion beyond ``spark.sql.cteRecursionRowLimit`` rows with an error, so that limit
    is lifted in the session here; ``browse`` has none."""
    spark = edges.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    e = edges.select("parent_id", "node_id", "name", "node_class", "value")
    first = "e.parent_id IS NULL" if start is None else "e.parent_id = :start"
    return spark.sql(f"""
        WITH RECURSIVE found AS (
          SELECT e.parent_id, e.node_id, e.name, e.node_class, e.value, 0 AS depth FROM {{edges}} e WHERE {first}
          UNION ALL
          SELECT e.parent_id, e.node_id, e.name, e.node_class, e.value, found.depth + 1 FROM {{edges}} e JOIN found ON e.parent_id = found.node_id WHERE found.depth < {int(max_depth)})
        SELECT * FROM found""", args=None if start is None else {"start": start}, edges=e)


def variables(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("node_class") == "Variable")


def batch_read(requests: DataFrame, edges: DataFrame, id_col: str = "node_id") -> DataFrame:
    """One result per requested id (request order kept in the request
    columns); unknown ids get ``error`` and NULL name/value."""
    n = edges.select(F.col("node_id").alias(id_col), "name", "value", F.lit(True).alias("_hit"))
    j = requests.join(n, id_col, "left")
    return j.withColumn("error", F.when(F.col("_hit").isNull(), F.lit(NOT_FOUND))).drop("_hit")


def latest_values(readings: DataFrame, key: str = "node_id", value: str = "value", ts: str = "ts",
                  tiebreak: str | None = None) -> DataFrame:
    """Latest reading per node (``max_by`` is a partial aggregate)."""
    order = F.struct(F.col(ts), F.col(tiebreak)) if tiebreak else F.col(ts)
    return readings.groupBy(key).agg(F.max_by(F.col(value), order).alias("latest_value"))


def snapshot(edges: DataFrame, readings: DataFrame, start: str | None = None, max_depth: int | None = MAX_DEPTH,
             **kw) -> DataFrame:
    """Current value of every variable under ``start``: the latest reading
    of the node, else the value stored on the node."""
    v = variables(browse(edges, start, max_depth))
    lv = latest_values(readings, **kw)
    j = v.join(lv, "node_id", "left")
    return j.select("node_id", "name", F.coalesce(F.col("latest_value").cast("string"), F.col("value")).alias("value"),
                    F.when(F.col("latest_value").isNotNull(), "reading").otherwise("static").alias("source"))
