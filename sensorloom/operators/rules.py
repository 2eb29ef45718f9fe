"""Pipeline structure rules over the ``stages`` table.

``stages(pipeline_id, rank, stage, component, protocol, aas_destination)``:
one row per stage; a pipeline has at most six stages (the template), so a
window per pipeline is bounded by construction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The stage order of the pipeline template (both spellings
# of the pre-processing stage occur) and the mandatory stages.
STAGE_RANK = {"Collection": 1, "Integration": 2, "PreProcess": 3, "PreProcessing": 3, "Storage": 4,
              "Processing": 5, "Utilization": 6}
MANDATORY = ("Collection", "PreProcess", "Storage")

# Bridge protocols.
SOURCE_PROTOCOLS = ("opcua", "mqtt", "modbus", "http", "tcp")
TARGET_PROTOCOLS = ("http", "mqtt", "tcp", "modbus", "kafka")


def _canon_rank(stage_col: str = "stage"):
    m = F.create_map(*[x for k, v in STAGE_RANK.items() for x in (F.lit(k), F.lit(v))])
    return F.element_at(m, F.col(stage_col))


def _canon_name(stage_col: str = "stage"):
    return F.when(F.col(stage_col) == "PreProcessing", "PreProcess").otherwise(F.col(stage_col))


def chain_violations(stages: DataFrame) -> DataFrame:
    """``aas_destination`` must name the next stage's component (NULL on
    the last stage)."""
    w = Window.partitionBy("pipeline_id").orderBy("rank")
    s = stages.withColumn("expected_destination", F.lead("component").over(w))
    return s.where(~F.col("aas_destination").eqNullSafe(F.col("expected_destination"))) \
            .select("pipeline_id", "rank", "component", "aas_destination", "expected_destination")


def order_check(stages: DataFrame) -> DataFrame:
    """Per pipeline: stage count, missing mandatory stages, order ok."""
    w = Window.partitionBy("pipeline_id").orderBy("rank")
    s = stages.withColumn("_canon", _canon_rank()).withColumn("_prev", F.lag("_canon").over(w))
    bad_step = F.when(F.col("_canon").isNull() | (F.col("_prev").isNotNull() & (F.col("_prev") >= F.col("_canon"))), 1)
    g = s.groupBy("pipeline_id").agg(
        F.count(F.lit(1)).alias("n_stages"), F.count(bad_step).alias("_bad"),
        *[F.max(F.when(_canon_name() == m, 1).otherwise(0)).alias(f"_has_{m}") for m in MANDATORY])
    missing = F.array_join(F.array_compact(F.array(*[F.when(F.col(f"_has_{m}") == 0, F.lit(m)) for m in MANDATORY])), ",")
    return g.select("pipeline_id", "n_stages", missing.alias("missing_mandatory"), (F.col("_bad") == 0).alias("order_ok"))


def protocol_gaps(stages: DataFrame) -> DataFrame:
    """Collection -> PreProcess without Integration needs equal protocols."""
    name = _canon_name()
    col_ = stages.where(name == "Collection").select("pipeline_id", F.col("protocol").alias("collection_protocol"))
    pre = stages.where(name == "PreProcess").select("pipeline_id", F.col("protocol").alias("preprocess_protocol"))
    integ = stages.where(name == "Integration").select("pipeline_id")
    j = col_.join(pre, "pipeline_id").join(integ, "pipeline_id", "left_anti")
    return j.where(~F.col("collection_protocol").eqNullSafe(F.col("preprocess_protocol")))


def bridge_violations(bridges: DataFrame) -> DataFrame:
    """Protocol pair and parameter rules of bridge requests, one row per
    violation (membership tests against the fixed protocol lists)."""
    src, tgt = F.lower(F.col("source_protocol")), F.lower(F.col("target_protocol"))
    rules = F.array_compact(F.array(
        F.when(~F.coalesce(src.isin(*SOURCE_PROTOCOLS), F.lit(False)), F.lit("unsupported_source")),
        F.when(~F.coalesce(tgt.isin(*TARGET_PROTOCOLS), F.lit(False)), F.lit("unsupported_target")),
        F.when((src == "opcua") & (F.coalesce(F.col("n_paths"), F.lit(0)) == 0), F.lit("opcua_needs_paths")),
        F.when((tgt == "kafka") & F.coalesce(F.col("topic"), F.lit("")).eqNullSafe(""), F.lit("kafka_needs_topic")),
    ))
    return bridges.select("bridge_id", F.explode(rules).alias("rule"))
