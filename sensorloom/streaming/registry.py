"""Deployment registry: which chains are deployed, and the checks before one is.

Every call commits its entries as one folder by an atomic rename that never overwrites, so a
reader sees all of a call or nothing of it.  A deployment is its source, sink and steps; of
several entries of one deployment the earliest call holds it, so calls that run at the
same time agree on which of them deployed it.
"""

from __future__ import annotations

import os
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import commit_folder, path_exists

ENTRY = "deployment string, source string, sink string, steps string, status string, call string, called_at long"


class DeploymentRefused(ValueError):
    """The source or the sink does not exist."""


def deployment_id(source, sink, steps):
    return F.substring(F.sha2(F.concat_ws("\x01", source, sink, steps), 256), 1, 16)


def _calls(spark: SparkSession, registry: str) -> DataFrame:
    if not path_exists(spark, os.path.join(registry, "calls")):
        return spark.createDataFrame([], ENTRY)
    return spark.read.schema(ENTRY).option("recursiveFileLookup", "true").parquet(os.path.join(registry, "calls"))


def deployed(spark: SparkSession, registry: str) -> DataFrame:
    """One row per deployment, with the call that holds it."""
    rows = _calls(spark, registry).where("status = 'deployed'")
    first = F.row_number().over(Window.partitionBy("deployment").orderBy("called_at", "call"))
    return rows.withColumn("_k", first).where("_k = 1").drop("_k", "status")


def deploy(requests: DataFrame, topics: DataFrame, registry: str, topic_col: str = "topic") -> DataFrame:
    """Deploy each request (``source, sink, steps``) whose topics both exist; its rows with ``deployment`` and ``status``.

    ``missing source`` and ``missing sink`` are refused, ``exists`` is deployed already, all others are
    ``deployed`` by this call.  Equal requests of a call are one; a null source or sink is missing."""
    spark = requests.sparkSession
    r = requests.select("source", "sink", F.coalesce("steps", F.lit("")).alias("steps")).distinct()
    r = r.withColumn("deployment", deployment_id(F.coalesce("source", F.lit("")), F.coalesce("sink", F.lit("")), F.col("steps")))
    known = topics.select(F.col(topic_col).alias("_t")).distinct()
    r = r.join(known.select(F.col("_t").alias("_source")), F.col("source") == F.col("_source"), "left")
    r = r.join(known.select(F.col("_t").alias("_sink")), F.col("sink") == F.col("_sink"), "left")
    held = deployed(spark, registry).select(F.col("deployment").alias("_held"))
    r = r.join(held, F.col("deployment") == F.col("_held"), "left")
    status = F.when(F.col("_source").isNull(), "missing source").when(F.col("_sink").isNull(), "missing sink") \
        .when(F.col("_held").isNotNull(), "exists").otherwise("deployed")
    call = uuid.uuid4().hex
    entries = r.select("deployment", "source", "sink", "steps", status.alias("status"), F.lit(call).alias("call"), F.lit(time.time_ns()).alias("called_at"))
    staged, final = os.path.join(registry, "staged", call), os.path.join(registry, "calls", call)
    entries.write.parquet(staged)
    commit_folder(spark, staged, final)
    own = spark.read.schema(ENTRY).parquet(final)
    winner = deployed(spark, registry).select(F.col("deployment").alias("_d"), F.col("call").alias("_winner"))
    status = F.when((F.col("status") == "deployed") & (F.col("_winner") != call), "exists").otherwise(F.col("status"))
    return own.join(winner, F.col("deployment") == F.col("_d"), "left").select("deployment", "source", "sink", "steps", status.alias("status"))


def deploy_one(spark: SparkSession, source: str, sink: str, steps: list[str], topics: DataFrame, registry: str) -> tuple[str, str]:
    """(deployment, ``deployed`` or ``exists``) of one chain; DeploymentRefused if a topic is missing."""
    request = spark.createDataFrame([(source, sink, ",".join(steps))], "source string, sink string, steps string")
    row = deploy(request, topics, registry).first()
    if row.status.startswith("missing"):
        raise DeploymentRefused(f"{row.status}: {source} -> {sink}")
    return row.deployment, row.status
