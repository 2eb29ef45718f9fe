"""Tables written to the shared folder of the session (``spark.checkpoint.dir``)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_path


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; every call gives another one."""
    return scratch_path(spark, "llm", f"{name}-{uuid.uuid4().hex}")


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the
    lineage, survives lost executors, and is computed once however often it is used."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let_workers_import(spark: SparkSession) -> None:
    """Python workers on this machine find the package although they start in another folder
    (a cluster gets it with the job, as any package)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))
