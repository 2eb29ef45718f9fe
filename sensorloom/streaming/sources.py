"""Streaming sources: JSON-lines landing directories and Kafka topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

MESSAGE = T.StructType([T.StructField("offset_id", T.LongType()), T.StructField("value", T.StringType())])


def json_messages(spark: SparkSession, path: str, schema: T.StructType = MESSAGE,
                  max_files_per_trigger: int | None = None) -> DataFrame:
    """Message envelopes landed as JSON lines (one object per line)."""
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.json(path)


def kafka_messages(spark: SparkSession, bootstrap_servers: str, topic: str,
                   starting_offsets: str = "earliest", max_offsets_per_trigger: int | None = None) -> DataFrame:
    """Kafka topic as ``offset_id, value, key, partition, topic``.

    Needs the Kafka connector on the classpath (not bundled here); the
    message id used downstream is (topic, partition, offset)."""
    from pyspark.sql import functions as F

    r = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", bootstrap_servers)
         .option("subscribe", topic).option("startingOffsets", starting_offsets))
    if max_offsets_per_trigger:
        r = r.option("maxOffsetsPerTrigger", max_offsets_per_trigger)
    k = r.load()
    return k.select(F.col("offset").alias("offset_id"), F.col("value").cast("string").alias("value"),
                    F.col("key").cast("string").alias("key"), "partition", "topic")
