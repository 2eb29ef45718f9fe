"""Continuous preprocessing: source -> parse -> steps -> sink(s).

One streaming query replaces the reference's five persistent queries and
four topic hops: the steps are stateless projections/filters that fuse
into one stage (append mode, no state, no watermark).  Optional taps
(``taps``) also materialise intermediate stages from the same micro-batch.
Deploying twice with the same (source, sink, steps) reuses the checkpoint,
so a redeploy resumes instead of reprocessing (idempotent deployment).
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import readings as R
from ..session import scratch_path
from ..sources.messages import split_readings
from .registry import deploy_one


def checkpoint_for(spark: SparkSession, source: str, sink: str, steps: list[str]) -> str:
    key = hashlib.sha256("\x01".join([source, sink, *steps]).encode()).hexdigest()[:16]
    return scratch_path(spark, "stream-checkpoints", key)


def parsed_readings(messages: DataFrame) -> DataFrame:
    """Raw message stream -> readings (malformed rows dropped here; use
    ``split_readings`` directly to keep the rejects)."""
    good, _ = split_readings(messages, keep=message_id(messages))
    return good


def rejected_messages(messages: DataFrame) -> DataFrame:
    """Malformed rows of the message stream, with their message id (for a rejects sink)."""
    return split_readings(messages, keep=message_id(messages))[1]


def message_id(messages: DataFrame) -> tuple[str, ...]:
    """Columns that identify a message: offsets repeat between topics and partitions."""
    return tuple(c for c in ("topic", "partition", "offset_id") if c in messages.columns)


def stages(readings: DataFrame, flags: dict, source_schema: dict | None = None) -> dict[str, DataFrame]:
    """Every intermediate stage of the chain by name (for taps)."""
    out = {"raw": readings}
    cur = readings
    if flags.get("cleansing"):
        cur = R.cleanse(cur, source_schema)
        out["cleansed"] = cur
    if flags.get("imputation"):
        cur = R.impute(cur)
        out["imputed"] = cur
    if flags.get("normalization"):
        cur = R.normalize(cur)
        out["normalized"] = cur
    out["processed"] = R.transform(cur) if flags.get("transformation") else cur
    return out


def start_chain(spark: SparkSession, messages: DataFrame, sink_path: str, flags: dict, *,
                source_name: str = "messages", fmt: str = "parquet", taps: dict[str, str] | None = None,
                checkpoint: str | None = None, available_now: bool = True,
                processing_time: str | None = None, kafka_servers: str | None = None,
                sink_topic: str | None = None, source_schema: dict | None = None,
                registry: str | None = None, topics: DataFrame | None = None) -> StreamingQuery:
    """Start the chain.  Without taps the processed stream is written with
    the file sink (exactly-once through its commit log); with taps each
    micro-batch is persisted once and written to every target.

    With ``registry`` and ``topics`` the chain is entered in the deployment registry first: a source or sink that is no
    topic is refused, and a chain deployed before resumes from its checkpoint."""
    readings = parsed_readings(messages)
    result = R.preprocess(readings, cleansing=flags.get("cleansing", False),
                          imputation=flags.get("imputation", False),
                          normalization=flags.get("normalization", False),
                          transformation=flags.get("transformation", False), source_schema=source_schema)
    if registry is not None:
        deploy_one(spark, source_name, sink_topic or sink_path, result.steps, topics, registry)
    ckpt = checkpoint or checkpoint_for(spark, source_name, sink_path, result.steps)
    if fmt == "kafka":
        # processed readings as JSON messages keyed by the source offset
        msgs = to_json_messages(result.df, key_cols=list(message_id(messages)))
        w = (msgs.writeStream.format("kafka").option("kafka.bootstrap.servers", kafka_servers)
             .option("topic", sink_topic).option("checkpointLocation", ckpt).outputMode("append"))
    elif not taps:
        w = result.df.writeStream.format(fmt).option("path", sink_path).option("checkpointLocation", ckpt) \
                                 .outputMode("append")
    else:
        own = "stream=" + hashlib.sha256(ckpt.encode()).hexdigest()[:16]  # streams may share a sink

        def write_batch(batch: DataFrame, batch_id: int) -> None:
            batch.persist()
            try:
                st = stages(batch, flags, source_schema)
                st["processed"].write.mode("overwrite").format(fmt).save(os.path.join(sink_path, own, f"batch_id={batch_id}"))
                for name, path in taps.items():
                    st[name].write.mode("overwrite").format(fmt).save(os.path.join(path, own, f"batch_id={batch_id}"))
            finally:
                batch.unpersist()

        w = readings.writeStream.foreachBatch(write_batch).option("checkpointLocation", ckpt)
    if available_now:
        w = w.trigger(availableNow=True)
    elif processing_time:
        w = w.trigger(processingTime=processing_time)
    return w.start()


def to_json_messages(df: DataFrame, key_cols: list[str] | None = None) -> DataFrame:
    """Rows -> Kafka-style ``key, value`` JSON messages (nulls written)."""
    value = F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"})
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in key_cols]) if key_cols else F.expr("uuid()")
    return df.select(key.alias("key"), value.alias("value"))
