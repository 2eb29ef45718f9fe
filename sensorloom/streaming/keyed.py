"""Change detection with one value of state per key, held in the session's state store.

The store writes what changed since its last version (RocksDB, changelog checkpoints), so a
micro-batch costs its own rows and the keys whose value changed, not the number of keys.
A micro-batch is bounded by the source (files or offsets per trigger), and so is what a key gets of it.
"""

from __future__ import annotations

import contextlib
import hashlib
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Spark's settings for a state store that writes changes only.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
         "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}


def _known(v):
    """NaN is taken as null, as it has no place in an order and equals nothing."""
    return None if v is None or v != v else v


class LastValue(StatefulProcessor):
    """Passes a row on when its value differs (null-safe) from the key's last one, which is its state.

    Rows of a micro-batch are taken by ``order``, null first; across micro-batches arrival order counts."""

    def __init__(self, value: str, order: list[str]):
        self.value, self.order = value, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "value string")

    def _at(self, row: Row) -> list[tuple]:
        return [(v is not None, v) for v in (_known(row[c]) for c in self.order)]

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # a key has few rows in a micro-batch: plain lists cost a small part of what a data frame for each key does
        before = last = self.last.get()
        for row in sorted(rows, key=self._at):
            now = (_known(row[self.value]),)
            if now != last:
                yield row
            last = now
        if last != before:
            self.last.update(last)

    def close(self) -> None:
        pass


def changed_rows(readings: DataFrame, key: str = "asset_id", value: str = "value", order: tuple[str, ...] = ("event_time", "offset_id")) -> DataFrame:
    """Stream of the readings whose value differs from the key's previous one; a null key is a key of its own."""
    keyed = readings.withColumns({"_none": F.col(key).isNull(), "_name": F.coalesce(F.col(key).cast("string"), F.lit(""))})
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in readings.schema.fields)
    return keyed.groupBy("_none", "_name").transformWithState(
        statefulProcessor=LastValue(value, list(order)), outputStructType=fields, outputMode="Append", timeMode="None")


def stream_folder(checkpoint: str) -> str:
    """Folder of a stream in a collection that it may share with others."""
    return "stream=" + hashlib.sha256(checkpoint.encode()).hexdigest()[:16]


@contextlib.contextmanager
def state_store(spark: SparkSession, partitions: int | None = None):
    """Settings of the store for the queries started meanwhile (a query keeps those it was started with, and the number of
    its partitions for good)."""
    new = STORE if partitions is None else {**STORE, "spark.sql.shuffle.partitions": str(partitions)}
    old = {k: spark.conf.get(k, None) for k in new}
    for k, v in new.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def changes_sink(readings: DataFrame, path: str, checkpoint: str, key: str = "asset_id", value: str = "value",
                 order: tuple[str, ...] = ("event_time", "offset_id"), fmt: str = "parquet", available_now: bool = True,
                 partitions: int | None = None):
    """Write the changed readings to ``path/stream=S/batch_id=N``, S being a hash of the checkpoint: streams and
    redeployments with another checkpoint never overwrite one another, and a replayed batch replaces itself.

    ``partitions`` of the state are chosen when the stream starts first (else the session's shuffle partitions): each is a store of
    its own that every micro-batch opens and commits, so a few are right for few keys and many for many."""
    own = os.path.join(path, stream_folder(checkpoint))

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").format(fmt).save(os.path.join(own, f"batch_id={batch_id}"))

    w = changed_rows(readings, key, value, order).writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    if available_now:
        w = w.trigger(availableNow=True)
    with state_store(readings.sparkSession, partitions):
        return w.start()
