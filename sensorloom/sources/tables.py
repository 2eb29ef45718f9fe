"""Table scans.

``Tables`` opens each parquet table lazily; nothing is read until an
action runs, so Catalyst prunes columns (``ReadSchema``) and pushes
filters (``PushedFilters``) into every scan used by a query.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLE_NAMES = ("region nation customer supplier part orders lineitem events documents "
               "embeddings pages benchmark labels conversations").split()


def dealt(df: DataFrame) -> DataFrame:
    """Rows dealt out evenly to several tasks a core, before work that is much for a row: a table of
    small rows is few files, read by fewer tasks than there are cores."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


#: Rows of a table that one task of a shuffle gets, at most, on the average.
TASK_ROWS = 250_000


class Tables:
    """Opens each table once per instance (one file listing / footer read);
    views built from the same table share that relation."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._opened: dict[str, DataFrame] = {}

    def path(self, name: str) -> str:
        return os.path.join(self.sf_dir, f"{name}.parquet")

    def read(self, name: str) -> DataFrame:
        if name not in self._opened:
            self._opened[name] = self.spark.read.parquet(self.path(name))
        return self._opened[name]

    def tasks(self, *names: str, rows: int = TASK_ROWS) -> int:
        """Tasks for a shuffle of these tables' rows: one for ``rows`` of them, so a task holds no more of a larger table.  Counts
        are read from the footers of the files."""
        return max(1, -(-sum(self.read(n).count() for n in names) // rows))

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLE_NAMES:
            return self.read(name)
        raise AttributeError(name)
