"""Document-store surface over tables: scan, append, latest-n, dashboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.docfilter import compile_filter, query_documents  # noqa: F401

ID = "_id"


def scan(df: DataFrame, id_col: str = ID) -> DataFrame:
    """All documents without the internal id."""
    return df.drop(id_col) if id_col in df.columns else df


def with_doc_id(df: DataFrame, *, deterministic_from: list[str] | None = None, namespace: str = "",
                id_col: str = ID) -> DataFrame:
    """Add the document id.  Random UUIDs like the store (a replay then
    duplicates); or a SHA-256 of ``namespace`` and key columns so that a
    replayed batch yields the same ids (idempotent append)."""
    if deterministic_from:
        key = F.concat_ws("\u0001", F.lit(namespace), *[F.col(c).cast("string") for c in deterministic_from])
        return df.withColumn(id_col, F.sha2(key, 256))
    return df.withColumn(id_col, F.expr("uuid()"))


def append(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Insert any number of documents (batch append through Spark's commit protocol)."""
    w = df.write.mode("append").format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def latest(df: DataFrame, n: int = 10, ts: str = "timestamp", tiebreak: list[str] | None = None,
           id_col: str = ID) -> DataFrame:
    """The ``n`` most recent documents, ``ts`` descending, missing last.

    ``orderBy(...).limit(n)`` plans as ``TakeOrderedAndProject``: each task
    keeps its own top n, only n rows per task reach the final merge."""
    order: list[Column] = [F.col(ts).desc_nulls_last()] + [F.col(c).desc() for c in (tiebreak or [])]
    return scan(df, id_col).orderBy(*order).limit(n)


def dashboard_json(df: DataFrame, limit: int = 100, ts: str = "timestamp",
                   tiebreak: list[str] | None = None) -> DataFrame:
    """Latest documents as JSON text for a dashboard data source."""
    top = latest(df, limit, ts, tiebreak)
    return top.select(*(tiebreak or []), F.to_json(F.struct(*[F.col(c) for c in top.columns]),
                                                   {"ignoreNullFields": "false"}).alias("json"))
