"""Join helpers with an explicit size check before any broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows a side may hold to be broadcast.  The check is an action on the
# small side only (``limit(n+1).count()`` stops after n+1 rows).
BROADCAST_MAX_ROWS = 200_000


def fits(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> bool:
    return df.limit(max_rows + 1).count() <= max_rows


def table_side(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """The smaller side of a join, one row a key: broadcast or hashed by partition, so the rows of the large side
    pass by and are not sorted, and a hot key of theirs can still be split."""
    return F.broadcast(df) if fits(df, max_rows) else df.hint("shuffle_hash")


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner",
               max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Broadcast ``small`` only when it holds at most ``max_rows`` rows;
    beyond that leave the choice to AQE (sort-merge with skew splitting)."""
    if fits(small, max_rows):
        small = F.broadcast(small)
    return big.join(small, on, how)
