"""Merkle manifest of a grouped table, with proofs by butterfly exchange.

Leaves of a group are ordered and numbered, and dealt to aligned chunks of ``fanout ** 2``
leaves, each hashed up to its own subtree root where it lies.  Then, round by round, aligned
groups of ``fanout`` neighbours (next: groups of groups) swap the roots they hold: every member gets the
same at most ``fanout`` values, keeps its siblings' as proof and hashes the common ancestor itself.  A
chunk therefore has its whole upper proof after the last round, with no pass back down the
tree.  The groups' roots then do the same among each other.

A round is one shuffle of one row per chunk and no key holds more than ``fanout`` of them, however many
leaves a group has.  Where the last of the neighbours is a smaller tree, its members
also answer for the places that it lacks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import shared_table

FANOUT = 16


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    """Lower-case hex SHA-256 of the fields one after the other."""
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def node(hashes: Column) -> Column:
    """Parent of an array of hashes."""
    return F.sha2(F.array_join(hashes, ""), 256)


def _parents(hashes: Column, fanout: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(hashes) - 1) / fanout).cast("int")), lambda i: node(F.slice(hashes, i * fanout + 1, fanout)))


def _step(members: Column, place: Column) -> Column:
    """One level of a proof: the place of the own hash among the run, and the others."""
    others = F.concat(F.slice(members, F.lit(1), place), F.slice(members, place + 2, F.greatest(F.size(members) - place - 1, F.lit(0))))
    return F.struct(place.cast("int").alias("place"), others.alias("siblings"))


def fold(start: Column, proof: Column) -> Column:
    """Root that a leaf and its proof lead to."""
    def up(h, s):
        left, n = s["place"], F.size(s["siblings"])
        return F.sha2(F.concat(F.array_join(F.slice(s["siblings"], F.lit(1), left), ""), h, F.array_join(F.slice(s["siblings"], left + 1, n - left), "")), 256)
    return F.aggregate(proof, start, up)


def siblings(proof: Column) -> Column:
    """All sibling hashes of a proof, level by level and left to right."""
    return F.flatten(F.transform(proof, lambda s: s["siblings"]))


def number(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``idx`` (place from 0 within ``group`` by ``order``) and ``n`` (rows of the group).

    Rows are sorted by ranges of (group, order, a tie-breaker), so neither a hot group nor a
    hot key lies in one task; only (range, group) counts are summed per group."""
    rows = shared_table(rows.withColumn("_tie", F.monotonically_increasing_id()), name)
    keys = [F.col(group).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order], F.col("_tie")]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    ranged = shared_table(ranged.withColumn("_part", F.shiftright("_at", 33)).drop("_tie"), f"{name}-ranged")
    parts = ranged.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    w = Window.partitionBy(group)
    parts = parts.select(F.col(group).alias("_group"), F.col("_part").alias("_p"), F.sum("_n").over(w).alias("n"),
                         (F.sum("_n").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n") - F.col("_first")).alias("_shift"))
    out = ranged.join(parts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_p")))
    return out.withColumn("idx", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_group", "_p", "_shift")


def butterfly(rows: DataFrame, group: Column, fanout: int = FANOUT) -> DataFrame:
    """``rows`` of ``p`` (0 to n - 1 within the group), ``n`` and ``value`` with ``proof`` (steps from the
    row's value up) and the group's root as ``value``.  The greatest n is read first: it gives the number of rounds."""
    top = rows.agg(F.max("n")).first()[0] or 1
    payload = [c for c in rows.columns if c not in ("value", "n", "p")]
    held = rows.withColumn("proof", F.array().cast("array<struct<place:int,siblings:array<string>>>")).withColumn("_group", group)
    size = 1  # of the subtree that a row holds the root of
    while size < top:
        held, size = _round(held, payload, size, fanout), size * fanout
    return held.drop("_group")


def _round(held: DataFrame, payload: list[str], size: int, fanout: int) -> DataFrame:
    """Neighbouring subtrees of ``size`` rows, ``fanout`` at a time, swap their values."""
    low, high = F.col("p") % size, F.floor(F.col("p") / (size * fanout))
    own = F.least(F.lit(size), F.col("n") - F.floor(F.col("p") / size) * size)  # rows of the own subtree
    own_row = F.struct("p", "proof", *payload)
    sent = held.select("_group", "n", "value", high.alias("_high"), (F.floor(F.col("p") / size) % fanout).alias("_digit"), own_row.alias("_row"),
                       F.when(F.col("n") > size, F.sequence(low, F.lit(size - 1), own)).otherwise(F.array(low)).alias("_lows"), low.alias("_own"))
    sent = sent.select("*", F.explode("_lows").alias("_low"))
    sent = sent.select("_group", "n", "_high", "_low", F.struct("_digit", "value", F.when(F.col("_low") == F.col("_own"), F.col("_row")).alias("row")).alias("_m"))
    met = sent.groupBy("_group", "n", "_high", "_low").agg(F.array_sort(F.collect_list("_m"), lambda a, b: (a["_digit"] - b["_digit"]).cast("int")).alias("_all"))
    met = met.select("_group", "n", "_all", F.transform("_all", lambda m: m["value"]).alias("_values"))
    met = met.select("_group", "n", "_values", node(F.col("_values")).alias("_parent"), F.posexplode("_all").alias("_place", "_m")).where(F.col("_m.row").isNotNull())
    row = F.col("_m.row")
    grown = F.col("n") > size
    step = F.array(_step(F.col("_values"), F.col("_place")))
    return met.select("_group", "n", row["p"].alias("p"), *[row[c].alias(c) for c in payload], F.when(grown, F.col("_parent")).otherwise(F.col("_m.value")).alias("value"),
                      F.when(grown, F.concat(row["proof"], step)).otherwise(row["proof"]).alias("proof"))


def manifest(leaves: DataFrame, *, group: str = "source", order: tuple[str, ...] = ("doc_id",), leaf_col: str = "leaf",
             fanout: int = FANOUT, block: int = 64) -> DataFrame:
    """``leaves`` with ``idx`` (place in its group), ``subroot`` (the group's root), ``root`` and ``proof``
    (array of place and siblings, from the leaf to the root).

    Per group, leaves ascend by ``order``, null first, and leaves of equal keys by their hash; while several nodes
    remain, every ``fanout`` consecutive ones become their parent (the last run may be one). The
    groups' roots, by group, null first, give the root alike.  A null group is a group; repeated rows are
    leaves of their own; a lone leaf is its group's root; an empty table gives no rows.  Columns of
    ``leaves`` other than these names are kept.  ``block`` chunks share one copy of their group's proof."""
    kept = [c for c in leaves.columns if c not in ("idx", "subroot", "root", "proof")]
    span = fanout * fanout
    rows = number(leaves.select(*kept), group, [*order, leaf_col], "merkle-leaves")
    key = [F.col(group).alias("_g"), F.floor(F.col("idx") / span).alias("_chunk")]
    chunks = rows.select(*key, "n", F.struct("idx", *kept).alias("_leaf")).groupBy("_g", "_chunk", "n").agg(F.collect_list("_leaf").alias("_leaves"))
    chunks = chunks.withColumn("_leaves", F.array_sort("_leaves", lambda a, b: (a["idx"] - b["idx"]).cast("int")))
    chunks = chunks.withColumn("_level0", F.transform("_leaves", lambda x: x[leaf_col]))
    chunks = shared_table(chunks.withColumn("_level1", _parents(F.col("_level0"), fanout)), "merkle-chunks")
    value = F.when(F.col("n") == 1, F.col("_level0")[0]).when(F.col("n") <= fanout, F.col("_level1")[0]).otherwise(node(F.col("_level1")))
    heads = chunks.select("_g", F.col("_chunk").alias("p"), F.ceil(F.col("n") / span).alias("n"), value.alias("value"))
    upper = shared_table(butterfly(heads, F.col("_g"), fanout), "merkle-upper")
    groups = upper.where("p = 0").select("_g", F.col("n").alias("_chunks"), "value")
    groups = _number_groups(groups)
    top = butterfly(groups, F.lit(0), fanout)
    ports = top.select("_g", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_chunks") - 1) / block))).alias("_port"), F.col("value").alias("root"),
                       F.col("proof").alias("_group_proof"))
    upper = upper.select("_g", F.col("p").alias("_chunk"), F.floor(F.col("p") / block).alias("_port"), F.col("value").alias("subroot"), F.col("proof").alias("_upper"))
    upper = _null_safe(upper, ports, ["_port"])
    whole = _null_safe(chunks, upper.drop("_port"), ["_chunk"])
    whole = whole.select("n", "_level0", "_level1", "subroot", "root", F.concat("_upper", "_group_proof").alias("_upper"), F.posexplode("_leaves").alias("_i", "_leaf"))
    own, run = F.col("_i") % fanout, F.floor(F.col("_i") / fanout).cast("int")
    below = F.when(F.col("n") == 1, F.array().cast("array<struct<place:int,siblings:array<string>>>")) \
        .when(F.col("n") <= fanout, F.array(_step(F.col("_level0"), own))) \
        .otherwise(F.array(_step(F.slice("_level0", run * fanout + 1, fanout), own), _step(F.col("_level1"), run)))
    return whole.select(*[F.col("_leaf")[c].alias(c) for c in kept], F.col("_leaf.idx").alias("idx"), "subroot", "root", F.concat(below, "_upper").alias("proof"))


def _number_groups(groups: DataFrame) -> DataFrame:
    return number(groups.withColumn("_one", F.lit(0)), "_one", ["_g"], "merkle-groups").withColumnRenamed("idx", "p").drop("_one")


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on ``_g`` (null equals null) and ``keys``."""
    right = right.select(F.col("_g").alias("_rg"), *[F.col(k).alias(f"_r{k}") for k in keys], *[c for c in right.columns if c not in ("_g", *keys)])
    on = F.col("_g").eqNullSafe(F.col("_rg"))
    for k in keys:
        on &= F.col(k) == F.col(f"_r{k}")
    return left.join(right, on).drop("_rg", *[f"_r{k}" for k in keys])
