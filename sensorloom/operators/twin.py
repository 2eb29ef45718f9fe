"""Asset-model operators: shells, submodel references, submodels.

Tables: ``shells(shell_id, ...)``, ``refs(shell_id, submodel_id[, pos])``
(the shell's submodel references), ``submodels(submodel_id, ...)``.
Per-shell lookups of the reference service become joins over all shells
at once; nothing collects a whole group into one row unless the caller
asks for one shell (``describe_shell``).
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir, commit_folder, path_exists
from .joins import join_small, table_side
from .ordered import prev_by_key


def enrich_shells(shells: DataFrame, refs: DataFrame, submodels: DataFrame,
                  scoped: DataFrame | None = None, on_missing: str = "keep", tasks: int | None = None) -> DataFrame:
    """One row per (shell, reference) with the resolved submodel columns.

    ``on_missing``: a dangling reference is kept and marked ("keep"), left out ("skip") or ends the job ("error").

    Resolution: the submodel as seen under the shell (``scoped``, keyed by
    shell_id + submodel_id) else the standalone submodel; ``resolved`` is
    false for a dangling reference.  Shells without references keep one row
    with NULL submodel.  References without a key (NULL id) are skipped.

    Neither submodels nor shells need sorted references.  ``tasks`` is the number of partitions of the join with ``scoped``, which has
    about as many rows as there are references (else the session's, whatever the rows are)."""
    r = refs.where(F.col("submodel_id").isNotNull())
    sm = submodels.select("submodel_id", F.lit(True).alias("_hit"), *[F.col(c).alias(f"sm_{c}") for c in submodels.columns
                                                                      if c != "submodel_id"])
    j = r.join(table_side(sm), "submodel_id", "left")
    if scoped is not None:
        sc = scoped.select("shell_id", "submodel_id", F.lit(True).alias("_scoped"), *[F.col(c).alias(f"sc_{c}") for c in scoped.columns
                                                        if c not in ("shell_id", "submodel_id")])
        j = by_pair(j, tasks).join(by_pair(sc, tasks), PAIR, "left")
        for c in submodels.columns:
            if c != "submodel_id" and f"sc_{c}" in j.columns:
                j = j.withColumn(f"sm_{c}", F.when(F.col("_scoped"), F.col(f"sc_{c}")).otherwise(F.col(f"sm_{c}"))).drop(f"sc_{c}")
        j = j.withColumn("_hit", F.coalesce("_scoped", "_hit")).drop("_scoped")
    # a hit is a matched row, whatever its columns hold
    j = j.withColumn("resolved", F.coalesce(F.col("_hit"), F.lit(False))).drop("_hit")
    if on_missing == "error":
        missing = F.concat(F.lit("submodel not found: "), F.col("submodel_id"))
        j = j.withColumn("resolved", F.when(F.col("resolved"), True).otherwise(F.raise_error(missing).cast("boolean")))
    elif on_missing == "skip":
        j = j.where("resolved")
    return shells.hint("shuffle_hash").join(j, "shell_id", "left")


PAIR = ["shell_id", "submodel_id"]


def by_pair(df: DataFrame, tasks: int | None) -> DataFrame:
    """Rows dealt by shell and submodel to so many tasks (None: as the session has it)."""
    return df if tasks is None else df.repartition(tasks, *PAIR)


def submodel_counts(shells: DataFrame, refs: DataFrame, submodels: DataFrame) -> DataFrame:
    """Submodels per shell as counts (partial aggregate; no arrays)."""
    e = enrich_shells(shells, refs, submodels.select("submodel_id", F.lit(True).alias("ok")))
    return e.groupBy("shell_id").agg(
        F.count("submodel_id").alias("n_refs"),
        F.count(F.when(F.col("resolved"), 1)).alias("n_resolved"),
        F.count(F.when(~F.col("resolved"), 1)).alias("n_dangling"))


def describe_shell(shells: DataFrame, refs: DataFrame, submodels: DataFrame, shell_id: str) -> DataFrame:
    """One shell with its ``submodels_content`` array in reference order
    (the per-shell form; bounded by the one shell's references)."""
    one = shells.where(F.col("shell_id") == shell_id)
    e = enrich_shells(one, refs.where(F.col("shell_id") == shell_id), submodels)
    order = "pos" if "pos" in refs.columns else "submodel_id"
    sm_cols = [c for c in e.columns if c.startswith("sm_")]
    content = F.array_sort(F.collect_list(F.when(F.col("resolved"), F.struct(
        F.col(order).alias("_o"), F.col("submodel_id"), *[F.col(c).alias(c[3:]) for c in sm_cols]))))
    keep = [c for c in shells.columns if c != "shell_id"]
    return e.groupBy("shell_id", *keep).agg(F.transform(content, lambda s: s.dropFields("_o"))
                                             .alias("submodels_content"))


def dangling_refs(refs: DataFrame, submodels: DataFrame) -> DataFrame:
    """References whose submodel does not exist (lenient enrichment report)."""
    return refs.join(submodels.select("submodel_id"), "submodel_id", "left_anti")


def lookup(keys: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Keyed lookup of many ids at once; ``found`` marks hits."""
    t = table.withColumn("_hit", F.lit(True))
    return keys.join(t, key, "left").withColumn("found", F.coalesce(F.col("_hit"), F.lit(False))).drop("_hit")


def lookup_scoped(requests: DataFrame, refs: DataFrame, submodels: DataFrame, tasks: int | None = None) -> DataFrame:
    """Submodel under a shell: the pair must be linked and the submodel exist.

    ``tasks`` is the number of partitions of the join by pairs (else the session's, whatever the rows are)."""
    linked = refs.select(*PAIR).join(table_side(submodels), "submodel_id", "inner").withColumn("_hit", F.lit(True))
    out = by_pair(requests, tasks).join(by_pair(linked, tasks), PAIR, "left")
    return out.withColumn("found", F.coalesce(F.col("_hit"), F.lit(False))).drop("_hit")


def export_pending(shells: DataFrame, exported: DataFrame, key: str = "shell_id") -> DataFrame:
    """Shells not yet exported (exact id; the reference tests a substring)."""
    return shells.join(exported.select(key), key, "left_anti")


def export_documents(shells: DataFrame, refs: DataFrame, submodels: DataFrame, exported: DataFrame) -> DataFrame:
    """One document per pending shell: its columns, ``submodels`` (the resolved ones, by id) and the number of dangling
    references.  A shell without resolvable submodels has an empty array.  A document holds its shell's content
    whole, as a file of it would; only that much is gathered into one row."""
    pending = export_pending(shells, exported)
    e = enrich_shells(pending, refs, submodels)
    names = [c for c in e.columns if c.startswith("sm_")]
    content = F.array_sort(F.collect_list(F.when(F.col("resolved"), F.struct("submodel_id", *[F.col(c).alias(c[3:]) for c in names]))))
    keep = [c for c in shells.columns if c != "shell_id"]
    return e.groupBy("shell_id", *keep).agg(content.alias("submodels"), F.count(F.when(~F.col("resolved"), 1)).alias("n_dangling"))


def export_shells(shells: DataFrame, refs: DataFrame, submodels: DataFrame, exported: DataFrame,
                  path: str, fmt: str = "json") -> None:
    """Write one document per pending shell with its resolved submodels.

    A failed job leaves no partial output (all-or-nothing) and ``append``
    never overwrites earlier exports."""
    export_documents(shells, refs, submodels, exported).write.mode("append").format(fmt).save(path)


def export_parts(shells: DataFrame, refs: DataFrame, submodels: DataFrame, exported: DataFrame, part_size: int = 10_000,
                 tasks: int | None = None) -> DataFrame:
    """Documents of pending shells in parts of bounded size: ``shell_id``, its columns, ``part`` and ``submodels``, the resolved ones in the
    order of reference (``refs.pos``, whole numbers that are unique in their shell).

    A part holds the positions of one span of ``part_size``, so its array has at most that many submodels and a shell
    with a third of all references is many rows; the parts of a shell follow by number, with gaps where positions
    have.  A shell without resolvable submodels has part 0 with an empty array.  References are dealt by shell and part (to ``tasks``,
    else as the session has it), so those of one shell are not in one task."""
    pending = export_pending(shells, exported)
    keep = [c for c in shells.columns if c != "shell_id"]
    names = [c for c in submodels.columns if c != "submodel_id"]
    known = table_side(submodels.select("submodel_id", F.struct("submodel_id", *names).alias("_sm")))
    found = refs.select("shell_id", "submodel_id", "pos").where("shell_id is not null").join(known, "submodel_id")
    whole = found.select("shell_id", "pos", F.floor(F.col("pos") / part_size).alias("part"), "_sm").join(table_side(pending), "shell_id")
    whole = whole.repartition(*filter(None, [tasks]), "shell_id", "part")
    item = F.struct("pos", "_sm.submodel_id", *[F.col(f"_sm.{c}") for c in names])
    parts = whole.groupBy("shell_id", *keep, "part").agg(F.array_sort(F.collect_list(item)).alias("submodels"))
    # of these it is enough to know their shells; their parts need not be built again, and with their positions the same
    # shuffled references serve for both
    resolved = found.groupBy("shell_id").agg(F.max("pos").alias("_pos")).where(F.col("_pos").isNull() | F.col("_pos").isNotNull()).select("shell_id")
    empty = pending.join(resolved, "shell_id", "left_anti").withColumn("part", F.lit(0).cast("long"))
    return parts.unionByName(empty.withColumn("submodels", F.array().cast(parts.schema["submodels"].dataType)))


def write_export(parts: DataFrame, path: str, name: str, fmt: str = "json") -> bool:
    """Write an export under ``path`` as a whole: it is staged, and appears as ``committed/name`` in one step, so a failed write leaves
    nothing that ``read_exports`` reads.  False, and nothing written, where an export of that name is there."""
    spark = parts.sparkSession
    final = os.path.join(path, "committed", name)
    if path_exists(spark, final):
        return False
    staged = os.path.join(path, "staged", uuid.uuid4().hex)
    writer = parts.write.format(fmt)
    if fmt in ("json", "csv", "text"):
        writer = writer.option("compression", "gzip")  # long ids repeat in every item
    writer.save(staged)
    commit_folder(spark, staged, final)
    return True


def read_exports(spark, path: str, schema, fmt: str = "json") -> DataFrame:
    """All committed exports, with the name of each (``export``)."""
    rows = spark.read.schema(schema).format(fmt).option("recursiveFileLookup", "true").load(os.path.join(path, "committed"))
    return rows.withColumn("export", F.regexp_extract(F.col("_metadata.file_path"), "/committed/([^/]+)/", 1))


def orphans(submodels: DataFrame, refs: DataFrame, template_refs: DataFrame | None = None) -> DataFrame:
    """Submodels linked to no shell (and not to the template shell)."""
    out = submodels.join(refs.select("submodel_id"), "submodel_id", "left_anti")
    if template_refs is not None:
        out = out.join(template_refs.select("submodel_id"), "submodel_id", "left_anti")
    return out


def shared_submodels(refs: DataFrame) -> DataFrame:
    """Submodels linked from more than one shell (forbidden)."""
    return (refs.groupBy("submodel_id").agg(F.count_distinct("shell_id").alias("n_shells"))
            .where(F.col("n_shells") > 1))


def idshort_collisions(submodels: DataFrame, id_short: str = "id_short") -> DataFrame:
    """idShort used by more than one submodel: count and id range."""
    return (submodels.groupBy(id_short).agg(F.count(F.lit(1)).alias("n_submodels"),
                                            F.min("submodel_id").alias("first_id"),
                                            F.max("submodel_id").alias("last_id"))
            .where(F.col("n_submodels") > 1))


def _winners(refs: DataFrame, submodels: DataFrame, links: DataFrame) -> DataFrame:
    """``submodel_id, shell_id`` of the accepted requests, one a submodel.

    Whether a submodel is asked for, exists and is linked are three bits of its id, combined before they are shuffled.  The ids that are
    free are written once: they are few beside the requests, which are then not shuffled for them."""
    bit = lambda df, n: df.select("submodel_id", F.lit(n).alias("_bit"))
    bits = bit(links, 1).unionByName(bit(submodels, 2)).unionByName(bit(refs, 4)).groupBy("submodel_id").agg(F.bit_or("_bit").alias("_bits"))
    checkpoint_dir(links.sparkSession)
    free = bits.where((F.col("_bits") == 3) & F.col("submodel_id").isNotNull()).select("submodel_id").checkpoint()
    return join_small(links, free, "submodel_id", "left_semi").groupBy("submodel_id").agg(F.min("shell_id").alias("shell_id"))


def accepted_links(refs: DataFrame, submodels: DataFrame, links: DataFrame) -> DataFrame:
    """Link requests with ``accepted``: the submodel exists, no shell has it yet, and of several requests for
    it in one batch the one of the smallest shell id wins (a submodel belongs to one shell)."""
    winner = _winners(refs, submodels, links).withColumnRenamed("shell_id", "_winner")
    out = links.join(winner, "submodel_id", "left")
    return out.withColumn("accepted", F.coalesce(F.col("shell_id") == F.col("_winner"), F.lit(False))).drop("_winner")


def apply_links(refs: DataFrame, submodels: DataFrame, links: DataFrame, unlinks: DataFrame, tasks: int | None = None) -> DataFrame:
    """Accepted link requests (see ``accepted_links``) added, unlink requests
    removed; the submodels themselves stay.  An unlink request without one of the ids removes nothing.

    ``tasks`` is the number of partitions of the pairs (else the session's, whatever the rows are)."""
    valid = _winners(refs, submodels, links).where("shell_id is not null")
    gone = unlinks.where("shell_id is not null and submodel_id is not null")
    bit = lambda df, n: df.select(*PAIR, F.lit(n).alias("_bit"))
    bits = by_pair(bit(refs, 1).unionByName(bit(valid, 1)).unionByName(bit(gone, 2)), tasks).groupBy(*PAIR).agg(F.bit_or("_bit").alias("_bits"))
    return bits.where("_bits = 1").drop("_bits")


def change_log_state(log: DataFrame, key: str = "id", seq: str = "seq", path: str | None = None,
                     seq_bucket_bits: int = 20) -> DataFrame:
    """Current state from a create/replace/patch/delete log, as the store would hold it.

    A create of a live id is refused (409) and a patch of an id that is not live too (404), so neither changes
    anything; replace writes the whole value, live or not.  Each live id has the last op applied to it, or with
    ``path`` a row for the whole value (NULL path) and one for the last patch of each path since.

    Whether an id is live is decided by its ops other than patches alone: the previous one, by the bucketed lag.
    The rest are partial aggregates (``max_by``), so a hot id combines map-side instead of landing in one task."""
    rest = [c for c in log.columns if c not in (key, seq)]
    whole = log.where(F.col("op") != "patch")
    p = prev_by_key(whole, key, [seq], F.shiftright(F.col(seq), seq_bucket_bits), ["op"])
    refused = (F.col("op") == "create") & F.col("has_prev") & (F.col("prev_op") != "delete")
    done = p.where(~refused).select(*log.columns)
    pick = lambda df, *by: df.groupBy(*by).agg(F.max_by(F.struct(seq, *rest), F.col(seq)).alias("_l")) \
        .select(by[0], F.col(f"_l.{seq}").alias(seq), *[F.col(f"_l.{c}").alias(c) for c in rest])
    base = pick(done, key).where(F.col("op") != "delete")
    since = base.select(F.col(key).alias("_k"), F.col(seq).alias("_from"))
    patches = log.where(F.col("op") == "patch").join(since, (F.col(key) == F.col("_k")) & (F.col(seq) > F.col("_from"))).drop("_k", "_from")
    if path is None:
        return pick(base.unionByName(patches), key)
    return base.withColumn(path, F.lit(None).cast(base.schema[path].dataType)).unionByName(pick(patches, key, path))


def change_log_conflicts(log: DataFrame, key: str = "id", seq: str = "seq",
                         seq_bucket_bits: int = 20) -> DataFrame:
    """Creates whose id is live: the store answers 409.  An id is live if its previous op that is no patch is
    no delete; a patch, refused (404) or not, changes nothing about that.  Previous op via the bucketed lag."""
    p = prev_by_key(log.where(F.col("op") != "patch"), key, [seq], F.shiftright(F.col(seq), seq_bucket_bits), ["op"])
    return p.where((F.col("op") == "create") & F.col("has_prev") & (F.col("prev_op") != "delete")) \
            .drop("has_prev", "prev_op")


_SHELL_FIELDS = (("id", "shell_id"), ("idShort", "id_short"), ("assetInformation.assetKind", "asset_kind"),
                 ("assetInformation.globalAssetId", "global_asset_id"))


def shell_listing(responses: DataFrame, json_col: str = "body", keep: tuple = ()):
    """Shell-listing responses -> (shells, rejects).

    A response is ``{"result": [...]}`` or a bare list of shells; any other
    shape (or unparsable text) is a reject, never silently empty."""
    v = F.try_parse_json(F.col(json_col))
    wrapped = F.try_variant_get(v, "$.result", "array<variant>")
    bare = F.try_variant_get(v, "$", "array<variant>")
    items = F.coalesce(wrapped, bare)
    ok = responses.where(items.isNotNull()).select(*keep, F.explode(items).alias("s"))
    shells = ok.select(*keep, *[F.try_variant_get(F.col("s"), f"$.{p}", "string").alias(n) for p, n in _SHELL_FIELDS])
    rejects = responses.where(items.isNull()).select(*keep, F.col(json_col).alias("raw_body"),
                                                     F.when(v.isNull(), "unparsable")
                                                     .otherwise("unexpected shape").alias("reason"))
    return shells, rejects


def _submodel_items(spark, path: str, whole_files: bool) -> tuple[DataFrame, Column]:
    """Items of the documents under ``path``, and whether one is a submodel."""
    text = spark.read.text(path, wholetext=whole_files)
    v = F.try_parse_json("value")
    docs = text.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("raw_body"), v.alias("_v")).where("trim(raw_body) <> ''")
    item = lambda p, kind: F.try_variant_get("_v", p, kind)
    arrays = F.coalesce(item("$", "array<variant>"), item("$.submodels", "array<variant>"), item("$.result", "array<variant>"))
    one = F.coalesce(item("$.submodels", "variant"), item("$.result", "variant"), F.col("_v"))
    items = docs.select("file", "raw_body", F.col("_v").isNull().alias("_broken"), F.explode(F.coalesce(arrays, F.array(one))).alias("_s"))
    get = lambda f: F.try_variant_get("_s", f"$.{f}", "string")
    rows = items.select("file", "raw_body", "_broken", get("id").alias("submodel_id"), get("idShort").alias("id_short"), get("kind").alias("kind"),
                        get("modelType").alias("model_type"), F.to_json(F.try_variant_get("_s", "$.submodelElements", "variant")).alias("elements_json"),
                        F.schema_of_variant("_s").startswith("OBJECT").alias("_object"))
    good = F.coalesce(F.col("submodel_id").isNotNull() & F.col("_object"), F.lit(False))
    return rows, good


def read_submodels(spark, path: str, whole_files: bool = True) -> DataFrame:
    """Submodels of AAS JSON documents of any shape, without schema inference.

    A document is a file (of any number of lines) or, without ``whole_files``, a line.  It is parsed once into a VARIANT
    and holds one submodel, a list of them, or either under ``submodels`` or ``result``.  Elements stay JSON text for
    ``flatten_elements``; fields that a submodel lacks are NULL.  Broken JSON, documents that hold no object and
    items without an id are left out (``rejected_submodels``), the other items of their document are kept."""
    rows, good = _submodel_items(spark, path, whole_files)
    return rows.where(good).drop("file", "raw_body", "_broken", "_object")


def rejected_submodels(spark, path: str, whole_files: bool = True) -> DataFrame:
    """What ``read_submodels`` leaves out, as rejects: ``file, raw_body, reason``."""
    rows, good = _submodel_items(spark, path, whole_files)
    reason = F.when(F.col("_broken"), "broken JSON").when(~F.coalesce(F.col("_object"), F.lit(False)), "not an object").otherwise("no id")
    return rows.where(~good).select("file", "raw_body", reason.alias("reason"))
