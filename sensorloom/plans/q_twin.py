"""Queries over the asset model: enrichment, lookups, links, rules, change log."""

from __future__ import annotations

import uuid

from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from ..operators import twin as TW
from ..session import scratch_path
from ..sources.fixtures import shell_iri, submodel_iri
from .registry import register


def link_requests(fx):
    """Link requests: every line item asks to link its part to its supplier."""
    return fx.lineitem.select(shell_iri("l_suppkey").alias("shell_id"), submodel_iri("l_partkey").alias("submodel_id"))


def unlink_requests(fx):
    """Unlink requests: returned line items."""
    return (fx.lineitem.where(F.col("l_returnflag") == "R")
            .select(shell_iri("l_suppkey").alias("shell_id"), submodel_iri("l_partkey").alias("submodel_id")))


def exported_manifest(fx):
    """Shells already exported (ids listed in an export manifest)."""
    return fx.supplier.where(F.col("s_acctbal") > 5000).select(shell_iri("s_suppkey").alias("shell_id"))


LINKS_SQL = """(SELECT 'https://example.com/ids/aas/0000_0000_0000_' || lpad(CAST(l_suppkey AS VARCHAR), CAST(greatest(4, length(CAST(l_suppkey AS VARCHAR))) AS INT), '0') AS shell_id,
  'https://example.com/ids/sm/0000_0000_' || lpad(CAST(l_partkey AS VARCHAR), CAST(greatest(8, length(CAST(l_partkey AS VARCHAR))) AS INT), '0') AS submodel_id
  FROM lineitem WHERE {w})"""


@register("shell_enriched", """
SELECT s.shell_id, s.id_short, s.s_suppkey, r.submodel_id, m.id_short AS sm_id_short, m.semantic_group AS sm_semantic_group,
  m.price AS sm_price, CASE WHEN r.submodel_id IS NULL THEN NULL ELSE m.submodel_id IS NOT NULL END AS resolved
FROM shells s LEFT JOIN submodel_refs r ON s.shell_id = r.shell_id LEFT JOIN submodels m ON r.submodel_id = m.submodel_id
""", ["shells", "submodel_refs", "submodels"])
def shell_enriched(fx):
    return TW.enrich_shells(fx.shells(), fx.submodel_refs(), fx.submodels())


@register("shell_enriched_scoped", """
SELECT s.shell_id, s.id_short, s.s_suppkey, r.submodel_id, CASE WHEN c.submodel_id IS NOT NULL THEN 'scoped ' || c.seen ELSE m.id_short END AS sm_id_short,
  CASE WHEN c.submodel_id IS NULL THEN m.price END AS sm_price, CASE WHEN r.submodel_id IS NULL THEN NULL ELSE m.submodel_id IS NOT NULL OR c.submodel_id IS NOT NULL END AS resolved
FROM shells s LEFT JOIN submodel_refs r ON s.shell_id = r.shell_id LEFT JOIN submodels m ON r.submodel_id = m.submodel_id
LEFT JOIN (SELECT shell_id, submodel_id, right(submodel_id, 2) AS seen FROM submodel_refs WHERE right(submodel_id, 1) IN ('3', '4')) c ON c.shell_id = r.shell_id AND c.submodel_id = r.submodel_id
""", ["shells", "submodel_refs", "submodels"])
def shell_enriched_scoped(fx):
    """Submodels as seen under their shell first (some exist only there, and have no price), else the standalone ones."""
    end = F.substring("submodel_id", -1, 1)
    scoped = fx.submodel_refs().where(end.isin("3", "4")).select(
        "shell_id", "submodel_id", F.concat(F.lit("scoped "), F.substring("submodel_id", -2, 2)).alias("id_short"), F.lit(None).cast("double").alias("price"))
    return TW.enrich_shells(fx.shells(), fx.submodel_refs(), fx.submodels().select("submodel_id", "id_short", "price"), scoped=scoped, tasks=fx.tasks("lineitem"))


@register("submodel_counts", """
SELECT s.shell_id, count(r.submodel_id) AS n_refs, count(m.submodel_id) AS n_resolved,
  count(r.submodel_id) - count(m.submodel_id) AS n_dangling
FROM shells s LEFT JOIN submodel_refs r ON s.shell_id = r.shell_id LEFT JOIN submodels m ON r.submodel_id = m.submodel_id
GROUP BY s.shell_id
""", ["shells", "submodel_refs", "submodels"])
def submodel_counts(fx):
    return TW.submodel_counts(fx.shells(), fx.submodel_refs(), fx.submodels())


@register("dangling_refs", """
SELECT r.submodel_id, r.shell_id FROM submodel_refs r WHERE NOT EXISTS (SELECT 1 FROM submodels m WHERE m.submodel_id = r.submodel_id)
""", ["submodel_refs", "submodels"])
def dangling_refs(fx):
    return TW.dangling_refs(fx.submodel_refs(), fx.submodels())


@register("lookup_shells", """
SELECT k.shell_id, s.id_short, s.s_suppkey, s.shell_id IS NOT NULL AS found
FROM (SELECT DISTINCT 'https://example.com/ids/aas/0000_0000_0000_' || lpad(CAST(o_custkey AS VARCHAR), CAST(greatest(4, length(CAST(o_custkey AS VARCHAR))) AS INT), '0') AS shell_id
      FROM orders) k
LEFT JOIN shells s ON k.shell_id = s.shell_id
""", ["shells"])
def lookup_shells(fx):
    keys = fx.orders.select(shell_iri("o_custkey").alias("shell_id")).distinct()
    return TW.lookup(keys, fx.shells(), "shell_id")


@register("lookup_scoped", f"""
SELECT k.shell_id, k.submodel_id, m.id_short, m.semantic_group, m.price,
  (r.shell_id IS NOT NULL AND m.submodel_id IS NOT NULL) AS found
FROM {LINKS_SQL.format(w="true")} k
LEFT JOIN (submodel_refs r JOIN submodels m ON r.submodel_id = m.submodel_id)
  ON k.shell_id = r.shell_id AND k.submodel_id = r.submodel_id
""", ["submodel_refs", "submodels"])
def lookup_scoped(fx):
    return TW.lookup_scoped(link_requests(fx), fx.submodel_refs(), fx.submodels(), tasks=fx.tasks("lineitem"))


@register("export_pending", """
SELECT s.* FROM shells s WHERE s.shell_id NOT IN (
  SELECT 'https://example.com/ids/aas/0000_0000_0000_' || lpad(CAST(s_suppkey AS VARCHAR), CAST(greatest(4, length(CAST(s_suppkey AS VARCHAR))) AS INT), '0') FROM supplier WHERE s_acctbal > 5000)
""", ["shells"])
def export_pending(fx):
    return TW.export_pending(fx.shells(), exported_manifest(fx))


@register("export_documents", """
SELECT s.shell_id, s.id_short, s.s_suppkey, count(r.submodel_id) - count(m.submodel_id) AS n_dangling, count(m.submodel_id) AS n_submodels,
  coalesce(string_agg(m.submodel_id || '=' || coalesce(m.id_short, 'none'), ',' ORDER BY m.submodel_id), '') AS submodels
FROM shells s LEFT JOIN submodel_refs r ON s.shell_id = r.shell_id
LEFT JOIN (SELECT submodel_id, CASE WHEN semantic_group = 'Brand#11' THEN NULL ELSE id_short END AS id_short FROM submodels) m ON r.submodel_id = m.submodel_id
WHERE s.shell_id NOT IN (SELECT shell_id FROM shells JOIN supplier USING (s_suppkey) WHERE s_acctbal > 5000)
GROUP BY s.shell_id, s.id_short, s.s_suppkey
""", ["shells", "submodel_refs", "submodels"])
def export_documents(fx):
    """One document per pending shell; a whole brand of submodels has no idShort."""
    sm = fx.submodels().withColumn("id_short", F.when(F.col("semantic_group") == "Brand#11", None).otherwise(F.col("id_short")))
    d = TW.export_documents(fx.shells(), fx.submodel_refs(), sm.select("submodel_id", "id_short"), exported_manifest(fx))
    text = F.transform("submodels", lambda m: F.concat(m["submodel_id"], F.lit("="), F.coalesce(m["id_short"], F.lit("none"))))
    return d.select("shell_id", "id_short", "s_suppkey", "n_dangling", F.size("submodels").cast("long").alias("n_submodels"), F.array_join(text, ",").alias("submodels"))


HOT_REFS_SQL = """(SELECT CASE WHEN l_orderkey % 3 = 0 THEN (SELECT min(shell_id) FROM shells) ELSE shell_id END AS shell_id, submodel_id, l_orderkey * 8 + l_linenumber AS pos
  FROM lineitem JOIN shells ON s_suppkey = l_suppkey JOIN submodels ON submodel_id = 'https://example.com/ids/sm/0000_0000_' || lpad(CAST(l_partkey AS VARCHAR), CAST(greatest(8, length(CAST(l_partkey AS VARCHAR))) AS INT), '0'))"""


@register("export_parts", f"""
WITH r AS {HOT_REFS_SQL}
SELECT 'first' AS export, s.shell_id, s.id_short, s.s_suppkey, pos // 500 AS part, count(*) AS n_submodels, string_agg(r.submodel_id, ',' ORDER BY pos, r.submodel_id) AS submodels
FROM r JOIN shells s ON s.shell_id = r.shell_id GROUP BY s.shell_id, s.id_short, s.s_suppkey, pos // 500
UNION ALL SELECT 'first', shell_id, id_short, s_suppkey, 0, 0, '' FROM shells WHERE shell_id NOT IN (SELECT shell_id FROM r)
""", ["shells", "submodels"])
def export_parts(fx):
    """Exported documents in parts, in the order of reference; one shell has a third of all references.  Of three writes one
    fails and one repeats a name: only the first is there."""
    li = fx.lineitem
    low = fx.shells().agg(F.min("shell_id").alias("_low"))
    refs = li.select(F.when(F.col("l_orderkey") % 3 == 0, None).otherwise(shell_iri("l_suppkey")).alias("shell_id"), submodel_iri("l_partkey").alias("submodel_id"),
                     (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("pos"))
    refs = refs.withColumn("shell_id", F.coalesce("shell_id", F.lit(low.first()[0])))
    parts = TW.export_parts(fx.shells(), refs, fx.submodels().select("submodel_id", "price"), fx.shells().limit(0), part_size=500, tasks=fx.tasks("lineitem"))
    path = scratch_path(fx.spark, "runs", f"export-{uuid.uuid4().hex[:12]}")
    schema = parts.schema
    parts.write.option("compression", "zstd").parquet(f"{path}/parts")  # built once for all three writes
    parts = fx.spark.read.schema(schema).parquet(f"{path}/parts")
    broken = parts.withColumn("part", F.when(F.col("part") > 3, F.raise_error(F.lit("no more room")).cast("long")).otherwise(F.col("part")))
    try:
        TW.write_export(broken, path, "broken")
        raise AssertionError("the write should have failed")
    except SparkRuntimeException:
        pass
    TW.write_export(parts, path, "first")
    TW.write_export(parts.limit(1), path, "first")
    done = TW.read_exports(fx.spark, path, schema)
    return done.select("export", "shell_id", "id_short", "s_suppkey", "part", F.size("submodels").cast("long").alias("n_submodels"),
                       F.array_join(F.transform("submodels", lambda m: m["submodel_id"]), ",").alias("submodels"))


@register("orphans", """
SELECT m.* FROM submodels m WHERE NOT EXISTS (SELECT 1 FROM submodel_refs r WHERE r.submodel_id = m.submodel_id)
""", ["submodels", "submodel_refs"])
def orphans(fx):
    return TW.orphans(fx.submodels(), fx.submodel_refs())


@register("orphans_template", """
SELECT m.* FROM submodels m WHERE NOT EXISTS (SELECT 1 FROM submodel_refs r WHERE r.submodel_id = m.submodel_id) AND substr(m.submodel_id, length(m.submodel_id) - 1, 1) NOT IN ('1', '5')
""", ["submodels", "submodel_refs"])
def orphans_template(fx):
    """Submodels that neither a shell nor the template shell refers to."""
    template = fx.submodels().where(F.substring("submodel_id", -2, 1).isin("1", "5")).select("submodel_id")
    return TW.orphans(fx.submodels(), fx.submodel_refs(), template)


@register("shared_submodels", """
SELECT submodel_id, count(DISTINCT shell_id) AS n_shells FROM submodel_refs GROUP BY submodel_id HAVING count(DISTINCT shell_id) > 1
""", ["submodel_refs"])
def shared_submodels(fx):
    return TW.shared_submodels(fx.submodel_refs())


@register("dup_idshort", """
SELECT id_short, count(*) AS n_submodels, min(submodel_id) AS first_id, max(submodel_id) AS last_id
FROM submodels GROUP BY id_short HAVING count(*) > 1
""", ["submodels"])
def dup_idshort(fx):
    return TW.idshort_collisions(fx.submodels())


@register("link_unlink", f"""
WITH valid AS (
  SELECT min(k.shell_id) AS shell_id, k.submodel_id FROM {LINKS_SQL.format(w="true")} k
  WHERE k.submodel_id IN (SELECT submodel_id FROM submodels) AND k.submodel_id NOT IN (SELECT submodel_id FROM submodel_refs)
  GROUP BY k.submodel_id),
added AS (SELECT shell_id, submodel_id FROM submodel_refs UNION SELECT shell_id, submodel_id FROM valid)
SELECT a.shell_id, a.submodel_id FROM added a
WHERE NOT EXISTS (SELECT 1 FROM {LINKS_SQL.format(w="l_returnflag = 'R'")} u
                  WHERE u.shell_id = a.shell_id AND u.submodel_id = a.submodel_id)
""", ["submodel_refs", "submodels"])
def link_unlink(fx):
    return TW.apply_links(fx.submodel_refs(), fx.submodels(), link_requests(fx), unlink_requests(fx), tasks=fx.tasks("lineitem"))


@register("change_log_state", """
WITH w AS (SELECT *, LAG(op) OVER (PARTITION BY id ORDER BY seq) AS prev FROM change_log WHERE op <> 'patch'),
f AS (SELECT * FROM w WHERE NOT (op = 'create' AND prev IS NOT NULL AND prev <> 'delete')),
b AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY id ORDER BY seq DESC) AS rn FROM f) WHERE rn = 1 AND op <> 'delete'),
a AS (SELECT id, seq, op, body FROM b UNION ALL
  SELECT c.id, c.seq, c.op, c.body FROM change_log c JOIN b ON c.id = b.id AND c.seq > b.seq WHERE c.op = 'patch')
SELECT id, seq, op, body FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY id ORDER BY seq DESC) AS rn FROM a) WHERE rn = 1
""", ["change_log"])
def change_log_state(fx):
    return TW.change_log_state(fx.change_log())


@register("change_log_conflicts", """
SELECT id, seq, op, body FROM (
  SELECT *, max(CASE WHEN op IN ('create', 'replace') THEN seq END) OVER w AS written, max(CASE WHEN op = 'delete' THEN seq END) OVER w AS deleted FROM change_log
  WINDOW w AS (PARTITION BY id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
WHERE op = 'create' AND written > coalesce(deleted, written - 1)
""", ["change_log"])
def change_log_conflicts(fx):
    return TW.change_log_conflicts(fx.change_log())


def listing_responses(fx):
    """Shell-listing responses: wrapped, bare and error shapes."""
    s = fx.shells()
    item = F.concat(F.lit('{"id":"'), F.col("shell_id"), F.lit('","idShort":"'), F.col("id_short"),
                    F.lit('","assetInformation":{"assetKind":"Instance","globalAssetId":"'), F.col("shell_id"),
                    F.lit('"}}'))
    k = F.col("s_suppkey") % 3
    body = F.when(k == 0, F.concat(F.lit('{"result":['), item, F.lit("]}"))) \
            .when(k == 1, F.concat(F.lit("["), item, F.lit("]"))).otherwise(F.lit('{"error":"unavailable"}'))
    return s.select(F.col("s_suppkey").alias("response_id"), body.alias("body"))


@register("shell_listing", """
SELECT s_suppkey AS response_id, shell_id, id_short, 'Instance' AS asset_kind, shell_id AS global_asset_id
FROM shells WHERE s_suppkey % 3 <> 2
""", ["shells"])
def shell_listing(fx):
    shells, _ = TW.shell_listing(listing_responses(fx), keep=("response_id",))
    return shells


@register("shell_listing_rejects", """
SELECT s_suppkey AS response_id, '{"error":"unavailable"}' AS raw_body, 'unexpected shape' AS reason
FROM supplier WHERE s_suppkey % 3 = 2
""")
def shell_listing_rejects(fx):
    _, rejects = TW.shell_listing(listing_responses(fx), keep=("response_id",))
    return rejects


@register("all_submodels", """
SELECT m.submodel_id, m.id_short, m.semantic_group, m.price, e.elements_json
FROM submodels m LEFT JOIN element_trees e ON m.submodel_id = e.submodel_id
""", ["submodels", "element_trees"])
def all_submodels(fx):
    """Every submodel with its element tree (the store's full listing)."""
    tasks = fx.tasks("part", rows=100_000)  # trees are long texts, and a session counts shuffled bytes, packed
    return fx.submodels().repartition(tasks, "submodel_id").join(fx.element_trees(tasks), "submodel_id", "left")


def submodel_files(fx):
    """Documents of six shapes over the element trees: an object, a list, wrapped lists, broken text, a number, and a list with an item without an id."""
    k = F.col("p_partkey")
    one = lambda key: F.concat(F.lit('{"id":"sm'), key.cast("string"), F.lit('","idShort":"p'), key.cast("string"),
                               F.lit('","kind":"Instance","submodelElements":[{"modelType":"Property","idShort":"Size","value":"'), F.col("p_size").cast("string"), F.lit('"}]}'))
    body = F.when(k % 6 == 0, one(k)).when(k % 6 == 1, F.concat(F.lit("["), one(k), F.lit(",\n"), one(-k), F.lit("]"))) \
        .when(k % 6 == 2, F.concat(F.lit('{"result":['), one(k), F.lit("]}"))).when(k % 6 == 3, F.concat(F.lit('{"id": "sm'), k.cast("string"))) \
        .when(k % 6 == 4, k.cast("string")).otherwise(F.concat(F.lit('{"submodels":['), one(k), F.lit(',{"idShort":"x","modelType":"Submodel"}]}')))
    return fx.part.select(F.regexp_replace(body, "\n", " ").alias("value"))


def _submodel_folder(fx):
    path = scratch_path(fx.spark, "runs", f"submodels-{uuid.uuid4().hex[:12]}")
    submodel_files(fx).write.text(path)
    return path


@register("submodels_read", """
SELECT 'sm' || k AS submodel_id, 'p' || k AS id_short, 'Instance' AS kind, CAST(NULL AS VARCHAR) AS model_type, '[{"idShort":"Size","modelType":"Property","value":"' || p_size || '"}]' AS elements_json
FROM (SELECT p_partkey AS k, p_size FROM part WHERE p_partkey % 6 IN (0, 1, 2, 5) UNION ALL SELECT -p_partkey, p_size FROM part WHERE p_partkey % 6 = 1)
""")
def submodels_read(fx):
    """Submodels from JSON documents of different shapes, read in one pass without a schema."""
    return TW.read_submodels(fx.spark, _submodel_folder(fx), whole_files=False)


@register("submodels_rejected", """
SELECT CASE p_partkey % 6 WHEN 3 THEN '{"id": "sm' || p_partkey WHEN 4 THEN CAST(p_partkey AS VARCHAR) ELSE '{"submodels":[{"id":"sm' || p_partkey || '","idShort":"p' || p_partkey
    || '","kind":"Instance","submodelElements":[{"modelType":"Property","idShort":"Size","value":"' || p_size || '"}]},{"idShort":"x","modelType":"Submodel"}]}' END AS raw_body,
  CASE p_partkey % 6 WHEN 3 THEN 'broken JSON' WHEN 4 THEN 'not an object' ELSE 'no id' END AS reason
FROM part WHERE p_partkey % 6 IN (3, 4, 5)
""")
def submodels_rejected(fx):
    return TW.rejected_submodels(fx.spark, _submodel_folder(fx), whole_files=False).drop("file")


@register("shell_violations", r"""
SELECT shell_id, 'id_form' AS rule FROM shells
  WHERE s_suppkey % 3 <> 2 AND NOT coalesce(regexp_full_match(shell_id, '^https://example\.com/ids/(sm|aas)/\d{4}_\d{4}_\d{4}_\d{4}$'), false)
UNION ALL SELECT shell_id, 'idshort_suffix' FROM shells
  WHERE s_suppkey % 3 <> 2 AND NOT coalesce(regexp_matches(id_short, '_\d{3}$'), false)
""", ["shells"])
def shell_violations(fx):
    """Write rules over the listed shells (globalAssetId equals the id here)."""
    from ..operators import elements as EL
    shells, _ = TW.shell_listing(listing_responses(fx), keep=("response_id",))
    return EL.shell_violations(shells)
