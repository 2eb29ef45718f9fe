"""Submodel element trees: flatten, lookups by path, leaves, flags, rules.

A tree arrives as JSON text (the submodel's ``submodelElements``).  One
submodel is one document, so its tree is bounded by a row; it is parsed
once into a VARIANT and unrolled some levels inside the row with
higher-order functions, then exploded: one scan, no shuffle; only trees
that are deeper go on level by level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


# AAS V3 model types.
CONTAINER_TYPES = ("SubmodelElementCollection", "SubmodelElementList", "Entity",
                   "AnnotatedRelationshipElement", "Operation")
LEAF_TYPES = ("Property", "MultiLanguageProperty", "File", "Blob", "ReferenceElement", "Range",
              "RelationshipElement", "BasicEventElement")

FLAT_COLUMNS = ["path", "parent_path", "depth", "pos", "id_short", "model_type", "value_type", "value",
                "min", "max", "content_type"]

_VARR = "array<variant>"


def _get(el: Column, field: str, typ: str = "string") -> Column:
    return F.try_variant_get(el, f"$.{field}", typ)


# The level expressions are written as SQL text (one ``F.expr`` per level):
# the same expression tree, built with one call into the JVM instead of
# thousands of small Column calls on the driver.
_EMPTY = f"cast(array() as {_VARR})"


def _get_sql(el: str, field: str, typ: str = "string") -> str:
    return f"try_variant_get({el}, '$.{field}', '{typ}')"


def _children_sql(el: str, v: str) -> str:
    """SQL of the child elements of a container element (empty otherwise)."""
    mt = _get_sql(el, "modelType")

    def opvars(field):
        return (f"coalesce(transform({_get_sql(el, field, _VARR)}, {v} -> try_variant_get({v}, '$.value', 'variant')),"
                f" {_EMPTY})")

    return (f"coalesce(CASE WHEN {mt} IN ('SubmodelElementCollection', 'SubmodelElementList') "
            f"THEN {_get_sql(el, 'value', _VARR)} "
            f"WHEN {mt} = 'Entity' THEN {_get_sql(el, 'statements', _VARR)} "
            f"WHEN {mt} = 'AnnotatedRelationshipElement' THEN {_get_sql(el, 'annotations', _VARR)} "
            f"WHEN {mt} = 'Operation' THEN concat({opvars('inputVariables')}, {opvars('outputVariables')}, "
            f"{opvars('inoutputVariables')}) END, {_EMPTY})")


def _level_sql(depth: int) -> str:
    """SQL building level ``depth`` from level ``depth - 1`` (list children
    get ``[i]`` path segments, others ``.idShort``)."""
    x, c, i, v = f"x{depth}", f"c{depth}", f"i{depth}", f"v{depth}"
    ptype = _get_sql(f"{x}.el", "modelType")
    path = (f"CASE WHEN {ptype} = 'SubmodelElementList' THEN concat({x}.path, '[', cast({i} AS STRING), ']') "
            f"ELSE concat({x}.path, '.', {_get_sql(c, 'idShort')}) END")
    node = f"named_struct('path', {path}, 'parent_path', {x}.path, 'depth', {depth}, 'pos', {i}, 'el', {c})"
    return f"flatten(transform(_l{depth - 1}, {x} -> transform({_children_sql(f'{x}.el', v)}, ({c}, {i}) -> {node})))"


def common_attributes(el: Column) -> list[Column]:
    """Attributes every element may carry: category, semanticId (first key),
    supplementalSemanticIds (first keys), displayName / description as language maps, qualifiers as structs."""
    lang = "array<struct<language: string, text: string>>"
    return [
        _get(el, "category").alias("category"),
        F.try_variant_get(el, "$.semanticId.keys[0].value", "string").alias("semantic_id"),
        lang_strings_to_map(_get(el, "displayName", lang)).alias("display_name"),
        lang_strings_to_map(_get(el, "description", lang)).alias("description"),
        F.transform(_get(el, "supplementalSemanticIds", "array<struct<keys: array<struct<type: string, value: string>>>>"),
                    lambda r: F.try_element_at(r["keys"], F.lit(1))["value"]).alias("supplemental_semantic_ids"),
        _get(el, "qualifiers", "array<struct<kind: string, type: string, valueType: string, value: string>>").alias("qualifiers"),
    ]


def typed_fields(el: Column) -> list[Column]:
    """Fields that single element types have besides the value: references as their last key (RelationshipElement,
    BasicEventElement, value ids), event settings, entity and list attributes; and the JSON type of the value."""
    ref = lambda field: F.try_variant_get(el, f"$.{field}.keys", "array<struct<type: string, value: string>>")
    last = lambda field, name: F.try_element_at(ref(field), F.lit(-1))["value"].alias(name)
    plain = {"direction": "direction", "state": "state", "messageTopic": "message_topic", "minInterval": "min_interval", "maxInterval": "max_interval",
             "entityType": "entity_type", "globalAssetId": "global_asset_id", "typeValueListElement": "list_element_type",
             "valueTypeListElement": "list_value_type", "orderRelevant": "order_relevant"}
    return [last("first", "first_key"), last("second", "second_key"), last("observed", "observed_key"), last("valueId", "value_id_key"),
            *[_get(el, f).alias(n) for f, n in plain.items()],
            F.schema_of_variant(F.try_variant_get(el, "$.value", "variant")).alias("value_kind")]


def element_rejects(df: DataFrame, key: str = "submodel_id", json_col: str = "elements_json") -> DataFrame:
    """Submodels whose element JSON cannot be read as an array: ``key, raw_value, reason``."""
    v = F.try_parse_json(F.col(json_col))
    reason = F.when(F.col(json_col).isNull(), "missing").when(v.isNull(), "broken JSON") \
              .when(F.try_variant_get(v, "$", _VARR).isNull(), "not an array")
    return df.select(key, F.col(json_col).alias("raw_value"), reason.alias("reason")).where("reason is not null")


def _levels(df: DataFrame, key: str, json_col: str, unroll: int) -> DataFrame:
    """Nodes of the levels 0 to ``unroll``, built inside the row and exploded once."""
    top = f"coalesce(try_variant_get(try_parse_json(`{json_col}`), '$', '{_VARR}'), {_EMPTY})"
    level0 = (f"transform({top}, (e0, i0) -> named_struct('path', {_get_sql('e0', 'idShort')}, "
              f"'parent_path', cast(NULL AS STRING), 'depth', 0, 'pos', i0, 'el', e0))")
    cur = df.select(key, F.expr(level0).alias("_l0"))
    for d in range(1, unroll + 1):
        cur = cur.withColumn(f"_l{d}", F.expr(_level_sql(d)))
    return cur.select(key, F.explode(F.concat(*[F.col(f"_l{d}") for d in range(unroll + 1)])).alias("n"))


def _below(nodes: DataFrame, key: str) -> DataFrame:
    """Children of nodes, one level down, as nodes."""
    x = F.col("x")
    kids = nodes.select(key, F.col("n").alias("x"), F.posexplode(F.expr(_children_sql("n.el", "w"))).alias("i", "c"))
    path = F.when(_get(x["el"], "modelType") == "SubmodelElementList", F.concat(x["path"], F.lit("["), F.col("i").cast("string"), F.lit("]"))) \
            .otherwise(F.concat(x["path"], F.lit("."), _get(F.col("c"), "idShort")))
    return kids.select(key, F.struct(path.alias("path"), x["path"].alias("parent_path"), (x["depth"] + 1).alias("depth"),
                                     F.col("i").alias("pos"), F.col("c").alias("el")).alias("n"))


def _deeper_than(text: Column, levels: int) -> Column:
    """Whether the text has more than ``levels`` arrays in one another; nothing is parsed for it.  Strings are taken out
    first, then level by level the arrays without an array; texts that are no JSON may be either."""
    bare = F.regexp_replace(F.replace(F.replace(text, F.lit("\\\\"), F.lit("")), F.lit('\\"'), F.lit("")), '"[^"]*+"', "")
    left = F.regexp_replace(bare, r"[^\[\]]++", "")
    for _ in range(levels):
        left = F.replace(left, F.lit("[]"), F.lit(""))
    return F.length(left) > 0


def flatten_elements(df: DataFrame, key: str = "submodel_id", json_col: str = "elements_json",
                     unroll: int = 8, with_common: bool = False, with_typed: bool = False) -> DataFrame:
    """Rows ``key, path, parent_path, depth, pos, id_short, model_type,
    value_type, value, min, max, content_type`` for every element, at any depth.

    Single pass: the tree is parsed once into a VARIANT; level k+1 is built
    from level k inside the row with ``transform``/``flatten`` (one
    projection per level, each computed once), then all levels are
    concatenated and exploded.  No union of re-scanned levels, no shuffle.
    Trees deeper than ``unroll`` (looked for only among texts with that many arrays in one another) go on level by
    level from a checkpoint of their lowest nodes.  An element without ``modelType`` is a Property."""
    nodes = _levels(df, key, json_col, unroll)
    text = F.col(json_col)
    maybe = df.where(F.length(text) - F.length(F.replace(text, F.lit("["))) > unroll).where(_deeper_than(text, unroll + 1))
    if not maybe.select(key).isEmpty():  # a look at the texts alone; nothing is parsed for it
        low = _levels(maybe, key, json_col, unroll).where(F.col("n.depth") == unroll)
        more = _below(low, key)
        ensure_checkpoint_dir(df.sparkSession)
        while True:
            more = more.checkpoint(eager=True)
            if more.isEmpty():
                break
            nodes = nodes.unionByName(more)
            more = _below(more, key)
    n = nodes.select(key, "n")
    el = F.col("n.el")
    model_type = F.coalesce(_get(el, "modelType"), F.lit("Property"))
    return n.select(
        key, F.col("n.path").alias("path"), F.col("n.parent_path").alias("parent_path"),
        F.col("n.depth").alias("depth"), F.col("n.pos").alias("pos"), _get(el, "idShort").alias("id_short"),
        model_type.alias("model_type"), _get(el, "valueType").alias("value_type"),
        F.when(~model_type.isin(*CONTAINER_TYPES), F.coalesce(_get(el, "value"), F.to_json(F.try_variant_get(el, "$.value", "variant"))))
         .alias("value"),
        _get(el, "min").alias("min"), _get(el, "max").alias("max"), _get(el, "contentType").alias("content_type"),
        *(common_attributes(el) if with_common else []), *(typed_fields(el) if with_typed else []))


def element_values(flat: DataFrame, requests: DataFrame, key: str = "submodel_id") -> DataFrame:
    """Value of the element at a dotted path for many (submodel, path) requests."""
    f = flat.select(key, "path", "model_type", "value", F.lit(True).alias("_hit"))
    out = requests.join(f, [key, "path"], "left")
    return out.withColumn("found", F.coalesce(F.col("_hit"), F.lit(False))).drop("_hit")


def leaves(flat: DataFrame, types=("Property",)) -> DataFrame:
    """Named leaves (nested ones included) with their values."""
    return flat.where(F.col("model_type").isin(*types))


# Preprocessing flag paths and the step each one enables.
FLAG_PATHS = {
    "Cleansing.Enabled": "cleansing",
    "Imputation.Enabled": "imputation",
    "Normalization.Enabled": "normalize",
    "Transformation.Enabled": "transformation",
}
FLAG_PREFIXES = ("PreProcessing.", "PreProcess.")


def preprocessing_flags(flat: DataFrame, key: str = "submodel_id") -> DataFrame:
    """Four booleans per submodel; empty or missing flag = false and listed
    in ``review_needed`` (comma-separated)."""
    p = F.col("path")
    for pre in FLAG_PREFIXES:
        p = F.when(p.startswith(pre), F.substring(p, F.lit(len(pre) + 1), F.length(p))).otherwise(p)
    f = flat.select(key, p.alias("fpath"), "value").where(F.col("fpath").isin(*FLAG_PATHS))
    piv = f.groupBy(key).pivot("fpath", list(FLAG_PATHS)).agg(F.max("value"))
    raw = {name: F.nullif(F.trim(F.col(f"`{path}`")), F.lit("")) for path, name in FLAG_PATHS.items()}
    flags = [F.coalesce(F.lower(raw[n]).try_cast("boolean"), F.lit(False)).alias(n) for n in FLAG_PATHS.values()]
    review = F.array_join(F.array_compact(F.array(*[F.when(raw[n].isNull() | F.lower(raw[n]).try_cast("boolean").isNull(),
                                                           F.lit(n)) for n in FLAG_PATHS.values()])), ",")
    return piv.select(key, *flags, review.alias("review_needed"))


def all_preprocessing_flags(flat: DataFrame, submodels: DataFrame, key: str = "submodel_id") -> DataFrame:
    """Flags for every submodel, including those without any flag element."""
    f = preprocessing_flags(flat, key)
    base = submodels.select(key).distinct()
    out = base.join(f, key, "left")
    names = list(FLAG_PATHS.values())
    return out.select(key, *[F.coalesce(F.col(n), F.lit(False)).alias(n) for n in names],
                      F.coalesce(F.col("review_needed"), F.lit(",".join(names))).alias("review_needed"))


# -- payload rules -----------------------------------------------------------

# Identifier and idShort forms required by the write rules.
IRI_PATTERN = r"^https://example\.com/ids/(sm|aas)/\d{4}_\d{4}_\d{4}_\d{4}$"
IDSHORT_SUFFIX = r"_\d{3}$"


def element_violations(flat: DataFrame, key: str = "submodel_id") -> DataFrame:
    """One row per element violating a value rule.  With the typed fields (``value_kind``) a literal
    JSON boolean is told from the text that the rule asks for."""
    vt, v = F.col("value_type"), F.col("value")
    literal = F.col("value_kind").eqNullSafe("BOOLEAN") if "value_kind" in flat.columns else F.lit(False)
    rules = F.array_compact(F.array(
        F.when(vt.isNotNull() & ~vt.startswith("xs:"), F.lit("valuetype_prefix")),
        F.when((vt == "xs:boolean") & (v.isNull() | ~v.isin("true", "false") | literal), F.lit("boolean_text")),
        F.when(vt.isin("xs:date", "xs:dateTime") & v.try_cast("timestamp_ntz").isNull(), F.lit("iso_date")),
        F.when((F.col("model_type") == "File") & (v.isNull() | F.col("content_type").isNull()),
               F.lit("file_incomplete")),
    ))
    return flat.select(key, "path", F.explode(rules).alias("rule"))


def root_violations(submodels: DataFrame, key: str = "submodel_id", id_short: str = "id_short") -> DataFrame:
    rules = F.array_compact(F.array(
        F.when(~F.coalesce(F.col(key).rlike(IRI_PATTERN), F.lit(False)), F.lit("id_form")),
        F.when(~F.coalesce(F.col(id_short).rlike(IDSHORT_SUFFIX), F.lit(False)), F.lit("idshort_suffix")),
    ))
    return submodels.select(key, F.lit(None).cast("string").alias("path"), F.explode(rules).alias("rule"))


def shell_violations(shells: DataFrame, key: str = "shell_id", id_short: str = "id_short",
                     global_asset_id: str = "global_asset_id") -> DataFrame:
    """Shell write rules: numeric IRI form, ``_NNN`` idShort suffix and
    ``globalAssetId`` equal to the shell id."""
    rules = F.array_compact(F.array(
        F.when(~F.coalesce(F.col(key).rlike(IRI_PATTERN), F.lit(False)), F.lit("id_form")),
        F.when(~F.coalesce(F.col(id_short).rlike(IDSHORT_SUFFIX), F.lit(False)), F.lit("idshort_suffix")),
        F.when(~F.col(global_asset_id).eqNullSafe(F.col(key)), F.lit("global_asset_id")),
    ))
    return shells.select(key, F.explode(rules).alias("rule"))


# Root fields of a valid AAS V3 submodel payload, and
# fields that must not appear.
REQUIRED_ROOT = ("id", "idShort", "modelType", "kind", "submodelElements")
FORBIDDEN_ROOT = ("idType", "identification", "semanticId")


def payload_violations(payloads: DataFrame, key: str, json_col: str) -> DataFrame:
    """Root-shape rules of a submodel payload given as JSON text."""
    keys = F.json_object_keys(F.col(json_col))
    rules = F.array_compact(F.array(
        F.when(keys.isNull(), F.lit("not_an_object")),
        *[F.when(keys.isNotNull() & ~F.array_contains(keys, k), F.lit(f"missing_{k}")) for k in REQUIRED_ROOT],
        *[F.when(F.array_contains(keys, k), F.lit(f"forbidden_{k}")) for k in FORBIDDEN_ROOT],
    ))
    return payloads.select(key, F.explode(rules).alias("rule"))


def lang_strings_to_map(arr: Column) -> Column:
    """``[{language, text}]`` -> ``MAP<language, text>`` (last wins)."""
    last = F.filter(arr, lambda e, i: ~F.exists(F.slice(arr, i + 2, F.size(arr)), lambda later: later["language"].eqNullSafe(e["language"])))
    return F.map_from_entries(F.transform(F.filter(last, lambda e: e["language"].isNotNull()), lambda e: F.struct(e["language"], e["text"])))


def reference_key(ref: Column, which: str = "first") -> Column:
    """A reference's key value: ``keys[0]`` (enrichment) or the last key."""
    keys = ref["keys"]
    return F.element_at(keys, 1)["value"] if which == "first" else F.element_at(keys, -1)["value"]
