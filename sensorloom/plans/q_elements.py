"""Queries over submodel element trees and pipeline stage rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import elements as EL
from ..operators import rules as RU
from ..sources.tables import dealt
from .registry import register

SM = "'https://example.com/ids/sm/0000_0000_' || lpad(CAST(p_partkey AS VARCHAR), CAST(greatest(8, length(CAST(p_partkey AS VARCHAR))) AS INT), '0')"
FLAG = "CASE p_partkey % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE '' END"
N = "CAST(NULL AS VARCHAR)"
# Expected flattened rows, generated from the part keys (4 per part).
FLAT_SQL = f"""(
SELECT {SM} AS submodel_id, 'Cleansing' AS path, {N} AS parent_path, 0 AS depth, 0 AS pos, 'Cleansing' AS id_short,
  'SubmodelElementCollection' AS model_type, {N} AS value_type, {N} AS value, {N} AS min, {N} AS max, {N} AS content_type FROM part
UNION ALL SELECT {SM}, 'Cleansing.Enabled', 'Cleansing', 1, 0, 'Enabled', 'Property', 'xs:boolean', {FLAG}, {N}, {N}, {N} FROM part
UNION ALL SELECT {SM}, 'Size', {N}, 0, 1, 'Size', 'Range', 'xs:int', {N}, '0', CAST(p_size AS VARCHAR), {N} FROM part
UNION ALL SELECT {SM}, 'Brand', {N}, 0, 2, 'Brand', 'Property', 'xs:string', p_brand, {N}, {N}, {N} FROM part)"""

REQUEST_PATHS = ["Brand", "Cleansing.Enabled", "Imputation.Enabled"]


def flat(fx):
    return EL.flatten_elements(fx.element_trees())


@register("elements_flat", f"SELECT * FROM {FLAT_SQL}")
def elements_flat(fx):
    return flat(fx)


@register("element_values", f"""
SELECT q.submodel_id, q.path, f.model_type, f.value, f.submodel_id IS NOT NULL AS found
FROM (SELECT DISTINCT submodel_id, unnest(['Brand', 'Cleansing.Enabled', 'Imputation.Enabled']) AS path FROM submodel_refs) q
LEFT JOIN {FLAT_SQL} f ON q.submodel_id = f.submodel_id AND q.path = f.path
""", ["submodel_refs"])
def element_values(fx):
    req = fx.submodel_refs().select("submodel_id").distinct() \
            .select("submodel_id", F.explode(F.array(*[F.lit(p) for p in REQUEST_PATHS])).alias("path"))
    return EL.element_values(flat(fx), req)


@register("element_leaves", f"SELECT submodel_id, path, value_type, value FROM {FLAT_SQL} WHERE model_type = 'Property'")
def element_leaves(fx):
    return EL.leaves(flat(fx)).select("submodel_id", "path", "value_type", "value")


@register("asset_flags", f"""
SELECT {SM} AS submodel_id, p_partkey % 3 = 0 AS cleansing, false AS imputation, false AS normalize, false AS transformation,
  CASE WHEN p_partkey % 3 = 2 THEN 'cleansing,imputation,normalize,transformation' ELSE 'imputation,normalize,transformation' END
    AS review_needed
FROM part
""")
def asset_flags(fx):
    """Preprocessing flags per submodel from its element tree."""
    return EL.all_preprocessing_flags(flat(fx), fx.element_trees())


@register("payload_violations", f"""
SELECT m.submodel_id, {N} AS path, 'id_form' AS rule FROM submodels m
  WHERE NOT coalesce(regexp_full_match(m.submodel_id, '^https://example\\.com/ids/(sm|aas)/\\d{{4}}_\\d{{4}}_\\d{{4}}_\\d{{4}}$'), false)
UNION ALL SELECT m.submodel_id, NULL, 'idshort_suffix' FROM submodels m
  WHERE NOT coalesce(regexp_matches(m.id_short, '_\\d{{3}}$'), false)
UNION ALL SELECT f.submodel_id, f.path, 'boolean_text' FROM {FLAT_SQL} f JOIN submodels m ON f.submodel_id = m.submodel_id
  WHERE f.value_type = 'xs:boolean' AND (f.value IS NULL OR f.value NOT IN ('true', 'false'))
""", ["submodels"])
def payload_violations(fx):
    sm = fx.submodels()
    f = flat(fx).join(sm.select("submodel_id"), "submodel_id", "left_semi")
    return EL.root_violations(sm).unionByName(EL.element_violations(f))


@register("lang_map", """
SELECT source, lang AS language, arg_min(split_part(text, chr(10), 1), doc_id) AS text FROM documents GROUP BY source, lang
""")
def lang_map(fx):
    """Language strings per source (first line of its lowest doc per
    language), folded into a MAP and read back as rows."""
    d = fx.documents
    entries = d.groupBy("source", F.col("lang").alias("language")).agg(
        F.min_by(F.split(F.col("text"), "\n", -1)[0], F.col("doc_id")).alias("text"))
    # at most one entry per (source, language): the map is bounded by the language count
    per_source = entries.groupBy("source").agg(
        EL.lang_strings_to_map(F.collect_list(F.struct("language", "text"))).alias("m"))
    return per_source.select("source", F.explode("m").alias("language", "text"))


# -- stage rules ---------------------------------------------------------------

@register("stage_chain", """
SELECT pipeline_id, rank, component, aas_destination, expected_destination FROM (
  SELECT *, LEAD(component) OVER (PARTITION BY pipeline_id ORDER BY rank) AS expected_destination FROM stages)
WHERE aas_destination IS DISTINCT FROM expected_destination
""", ["stages"])
def stage_chain(fx):
    return RU.chain_violations(fx.stages())


@register("stage_order", """
SELECT pipeline_id, count(*) AS n_stages,
  concat_ws(',', CASE WHEN count(*) FILTER (WHERE stage = 'Collection') = 0 THEN 'Collection' END,
                 CASE WHEN count(*) FILTER (WHERE stage IN ('PreProcess', 'PreProcessing')) = 0 THEN 'PreProcess' END,
                 CASE WHEN count(*) FILTER (WHERE stage = 'Storage') = 0 THEN 'Storage' END) AS missing_mandatory,
  count(*) FILTER (WHERE canon IS NULL OR prev >= canon) = 0 AS order_ok
FROM (SELECT *, LAG(canon) OVER (PARTITION BY pipeline_id ORDER BY rank) AS prev FROM (
  SELECT *, CASE stage WHEN 'Collection' THEN 1 WHEN 'Integration' THEN 2 WHEN 'PreProcess' THEN 3 WHEN 'PreProcessing' THEN 3
    WHEN 'Storage' THEN 4 WHEN 'Processing' THEN 5 WHEN 'Utilization' THEN 6 END AS canon FROM stages))
GROUP BY pipeline_id
""", ["stages"])
def stage_order(fx):
    return RU.order_check(fx.stages())


@register("protocol_gap", """
SELECT c.pipeline_id, c.protocol AS collection_protocol, p.protocol AS preprocess_protocol
FROM stages c JOIN stages p ON c.pipeline_id = p.pipeline_id AND c.stage = 'Collection' AND p.stage IN ('PreProcess', 'PreProcessing')
WHERE c.protocol IS DISTINCT FROM p.protocol
  AND NOT EXISTS (SELECT 1 FROM stages i WHERE i.pipeline_id = c.pipeline_id AND i.stage = 'Integration')
""", ["stages"])
def protocol_gap(fx):
    return RU.protocol_gaps(fx.stages())


def bridge_requests(fx):
    """Bridge deployment requests derived from orders."""
    o = fx.orders
    src = F.element_at(F.array(*[F.lit(x) for x in ("opcua", "mqtt", "modbus", "http", "tcp", "coap")]),
                       (F.col("o_custkey") % 6 + 1).cast("int"))
    tgt = F.element_at(F.array(*[F.lit(x) for x in ("kafka", "http", "mqtt", "tcp", "modbus", "amqp")]),
                       (F.col("o_orderkey") % 6 + 1).cast("int"))
    return o.select(F.col("o_orderkey").alias("bridge_id"), src.alias("source_protocol"), tgt.alias("target_protocol"),
                    (F.col("o_orderkey") % 3).alias("n_paths"),
                    F.when(F.col("o_orderstatus") == "P", F.lit(None).cast("string"))
                     .otherwise(F.concat(F.lit("opcua.c"), F.col("o_custkey").cast("string"), F.lit(".raw"))).alias("topic"))


@register("protocol_pairs", """
WITH b AS (SELECT o_orderkey AS bridge_id, ['opcua','mqtt','modbus','http','tcp','coap'][o_custkey % 6 + 1] AS src,
  ['kafka','http','mqtt','tcp','modbus','amqp'][o_orderkey % 6 + 1] AS tgt, o_orderkey % 3 AS n_paths,
  CASE WHEN o_orderstatus = 'P' THEN NULL ELSE 'opcua.c' || CAST(o_custkey AS VARCHAR) || '.raw' END AS topic FROM orders)
SELECT bridge_id, 'unsupported_source' AS rule FROM b WHERE src NOT IN ('opcua','mqtt','modbus','http','tcp')
UNION ALL SELECT bridge_id, 'unsupported_target' FROM b WHERE tgt NOT IN ('http','mqtt','tcp','modbus','kafka')
UNION ALL SELECT bridge_id, 'opcua_needs_paths' FROM b WHERE src = 'opcua' AND n_paths = 0
UNION ALL SELECT bridge_id, 'kafka_needs_topic' FROM b WHERE tgt = 'kafka' AND coalesce(topic, '') = ''
""")
def protocol_pairs(fx):
    return RU.bridge_violations(bridge_requests(fx))


def deep_trees(fx):
    """A chain of ten collections above a property without type; every seventh text is broken."""
    down = "".join(f'[{{"modelType":"SubmodelElementCollection","idShort":"L{i}","value":' for i in range(10))
    js = F.concat(F.lit(down + '[{"idShort":"V","value":"'), F.col("p_brand"), F.lit('"},{"modelType":"RelationshipElement","idShort":"R","first":{"keys":[{"type":"Property","value":"'),
                  F.col("p_name"), F.lit('"}]}}]' + "}]" * 10))
    return dealt(fx.part.select("p_partkey", "p_brand", "p_name")).select(F.col("p_partkey").alias("submodel_id"), F.when(F.col("p_partkey") % 7 == 0, F.substring(js, 1, 100)).otherwise(js).alias("elements_json"))


DEEP = ".".join(f"L{i}" for i in range(10))


@register("elements_deep", f"""
SELECT p_partkey AS submodel_id, '{DEEP}.V' AS path, 10 AS depth, 'Property' AS model_type, p_brand AS value, {N} AS first_key FROM part WHERE p_partkey % 7 <> 0
UNION ALL SELECT p_partkey, '{DEEP}.R', 10, 'RelationshipElement', {N}, p_name FROM part WHERE p_partkey % 7 <> 0
""")
def elements_deep(fx):
    """Elements below ten levels, of a default type and of a type with a target."""
    f = EL.flatten_elements(deep_trees(fx), with_typed=True)
    return f.where("depth > 9").select("submodel_id", "path", "depth", "model_type", "value", "first_key")


@register("element_rejects", f"""
SELECT p_partkey AS submodel_id, 'broken JSON' AS reason FROM part WHERE p_partkey % 7 = 0
""")
def element_rejects(fx):
    return EL.element_rejects(deep_trees(fx)).select("submodel_id", "reason")


def described_trees(fx):
    """One property per part with every common attribute; a language given twice."""
    js = F.concat(F.lit('[{"modelType":"Property","idShort":"P","category":"PARAMETER","value":"1","semanticId":{"type":"ExternalReference","keys":[{"type":"GlobalReference","value":"'),
                  F.col("p_type"), F.lit('"}]},"supplementalSemanticIds":[{"keys":[{"type":"GlobalReference","value":"'), F.col("p_brand"),
                  F.lit('"}]},{"keys":[{"type":"GlobalReference","value":"x"}]}],"displayName":[{"language":"en","text":"old"},{"language":"en","text":"'), F.col("p_name"),
                  F.lit('"}],"qualifiers":[{"kind":"ConceptQualifier","type":"size","valueType":"xs:int","value":"'), F.col("p_size").cast("string"),
                  F.lit('"}]},{"idShort":"Q","value":"2"}]'))
    return dealt(fx.part.select("p_partkey", "p_type", "p_brand", "p_name", "p_size")).select(F.col("p_partkey").alias("submodel_id"), js.alias("elements_json"))


@register("common_attributes", f"""
SELECT p_partkey AS submodel_id, 'P' AS path, 'PARAMETER' AS category, p_type AS semantic_id, p_brand || ',x' AS supplemental, p_name AS name_en,
  'size=' || CAST(p_size AS VARCHAR) AS qualifier FROM part
UNION ALL SELECT p_partkey, 'Q', {N}, {N}, {N}, {N}, {N} FROM part
""")
def common_attributes(fx):
    f = EL.flatten_elements(described_trees(fx), with_common=True)
    q = F.try_element_at("qualifiers", F.lit(1))
    return f.select("submodel_id", "path", "category", "semantic_id", F.array_join("supplemental_semantic_ids", ",").alias("supplemental"),
                    F.col("display_name")["en"].alias("name_en"), F.concat(q["type"], F.lit("="), q["value"]).alias("qualifier"))


# -- every element type ----------------------------------------------------------

REF = '{"type":"ExternalReference","keys":[{"type":"Submodel","value":"sm%(k)s"},{"type":"Property","value":"%(v)s"}]}'


def _zoo_json() -> str:
    """Element list with one element of each of the model's types; ``@K`` stands for the part's key, ``@S`` for its size."""
    def ref(v):
        return REF % {"k": "@K", "v": v}
    prop = '{"modelType":"Property","idShort":"%s","valueType":"xs:int","value":"@S"}'
    var = '[{"value":{"modelType":"Property","idShort":"%s","valueType":"xs:string","value":"%s"}}]'
    return "[" + ",".join([
        '{"modelType":"Property","idShort":"Flag","valueType":"xs:boolean","value":true}',
        '{"modelType":"MultiLanguageProperty","idShort":"Name","value":[{"language":"de","text":"Teil @K"}]}',
        '{"modelType":"Range","idShort":"Limits","valueType":"xs:int","min":"0","max":"@S"}',
        '{"modelType":"File","idShort":"Manual","value":"/m/@K.pdf","contentType":"application/pdf"}',
        '{"modelType":"File","idShort":"Lost","contentType":"text/plain"}',
        '{"modelType":"Blob","idShort":"Icon","value":"AAEC","contentType":"image/png"}',
        '{"modelType":"ReferenceElement","idShort":"See","value":' + ref("x@K") + "}",
        '{"modelType":"RelationshipElement","idShort":"Link","first":' + ref("a@K") + ',"second":' + ref("b@K") + "}",
        '{"modelType":"AnnotatedRelationshipElement","idShort":"Note","first":' + ref("c@K") + ',"second":' + ref("d@K") + ',"annotations":[' + prop % "Why" + "]}",
        '{"modelType":"Entity","idShort":"Machine","entityType":"SelfManagedEntity","globalAssetId":"urn:@K","statements":[' + prop % "Weight" + "]}",
        '{"modelType":"Operation","idShort":"Start","inputVariables":' + var % ("Speed", "@S") + ',"outputVariables":' + var % ("Done", "no")
        + ',"inoutputVariables":' + var % ("Mode", "auto") + "}",
        '{"modelType":"BasicEventElement","idShort":"Alarm","observed":' + ref("o@K") + ',"direction":"output","state":"on","messageTopic":"t/@K","minInterval":"PT1S"}',
        '{"modelType":"SubmodelElementList","idShort":"Axes","typeValueListElement":"Property","valueTypeListElement":"xs:int","orderRelevant":true,"value":['
        + '{"modelType":"Property","valueType":"xs:int","value":"1"},{"modelType":"Property","valueType":"int","value":"2"}]}',
        '{"modelType":"SubmodelElementCollection","idShort":"Group","value":[' + prop % "Inner" + ',{"modelType":"Property","idShort":"Day","valueType":"xs:date","value":"soon"}]}',
    ]) + "]"


#: What the elements are, stated by themselves: path, type, and what else they have.
ZOO = [
    ("Flag", "Property", {"value_type": "xs:boolean", "value": "true", "value_kind": "BOOLEAN"}),
    ("Name", "MultiLanguageProperty", {"value": '[{"language":"de","text":"Teil @K"}]', "value_kind": "ARRAY<OBJECT<language: STRING, text: STRING>>"}),
    ("Limits", "Range", {"value_type": "xs:int", "min": "0", "max": "@S"}),
    ("Manual", "File", {"value": "/m/@K.pdf", "content_type": "application/pdf", "value_kind": "STRING"}),
    ("Lost", "File", {"content_type": "text/plain"}),
    ("Icon", "Blob", {"value": "AAEC", "content_type": "image/png", "value_kind": "STRING"}),
    ("See", "ReferenceElement", {"value": '{"keys":[{"type":"Submodel","value":"sm@K"},{"type":"Property","value":"x@K"}],"type":"ExternalReference"}',
                                 "value_kind": "OBJECT<keys: ARRAY<OBJECT<type: STRING, value: STRING>>, type: STRING>"}),
    ("Link", "RelationshipElement", {"first_key": "a@K", "second_key": "b@K"}),
    ("Note", "AnnotatedRelationshipElement", {"first_key": "c@K", "second_key": "d@K"}),
    ("Note.Why", "Property", {"value_type": "xs:int", "value": "@S", "value_kind": "STRING"}),
    ("Machine", "Entity", {"entity_type": "SelfManagedEntity", "global_asset_id": "urn:@K"}),
    ("Machine.Weight", "Property", {"value_type": "xs:int", "value": "@S", "value_kind": "STRING"}),
    ("Start", "Operation", {}),
    ("Start.Speed", "Property", {"value_type": "xs:string", "value": "@S", "value_kind": "STRING"}),
    ("Start.Done", "Property", {"value_type": "xs:string", "value": "no", "value_kind": "STRING"}),
    ("Start.Mode", "Property", {"value_type": "xs:string", "value": "auto", "value_kind": "STRING"}),
    ("Alarm", "BasicEventElement", {"observed_key": "o@K", "direction": "output", "message_topic": "t/@K"}),
    ("Axes", "SubmodelElementList", {"list_element_type": "Property", "list_value_type": "xs:int",
                                     "value_kind": "ARRAY<OBJECT<modelType: STRING, value: STRING, valueType: STRING>>"}),
    ("Axes[0]", "Property", {"value_type": "xs:int", "value": "1", "value_kind": "STRING"}),
    ("Axes[1]", "Property", {"value_type": "int", "value": "2", "value_kind": "STRING"}),
    ("Group", "SubmodelElementCollection", {"value_kind": "ARRAY<OBJECT<idShort: STRING, modelType: STRING, value: STRING, valueType: STRING>>"}),
    ("Group.Inner", "Property", {"value_type": "xs:int", "value": "@S", "value_kind": "STRING"}),
    ("Group.Day", "Property", {"value_type": "xs:date", "value": "soon", "value_kind": "STRING"}),
]
ZOO_COLUMNS = ["value_type", "value", "min", "max", "content_type", "first_key", "second_key", "observed_key", "direction", "message_topic", "entity_type",
               "global_asset_id", "list_element_type", "list_value_type", "value_kind"]


def _zoo_sql() -> str:
    def text(v):
        return "CAST(NULL AS VARCHAR)" if v is None else "replace(replace('" + v + "', '@K', CAST(p_partkey AS VARCHAR)), '@S', CAST(p_size AS VARCHAR))"
    rows = [f"SELECT p_partkey AS part, '{path}' AS path, '{kind}' AS model_type, " + ", ".join(f"{text(more.get(c))} AS {c}" for c in ZOO_COLUMNS) + " FROM part"
            for path, kind, more in ZOO]
    return " UNION ALL ".join(rows)


def zoo(fx):
    part, size = (F.col(c).cast("string") for c in ("p_partkey", "p_size"))
    js = F.replace(F.replace(F.lit(_zoo_json()), F.lit("@K"), part), F.lit("@S"), size)
    trees = dealt(fx.part.select("p_partkey", "p_size")).select(F.col("p_partkey").alias("part"), js.alias("elements_json"))
    return EL.flatten_elements(trees, key="part", with_typed=True)


@register("elements_typed", _zoo_sql())
def elements_typed(fx):
    """Elements of all types, with the fields that only some of them have."""
    return zoo(fx).select("part", "path", "model_type", *ZOO_COLUMNS)


@register("typed_violations", f"""
SELECT part, path, CASE path WHEN 'Flag' THEN 'boolean_text' WHEN 'Lost' THEN 'file_incomplete' WHEN 'Axes[1]' THEN 'valuetype_prefix' ELSE 'iso_date' END AS rule
FROM ({_zoo_sql()}) WHERE path IN ('Flag', 'Lost', 'Axes[1]', 'Group.Day')
""")
def typed_violations(fx):
    """Value rules over all element types: a literal boolean, a file without a value, a type without prefix, a day that is no date."""
    return EL.element_violations(zoo(fx), key="part")


@register("payload_root_violations", """
WITH p AS (SELECT p_partkey AS part, p_partkey % 8 AS k FROM part),
r AS (SELECT part, unnest(CASE k WHEN 0 THEN [] WHEN 1 THEN ['missing_id'] WHEN 2 THEN ['missing_kind', 'missing_submodelElements'] WHEN 3 THEN ['forbidden_idType', 'forbidden_identification']
  WHEN 4 THEN ['not_an_object'] WHEN 5 THEN ['not_an_object'] WHEN 6 THEN ['missing_id', 'missing_idShort', 'missing_modelType', 'missing_kind', 'missing_submodelElements', 'forbidden_semanticId']
  ELSE ['not_an_object'] END) AS rule FROM p)
SELECT part, rule FROM r
""")
def payload_root_violations(fx):
    """Root fields that a payload must have or must not have; broken texts, lists and NULL are no objects."""
    k = F.col("p_partkey") % 8
    head, tail = '"idShort":"x","modelType":"Submodel"', '"kind":"Instance","submodelElements":[]'
    body = F.when(k == 0, '{"id":"a",' + head + "," + tail + "}").when(k == 1, "{" + head + "," + tail + "}").when(k == 2, '{"id":"a",' + head + "}") \
        .when(k == 3, '{"id":"a","idType":"IRI","identification":{},' + head + "," + tail + "}").when(k == 4, '{"id":').when(k == 5, "[]").when(k == 6, '{"semanticId":{}}')
    return EL.payload_violations(fx.part.select(F.col("p_partkey").alias("part"), body.alias("body")), "part", "body")
