"""Element-tree flattening on hand-made AAS trees."""

import json

from sensorloom.operators import elements as EL


def _flat(spark, trees, **kw):
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in trees.items()], "submodel_id string, elements_json string")
    return {(r.submodel_id, r.path): r for r in EL.flatten_elements(df, **kw).collect()}


TREE = [
    {"modelType": "SubmodelElementCollection", "idShort": "PreProcessing", "value": [
        {"modelType": "SubmodelElementCollection", "idShort": "Cleansing", "value": [
            {"modelType": "Property", "idShort": "Enabled", "valueType": "xs:boolean", "value": "true"}]},
        {"modelType": "SubmodelElementList", "idShort": "Units", "value": [
            {"modelType": "Property", "valueType": "xs:string", "value": "deg"},
            {"modelType": "Property", "valueType": "xs:string", "value": "W"}]}]},
    {"modelType": "Entity", "idShort": "Robot", "statements": [
        {"modelType": "File", "idShort": "Manual", "value": "/m.pdf", "contentType": "application/pdf"}]},
    {"modelType": "Operation", "idShort": "Start", "inputVariables": [
        {"value": {"modelType": "Property", "idShort": "Speed", "valueType": "xs:int", "value": "3"}}]},
    {"modelType": "MultiLanguageProperty", "idShort": "Name",
     "value": [{"language": "en", "text": "Robot"}, {"language": "de", "text": "Roboter"}]},
    {"modelType": "Range", "idShort": "Temp", "valueType": "xs:double", "min": "0", "max": "80"},
]


def test_paths_depths_and_values(spark):
    f = _flat(spark, {"sm": TREE})
    assert f[("sm", "PreProcessing.Cleansing.Enabled")].value == "true"
    assert f[("sm", "PreProcessing.Cleansing.Enabled")].depth == 2
    assert f[("sm", "PreProcessing.Units[1]")].value == "W"
    assert f[("sm", "PreProcessing.Units[1]")].parent_path == "PreProcessing.Units"
    assert f[("sm", "Robot.Manual")].content_type == "application/pdf"
    assert f[("sm", "Start.Speed")].value == "3"
    assert f[("sm", "Temp")].max == "80"
    assert json.loads(f[("sm", "Name")].value)[1]["text"] == "Roboter"
    assert f[("sm", "PreProcessing")].value is None
    assert len(f) == 12


def test_flags_from_nested_preprocessing_paths(spark):
    df = spark.createDataFrame([("sm", json.dumps(TREE))], "submodel_id string, elements_json string")
    flags = EL.preprocessing_flags(EL.flatten_elements(df)).collect()[0]
    assert flags.cleansing is True and flags.imputation is False
    assert flags.review_needed == "imputation,normalize,transformation"


def test_too_deep_raises(spark):
    deep = {"modelType": "Property", "idShort": "leaf", "value": "x"}
    for i in range(5):
        deep = {"modelType": "SubmodelElementCollection", "idShort": f"c{i}", "value": [deep]}
    df = spark.createDataFrame([("sm", json.dumps([deep]))], "submodel_id string, elements_json string")
    assert EL.flatten_elements(df, unroll=5).count() == 6
    whole = sorted(tuple(r) for r in EL.flatten_elements(df, unroll=5).collect())
    assert sorted(tuple(r) for r in EL.flatten_elements(df, unroll=1).collect()) == whole


def test_broken_json_gives_no_rows(spark):
    df = spark.createDataFrame([("sm", "not json")], "submodel_id string, elements_json string")
    assert EL.flatten_elements(df).count() == 0


def test_common_attributes(spark):
    tree = [{"modelType": "Property", "idShort": "P", "category": "PARAMETER", "value": "1",
             "semanticId": {"type": "ExternalReference", "keys": [{"type": "GlobalReference", "value": "urn:x"}]},
             "description": [{"language": "en", "text": "speed"}, {"language": "de", "text": "Tempo"}],
             "qualifiers": [{"type": "unit", "value": "m/s"}]}]
    df = spark.createDataFrame([("sm", json.dumps(tree))], "submodel_id string, elements_json string")
    r = EL.flatten_elements(df, with_common=True).collect()[0]
    assert (r.category, r.semantic_id, r.description["de"]) == ("PARAMETER", "urn:x", "Tempo")
    assert [(q["type"], q["value"], q["kind"]) for q in r.qualifiers] == [("unit", "m/s", None)]
    assert r.supplemental_semantic_ids is None


def test_shell_listing_shapes(spark):
    from sensorloom.operators.twin import shell_listing
    bodies = [(1, '{"result":[{"id":"a","idShort":"A","assetInformation":{"assetKind":"Instance","globalAssetId":"a"}}]}'),
              (2, '[{"id":"b","idShort":"B"}]'), (3, '{"error":"boom"}'), (4, 'oops')]
    df = spark.createDataFrame(bodies, "n int, body string")
    shells, rejects = shell_listing(df, keep=("n",))
    assert sorted((r.n, r.shell_id) for r in shells.collect()) == [(1, "a"), (2, "b")]
    assert sorted((r.n, r.reason) for r in rejects.collect()) == [(3, "unexpected shape"), (4, "unparsable")]


def test_shell_rules(spark):
    rows = [("https://example.com/ids/aas/1234_0000_9999_0001", "Robot_001", "https://example.com/ids/aas/1234_0000_9999_0001"),
            ("https://example.com/ids/aas/12_34", "Robot", "urn:other")]
    df = spark.createDataFrame(rows, "shell_id string, id_short string, global_asset_id string")
    got = sorted((r.shell_id[-5:], r.rule) for r in EL.shell_violations(df).collect())
    assert got == [("12_34", "global_asset_id"), ("12_34", "id_form"), ("12_34", "idshort_suffix")]


def test_default_type_rejects_and_typed_fields(spark):
    keys = lambda v: {"type": "ModelReference", "keys": [{"type": "Submodel", "value": "s"}, {"type": "Property", "value": v}]}
    rows = [("a", json.dumps([{"idShort": "P", "valueType": "xs:boolean", "value": True},
                              {"idShort": "Q", "modelType": "Property", "valueType": "xs:boolean", "value": "true"},
                              {"idShort": "R", "modelType": "RelationshipElement", "first": keys("x"), "second": keys("y")},
                              {"idShort": "E", "modelType": "BasicEventElement", "observed": keys("o"), "direction": "input", "state": "on", "messageTopic": "t"}])),
            ("b", "[broken"), ("c", "{}"), ("d", None)]
    df = spark.createDataFrame(rows, "submodel_id string, elements_json string")
    f = {r.path: r for r in EL.flatten_elements(df, with_typed=True).collect()}
    assert (f["P"].model_type, f["P"].value, f["P"].value_kind) == ("Property", "true", "BOOLEAN")
    assert (f["R"].first_key, f["R"].second_key) == ("x", "y") and (f["E"].observed_key, f["E"].direction, f["E"].message_topic) == ("o", "input", "t")
    assert {(r.path, r.rule) for r in EL.element_violations(EL.flatten_elements(df, with_typed=True)).collect()} == {("P", "boolean_text")}
    assert {r.submodel_id: r.reason for r in EL.element_rejects(df).collect()} == {"b": "broken JSON", "c": "not an array", "d": "missing"}


def test_repeated_languages(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([([("en", "a"), ("de", "b"), ("en", "c"), (None, "d")],)], "x array<struct<language:string,text:string>>")
    assert df.select(EL.lang_strings_to_map(F.col("x"))).first()[0] == {"de": "b", "en": "c"}


def test_only_nested_arrays_are_looked_into_again(spark):
    """Many arrays beside one another are no deep tree; brackets and escapes in strings are neither depth nor its end."""
    one = {"modelType": "Property", "idShort": "p", "value": "]]]\\\\\" [ ]"}
    deep = one
    for i in range(6):
        deep = {"modelType": "SubmodelElementCollection", "idShort": f"c{i}", "value": [deep]}
    flat = [{"modelType": "SubmodelElementCollection", "idShort": f"c{i}", "value": [{**one, "value": "[[[[[[[["}]} for i in range(20)]
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in {"deep": [deep], "flat": flat}.items()], "submodel_id string, elements_json string")
    assert [r.submodel_id for r in df.where(EL._deeper_than(df.elements_json, 4)).collect()] == ["deep"]
    got = {(r.submodel_id, r.depth) for r in EL.flatten_elements(df, unroll=3).collect()}
    assert got == {("deep", d) for d in range(7)} | {("flat", 0), ("flat", 1)}


def test_trees_are_built_and_parsed_by_all_cores(spark, fx):
    from sensorloom.plans import q_elements as Q
    cores = spark.sparkContext.defaultParallelism
    for trees in (fx.element_trees(), Q.deep_trees(fx), Q.described_trees(fx), Q.zoo(fx)):
        assert trees.rdd.getNumPartitions() >= cores
