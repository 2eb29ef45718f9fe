"""Per-shell description, capability map, reference keys, submodel reader."""

import json
import os
import uuid

from pyspark.sql import functions as F

from sensorloom.operators import elements as EL
from sensorloom.operators import ops as OP
from sensorloom.operators import twin as TW
from sensorloom.session import scratch_path


def test_describe_shell_matches_enrichment(fx):
    shells, refs, sms = fx.shells(), fx.submodel_refs(), fx.submodels()
    sid = refs.groupBy("shell_id").count().orderBy(F.col("count").desc(), "shell_id").first().shell_id
    row = TW.describe_shell(shells, refs, sms, sid).collect()[0]
    got = [s.submodel_id for s in row.submodels_content]
    expected = sorted(r.submodel_id for r in TW.enrich_shells(shells.where(F.col("shell_id") == sid), refs, sms)
                      .where("resolved").collect())
    assert got == expected and len(got) > 0


def test_capability_map_one_row(spark):
    tools = spark.createDataFrame([("kafka", "list_topics"), ("kafka", "create_topic"), ("aasx", "get_shell"),
                                   ("kafka", "list_topics")], "server string, tool string")
    m = OP.capability_map(tools).collect()[0].capabilities
    assert m == {"kafka": ["create_topic", "list_topics"], "aasx": ["get_shell"]}


def test_reference_keys_and_lang_map(spark):
    df = spark.createDataFrame(
        [({"type": "ModelReference", "keys": [{"type": "Submodel", "value": "sm1"}, {"type": "Property", "value": "p"}]},
          [{"language": "en", "text": "a"}, {"language": "de", "text": "b"}])],
        "ref struct<type string, keys array<struct<type string, value string>>>, "
        "ls array<struct<language string, text string>>")
    r = df.select(EL.reference_key(F.col("ref")).alias("f"), EL.reference_key(F.col("ref"), "last").alias("l"),
                  EL.lang_strings_to_map(F.col("ls")).alias("m")).collect()[0]
    assert (r.f, r.l, r.m) == ("sm1", "p", {"en": "a", "de": "b"})


def test_read_submodels_multiline(spark):
    path = scratch_path(spark, "tests", f"sm-{uuid.uuid4().hex}")
    os.makedirs(path, exist_ok=True)
    doc = {"id": "https://example.com/ids/sm/0001_0002_0003_0004", "idShort": "PreProcessing_001",
           "kind": "Instance", "modelType": "Submodel",
           "submodelElements": [{"modelType": "Property", "idShort": "Enabled", "valueType": "xs:boolean",
                                 "value": "true"}]}
    with open(os.path.join(path, "sm.json"), "w") as fh:
        json.dump(doc, fh, indent=2)
    sm = TW.read_submodels(spark, path)
    flat = EL.flatten_elements(sm).collect()
    assert [(r.submodel_id, r.path, r.value) for r in flat] == [(doc["id"], "Enabled", "true")]
