"""Asset-model operators on cases that the generated tables do not hold."""

import pytest

from sensorloom.operators import audit as AU
from sensorloom.operators import twin as TW
from sensorloom.sources.fixtures import shell_iri


def test_ids_of_long_keys_stay_apart(spark):
    df = spark.createDataFrame([(k,) for k in (1, 1000, 9999, 10000, 10001, 100000)], "k long")
    got = [r[0].rsplit("_", 1)[1] for r in df.select(shell_iri("k")).collect()]
    assert got == ["0001", "1000", "9999", "10000", "10001", "100000"]


def model(spark):
    shells = spark.createDataFrame([("A", "a"), ("B", "b"), ("C", "c")], "shell_id string, id_short string")
    refs = spark.createDataFrame([("A", "M1"), ("B", "gone")], "shell_id string, submodel_id string")
    sms = spark.createDataFrame([("M1", None, 1.0), ("M2", "x", 2.0)], "submodel_id string, id_short string, price double")
    return shells, refs, sms


def test_a_submodel_without_id_short_is_resolved(spark):
    shells, refs, sms = model(spark)
    got = {r.shell_id: r.resolved for r in TW.enrich_shells(shells, refs, sms).collect()}
    assert got == {"A": True, "B": False, "C": None}
    assert {r.shell_id: r.submodel_id for r in TW.enrich_shells(shells, refs, sms, on_missing="skip").collect()} == {"A": "M1", "B": None, "C": None}
    with pytest.raises(Exception, match="submodel not found: gone"):
        TW.enrich_shells(shells, refs, sms, on_missing="error").collect()
    scoped = spark.createDataFrame([("B", "gone", "own", 9.0)], "shell_id string, submodel_id string, id_short string, price double")
    r = {x.shell_id: x for x in TW.enrich_shells(shells, refs, sms, scoped).collect()}
    assert r["B"].resolved and r["B"].sm_id_short == "own" and r["A"].resolved and r["A"].sm_price == 1.0


def test_export_has_one_document_per_shell(spark):
    shells, refs, sms = model(spark)
    docs = {r.shell_id: r for r in TW.export_documents(shells, refs, sms, shells.limit(0)).collect()}
    assert [m.submodel_id for m in docs["A"].submodels] == ["M1"]
    assert docs["B"].submodels == [] and docs["B"].n_dangling == 1 and docs["C"].submodels == [] and docs["C"].n_dangling == 0


def test_two_shells_cannot_link_one_submodel(spark):
    _, refs, sms = model(spark)
    asked = spark.createDataFrame([("C", "M2"), ("B", "M2"), ("C", "M1"), ("C", "none")], "shell_id string, submodel_id string")
    got = {(r.shell_id, r.submodel_id): r.accepted for r in TW.accepted_links(refs, sms, asked).collect()}
    assert got == {("B", "M2"): True, ("C", "M2"): False, ("C", "M1"): False, ("C", "none"): False}
    after = TW.apply_links(refs, sms, asked, asked.limit(0))
    assert sorted(tuple(r) for r in after.collect()) == [("A", "M1"), ("B", "M2"), ("B", "gone")]


def test_change_log_refuses_what_the_store_refuses(spark):
    log = spark.createDataFrame([
        (1, 1, "create", None, "v1"), (1, 2, "create", None, "v2"),                                    # 409
        (2, 3, "create", None, "w1"), (2, 4, "patch", "y", "3"), (2, 5, "patch", "x", "1"), (2, 6, "patch", "y", "4"),
        (3, 7, "create", None, "z"), (3, 8, "delete", None, None), (3, 9, "patch", "y", "3"),           # 404
        (4, 10, "patch", "y", "3"),                                                                     # 404
        (5, 11, "create", None, "a"), (5, 12, "patch", "p", "old"), (5, 13, "delete", None, None), (5, 14, "create", None, "b")],
        "id long, seq long, op string, path string, body string")
    whole = {r.id: (r.seq, r.body) for r in TW.change_log_state(log.drop("path")).collect()}
    assert whole == {1: (1, "v1"), 2: (6, "4"), 5: (14, "b")}
    for bits in (20, 1):
        got = {(r.id, r.path): r.body for r in TW.change_log_state(log, path="path", seq_bucket_bits=bits).collect()}
        assert got == {(1, None): "v1", (2, None): "w1", (2, "x"): "1", (2, "y"): "4", (5, None): "b"}


def test_null_fields_make_a_review_invalid(spark):
    body = '{"approved":true,"summary":"s","issues":[{"severity":null,"criterion":"security","description":"d","fix":"f"}]}'
    r = AU.review_verdicts(spark.createDataFrame([(1, body), (2, None)], "review_id long, body string")).orderBy("review_id").collect()
    for x in r:
        assert (x.valid, x.approved, x.has_critical, x.effective_approved, x.contradiction) == (False, False, False, False, False)


def test_plans_need_their_tools_and_a_numeric_port(spark):
    full = '{"technology_lower":"t","technology_pascal":"T","default_port":%s,"server_instructions":"i"%s}'
    rows = [(1, full % ("80", ',"tools":[{"n":1}]')), (2, full % ("80", "")), (3, full % ('"abc"', ',"tools":[]'))]
    got = AU.plan_status(spark.createDataFrame(rows, "doc_id long, body string")).orderBy("doc_id").collect()
    assert [x.status for x in got] == ["success", "error", "error"]


def test_null_ids_of_link_and_unlink_requests(spark):
    _, refs, sms = model(spark)
    pairs = "shell_id string, submodel_id string"
    refs = refs.unionByName(spark.createDataFrame([("A", None), (None, "M9"), ("B", "gone")], pairs))
    asked = spark.createDataFrame([(None, "M2"), ("C", "M2"), ("C", "M2"), ("C", None)], pairs)
    off = spark.createDataFrame([("A", None), (None, "M9"), ("A", "M1"), (None, None)], pairs)
    got = [tuple(r) for r in TW.apply_links(refs, sms, asked, off).collect()]
    assert sorted(got, key=str) == sorted([("B", "gone"), ("C", "M2"), ("A", None), (None, "M9")], key=str)
    accepted = [tuple(r) for r in TW.accepted_links(refs, sms, asked).select("shell_id", "submodel_id", "accepted").collect()]
    assert sorted(accepted, key=str) == sorted([(None, "M2", False), ("C", "M2", True), ("C", "M2", True), ("C", None, False)], key=str)
    assert TW.accepted_links(refs, sms, asked.where("shell_id is null")).where("accepted").count() == 0
