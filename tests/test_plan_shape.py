"""Plan-shape regressions for the scale claims in the README."""

import re

from pyspark.sql import functions as F

from sensorloom.operators import audit as AU
from sensorloom.operators import search as SE


def _final_plan(df):
    qe = df._jdf.queryExecution()
    qe.toRdd().count()
    return qe.executedPlan().toString().split("== Initial Plan ==")[0]


def test_search_leaves_the_corpus_after_the_index(fx):
    q = fx.benchmark.select(F.col("item_id").alias("query_id"), "text")
    plan = _final_plan(SE.search_topk(q, fx.documents, max_results=5))
    assert "documents.parquet" not in plan, plan  # the texts were read once, for the index
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_loop_guard_never_windows_by_run_alone(fx):
    plan = _final_plan(AU.tool_runs(fx.tool_calls(), guard=3))
    # row windows are partitioned by (run, bucket) ...
    assert re.search(r"windowspecdefinition\(run_id#\d+L, _b#\d+L", plan), plan
    # ... and no window orders a whole run by seq (only bucket summaries are windowed by run)
    assert not re.search(r"windowspecdefinition\(run_id#\d+L, seq#\d+L", plan), plan


def test_chain_and_filters_have_no_python_or_nested_loops(fx):
    from sensorloom.operators import readings as R
    plan = _final_plan(R.preprocess_by_flags(fx.readings(), fx.asset_flags()))
    assert not re.search(r"ArrowEvalPython|BatchEvalPython|BroadcastNestedLoopJoin|CartesianProduct", plan)


def test_bucketed_helpers_scan_and_shuffle_once(fx):
    from sensorloom.operators import ordered as OD
    rows = fx.tool_calls()
    bucket = F.shiftright("seq", 8)
    for df in (OD.prev_by_key(rows, "run_id", ["seq"], bucket, ["tool"]), OD.running_by_key(rows, ["run_id"], ["seq"], bucket, max_of={"m": "tool"}),
               OD.run_lengths(rows, "run_id", "seq", "tool", bucket)):
        plan = _final_plan(df)
        assert "ReusedExchange" in plan, plan
        assert len(re.findall(r"FileScan parquet", plan.split("== Final Plan ==")[-1])) == 1, plan


def _large(monkeypatch):
    """Nothing counts as small, and tables have 19 tasks, more than the session has partitions."""
    from sensorloom.operators import joins
    from sensorloom.sources.tables import Tables
    monkeypatch.setattr(joins, "BROADCAST_MAX_ROWS", -1)
    monkeypatch.setattr(joins, "fits", lambda df, max_rows=0: False)
    monkeypatch.setattr(Tables, "tasks", lambda self, *names, rows=0: 19)


def test_references_are_made_distinct_as_numbers_in_tasks_by_rows(fx, monkeypatch):
    _large(monkeypatch)
    plan = _final_plan(fx.submodel_refs())
    assert re.search(r"Exchange hashpartitioning\(l_suppkey#\d+L, _part#\d+L, 19\)", plan), plan
    assert not re.search(r"HashAggregate\(keys=\[(shell_id|submodel_id)", plan), plan


def test_references_are_not_sorted_for_shells_and_submodels(fx, monkeypatch):
    from sensorloom.plans import q_twin as Q
    _large(monkeypatch)
    plan = _final_plan(Q.shell_enriched(fx))
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and "Sort " not in plan, plan
    for query in (Q.shell_enriched_scoped, Q.lookup_scoped):
        assert re.search(r"hashpartitioning\(shell_id#\d+, submodel_id#\d+, 19\)", _final_plan(query(fx))), query


def test_listing_is_dealt_by_rows(fx, monkeypatch):
    from sensorloom.plans import q_twin as Q
    _large(monkeypatch)
    assert len(re.findall(r"Exchange hashpartitioning\(submodel_id#\d+, 19\)", _final_plan(Q.all_submodels(fx)))) == 2


def test_links_are_combined_not_sorted(fx):
    from sensorloom.plans import q_twin as Q
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for c in names:
        fx.spark.conf.set(c, "-1")
    try:
        assert "SortMergeJoin" not in _final_plan(Q.link_unlink(fx))
    finally:
        for c in names:
            fx.spark.conf.unset(c)


def test_export_builds_its_parts_once(fx):
    from sensorloom.operators import twin as TW
    refs = fx.submodel_refs().withColumn("pos", F.length("submodel_id"))
    df = TW.export_parts(fx.shells(), refs, fx.submodels(), fx.shells().limit(0))
    assert df._jdf.queryExecution().optimizedPlan().toString().lower().count("floor(") == 1
    # a shell with a third of all references is in many tasks
    assert re.search(r"Exchange hashpartitioning\(shell_id#\d+, part#\d+L, \d+\)", _final_plan(df))


def test_export_shuffles_its_references_once(fx, monkeypatch):
    """The shells with resolved references are found from the shuffle that the parts are built from."""
    from sensorloom.operators import twin as TW
    monkeypatch.setattr(TW, "table_side", lambda df: df.hint("shuffle_hash"))
    refs = fx.submodel_refs().withColumn("pos", F.length("submodel_id"))
    plan = _final_plan(TW.export_parts(fx.shells(), refs, fx.submodels(), fx.shells().limit(0)))
    assert len(re.findall(r"Reused\w*|ReusedExchange", plan)) >= 1 and "Exchange hashpartitioning(submodel_id" in plan
    reused = [line for line in plan.splitlines() if "ReusedExchange" in line]
    assert any("hashpartitioning(submodel_id" in line and "pos" in line for line in reused), plan
