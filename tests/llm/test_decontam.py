import duckdb
import pytest

from sensorloom.llm import decontam as D
from sensorloom.llm.queries import LLM_ORACLE, LLM_QUERIES

SF_MID = "/root/testdata/sf0.01"


def test_query_matches_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_MID}/{t}.parquet')")
    rel = con.sql(LLM_ORACLE["op10_benchmark_decontamination"])
    got = LLM_QUERIES["op10_benchmark_decontamination"](spark, SF_MID)
    assert got.columns == rel.columns
    want = sorted(rel.fetchall())
    assert sorted(map(tuple, got.collect())) == want and sum(r[-1] for r in want) > 0


ITEM = " ".join(f"w{i}" for i in range(20))


@pytest.mark.parametrize("small", [False, True])
def test_small_cases(spark, monkeypatch, small):
    if small:  # a segment per document, a block per item
        monkeypatch.setattr(D, "SEGMENT_BYTES", 1)
        monkeypatch.setattr(D, "ITEM_BYTES", 1)
    items = spark.createDataFrame([(1, ITEM), (2, "alpha Beta gamma"), (3, ""), (4, None), (None, "x"), (10, ITEM + " more words"), (2, "delta")], "item_id long, text string")
    rows = [(1, "pad " * 300 + "W0, " + ITEM[3:].upper()), (2, "ALPHA beta--gamma"), (3, None), (4, ""), (5, "alpha beta x gamma"), (6, " ".join(ITEM.split()[:12])),
            (7, " ".join(ITEM.split()[:13])), (None, "delta"), (8, "w0 " * 5), (9, ITEM.replace("w9", "changed")), (9, ITEM), (11, "delta " * 3 + "pad " * 200)]
    df = spark.createDataFrame([(d, t, "clash", 0) for d, t in rows], "doc_id long, text string, segment string, ord int")
    got = {}
    for r in D.contamination(df, items).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, r.n_hit, r.items, r.n_near, r.contaminated))
    assert got[1] == [(320, 20, ["1", "10"], 0, True)]
    assert got[2] == [(3, 3, ["2"], 0, True)] and got[5] == [(4, 0, [], 0, False)]
    assert got[3] == got[4] == [(0, 0, [], 0, False)] and got[6][0][1] == 0
    assert got[7] == [(13, 13, ["1", "10"], 0, True)] and got[8][0][1] == 0
    assert got[None] == [(1, 1, ["2"], 0, True)]
    assert sorted(g[1] for g in got[9]) == [0, 20] and {g[3] for g in got[9]} == {0, 2}  # near, without the exact phrase
    assert got[11] == [(203, 3, ["2"], 0, False)]
    kept = D.drop_contaminated(df, items)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [3, 4, 5, 6, 8, 11]
    assert D.contamination(df.limit(0), items).count() == 0
    assert D.contamination(df, items.limit(0)).where("n_hit > 0").count() == 0
