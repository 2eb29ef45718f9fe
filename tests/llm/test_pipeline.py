import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as CP
from sensorloom.llm import secret_scan
from sensorloom.llm.queries import LLM_QUERIES
from sensorloom.llm.shared import shared_table

from .test_ngram_join import brute
from .test_packing import check, ids_of
from .test_secret_scan import brute as secrets_of

SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    out = [docs]
    for name, f in CP.STAGES:
        out.append(shared_table(f(spark, out[-1], SF_MID), "test"))
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_names_and_columns(stages):
    assert [n for n, _ in CP.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "packing"]
    assert all(s.columns == stages[0].columns and s.dtypes == stages[0].dtypes for s in stages[1:-1])


def test_quality_stage_takes_the_classifier_s_decisions(spark, stages):
    q = {r.doc_id for r in LLM_QUERIES["op8_quality_neighbours"](spark, SF_MID).where("predicted = 1").collect()}
    assert set(rows(stages[1])) == q


def test_near_duplicate_stage_keeps_one_of_each(stages):
    before, after = rows(stages[1]), rows(stages[2])
    _, root = brute({d: r.text for d, r in before.items()})
    assert set(after) == {d for d, r in root.items() if d == r}
    assert all(after[d] == before[d] for d in after)


def test_decontamination_stage(spark, stages):
    before, after = rows(stages[2]), rows(stages[3])
    bad = {r.doc_id for r in LLM_QUERIES["op10_benchmark_decontamination"](spark, SF_MID).where("contaminated").collect()}
    assert set(after) == set(before) - bad


def test_secret_stage_leaves_no_secret(stages):
    before, after = rows(stages[3]), rows(stages[4])
    assert set(before) == set(after)
    assert any(secrets_of(r.text) for r in before.values())
    for d, r in after.items():
        assert not secrets_of(r.text) and r.n_chars == len(r.text)
        assert r.text == before[d].text or secret_scan.scan(before[d].text)


def test_packing_stage_is_an_exact_round_trip(stages):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    check(stages[5].collect(), {d: ids_of(tok, r.text) for d, r in rows(stages[4]).items()})


def test_run_and_odd_documents(spark, odd, tmp_path):
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF_MID}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    for name, df in (("a", odd), ("b", odd.limit(0))):
        df.write.parquet(str(tmp_path / name / "documents.parquet"))
        for t in ("labels", "benchmark"):
            spark.read.parquet(str(tmp_path / f"{t}.parquet")).write.parquet(str(tmp_path / name / f"{t}.parquet"))
        got = CP.run(spark, str(tmp_path / name))
        assert (got.count() > 0) == (name == "a")
