"""Property checks of the preprocessing chain (all flag combinations)."""

import itertools

import pytest
from pyspark.sql import functions as F

from sensorloom.operators import readings as R


@pytest.mark.parametrize("flags", list(itertools.product([False, True], repeat=4)))
def test_flag_combinations(fx, flags):
    c, i, n, t = flags
    res = R.preprocess(fx.readings(), cleansing=c, imputation=i, normalization=n, transformation=t)
    df = res.df
    assert res.steps[0] == R.STEP_RAW
    assert res.steps[-1] == (R.STEP_TRANSFORMATION if t else R.STEP_OUTPUT)
    expected = [s for s, on in [(R.STEP_CLEANSING, c), (R.STEP_IMPUTATION, i), (R.STEP_NORMALIZATION, n)] if on]
    assert res.steps[1:-1] == expected
    value = "value_deg" if t else "value"
    checks = {}
    if c:
        checks["bad"] = df.where(F.col("quality").isNull() | (F.col("quality") == "bad")).count()
    if i:
        checks["imputed_nulls"] = df.where(F.col("quality").isNull() | F.col(value).isNull()
                                           | F.col("unit").isNull()).count()
    if n:
        checks["norm_nulls"] = df.where(F.col("source_type").isNull() | F.col("asset_id").isNull()).count()
    assert all(v == 0 for v in checks.values()), checks
    if t:
        bad_rad = df.where(F.col("value_deg").try_cast("double").isNotNull() & F.col("value_rad").isNull()).count()
        assert bad_rad == 0


def test_imputation_never_yields_imputed_after_cleansing(fx):
    df = R.preprocess(fx.readings(), cleansing=True, imputation=True).df
    assert df.where(F.col("quality") == R.IMPUTED_QUALITY).count() == 0


def test_chain_is_one_stage_without_shuffle(fx):
    df = R.preprocess(fx.readings(), cleansing=True, imputation=True, normalization=True, transformation=True).df
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_scan_pushdown_and_pruning(fx):
    df = R.cleanse(fx.readings()).select("asset_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string>" in plan
