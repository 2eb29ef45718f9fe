"""Every registered query against its DuckDB oracle on sf0.001."""

import pytest

from helpers import bag, spark_bag

from sensorloom.plans.catalog import ORACLE, QUERIES

NAMES = sorted(QUERIES)


def test_every_query_has_an_oracle():
    missing = [n for n in NAMES if n not in ORACLE]
    assert missing == []


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    from conftest import SF_SMALL
    df = QUERIES[name](spark, SF_SMALL)
    res = duck.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(res.columns)
    assert spark_bag(df) == bag(res.columns, res.fetchall())


def test_entry_smoke(spark):
    from __spark_entry__ import entry
    df = entry(spark)
    assert df.count() > 0
    assert df.columns == entry(spark).columns
