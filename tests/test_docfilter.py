"""Document filter semantics (small hand-made collections)."""

import pytest
from pyspark.sql import Row

from sensorloom.functions.docfilter import compile_filter, query_documents


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        Row(id=1, quality="good", value="6.5", unit="deg", tags=["a", "b"], data=Row(value_deg="95.0", n=3)),
        Row(id=2, quality="bad", value="READY", unit=None, tags=["b"], data=Row(value_deg="10", n=None)),
        Row(id=3, quality=None, value=None, unit="W", tags=[], data=None),
        Row(id=4, quality="good", value="true", unit=None, tags=None, data=Row(value_deg="abc", n=7)),
    ]
    return spark.createDataFrame(rows, "id long, quality string, value string, unit string, tags array<string>, "
                                       "data struct<value_deg string, n int>")


def ids(df, f):
    return sorted(r.id for r in df.where(compile_filter(f, df.schema)).collect())


def test_empty_and_equality(docs):
    assert ids(docs, {}) == [1, 2, 3, 4]
    assert ids(docs, {"quality": "good"}) == [1, 4]
    assert ids(docs, {"quality": "good", "unit": "deg"}) == [1]


def test_null_matches_null_or_missing(docs):
    assert ids(docs, {"quality": None}) == [3]
    assert ids(docs, {"no_such_field": None}) == [1, 2, 3, 4]
    assert ids(docs, {"no_such_field": 1}) == []


def test_ne_and_nin_match_missing(docs):
    assert ids(docs, {"quality": {"$ne": "good"}}) == [2, 3]
    assert ids(docs, {"value": {"$nin": ["READY", "true"]}}) == [1, 3]
    assert ids(docs, {"missing": {"$ne": 5}}) == [1, 2, 3, 4]


def test_type_bracketed_comparisons(docs):
    # numeric literal compares with text through try_cast; text never numeric
    assert ids(docs, {"value": {"$gt": 5}}) == [1]
    assert ids(docs, {"id": {"$gte": "2"}}) == []
    assert ids(docs, {"data.value_deg": {"$gt": 90}}) == [1]
    assert ids(docs, {"data.n": {"$lte": 3}}) == [1]


def test_array_semantics(docs):
    assert ids(docs, {"tags": "b"}) == [1, 2]
    assert ids(docs, {"tags": {"$size": 0}}) == [3]
    assert ids(docs, {"tags": {"$all": ["a", "b"]}}) == [1]
    assert ids(docs, {"tags": {"$elemMatch": {"$eq": "a"}}}) == [1]


def test_logical_and_misc(docs):
    assert ids(docs, {"$or": [{"quality": "bad"}, {"unit": "W"}]}) == [2, 3]
    assert ids(docs, {"$nor": [{"quality": "good"}]}) == [2, 3]
    assert ids(docs, {"value": {"$not": {"$gt": 5}}}) == [2, 3, 4]
    assert ids(docs, {"unit": {"$exists": False}}) == [2, 4]
    assert ids(docs, {"quality": {"$regex": "^GO", "$options": "i"}}) == [1, 4]
    assert ids(docs, {"id": {"$mod": [2, 0]}}) == [2, 4]
    assert ids(docs, {"value": {"$type": "string"}}) == [1, 2, 4]
    assert ids(docs, {"value": True}) == [4]


def test_unknown_operator_raises(docs):
    with pytest.raises(ValueError):
        compile_filter({"quality": {"$near": 1}}, docs.schema)
    with pytest.raises(ValueError):
        compile_filter({"$where": "1"}, docs.schema)


def test_query_documents_drops_id_and_limits(spark, docs):
    withid = docs.withColumn("_id", docs.id.cast("string"))
    out = query_documents(withid, {"quality": "good"}, limit=1)
    assert "_id" not in out.columns
    assert out.count() == 1
