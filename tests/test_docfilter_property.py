"""Property test: random filters, Spark vs a pure-Python evaluator of the
store semantics (missing = null for negations, type bracketing, arrays)."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sensorloom.functions.docfilter import compile_filter

DOCS = [
    {"id": 1, "q": "good", "v": "6.5", "n": 3, "tags": ["a", "b"]},
    {"id": 2, "q": "bad", "v": "READY", "n": None, "tags": ["b"]},
    {"id": 3, "q": None, "v": None, "n": 10, "tags": []},
    {"id": 4, "q": "good", "v": "true", "n": -2, "tags": None},
    {"id": 5, "q": "imputed", "v": "0.0", "n": 0, "tags": ["c"]},
    {"id": 6, "q": "Good", "v": "120", "n": 7, "tags": ["a"]},
]
FIELDS = {"q": "str", "v": "str", "n": "num", "tags": "arr", "missing": "none"}


def _num(x):
    try:
        f = float(x)
        return None if math.isnan(f) else f
    except (TypeError, ValueError):
        return None


def cmp_scalar(fv, ftype, op, lit):
    if fv is None or lit is None:
        return False
    if isinstance(lit, bool):
        if ftype != "str":
            return False
        a, b = fv, ("true" if lit else "false")
    elif isinstance(lit, (int, float)):
        a = fv if ftype == "num" else _num(fv)
        if a is None:
            return False
        b = lit
    else:
        if ftype != "str":
            return False
        a, b = fv, lit
    return {"$eq": a == b, "$gt": a > b, "$gte": a >= b, "$lt": a < b, "$lte": a <= b}[op]


def field_cmp(doc, f, op, lit):
    ftype = FIELDS[f]
    fv = doc.get(f)
    if ftype == "arr":
        return fv is not None and any(cmp_scalar(x, "str", op, lit) for x in fv)
    return cmp_scalar(fv, ftype, op, lit)


def eq(doc, f, lit):
    if lit is None:
        return doc.get(f) is None
    return field_cmp(doc, f, "$eq", lit)


def ev_ops(doc, f, spec):
    out = True
    for op, lit in spec.items():
        if op == "$eq":
            r = eq(doc, f, lit)
        elif op == "$ne":
            r = not eq(doc, f, lit)
        elif op in ("$gt", "$gte", "$lt", "$lte"):
            r = field_cmp(doc, f, op, lit)
        elif op == "$in":
            r = any(eq(doc, f, x) for x in lit)
        elif op == "$nin":
            r = not any(eq(doc, f, x) for x in lit)
        elif op == "$exists":
            r = (doc.get(f) is not None) == lit
        elif op == "$not":
            r = not ev_ops(doc, f, lit)
        out = out and r
    return out


def ev(doc, flt):
    out = True
    for k, v in flt.items():
        if k == "$and":
            r = all(ev(doc, s) for s in v)
        elif k == "$or":
            r = any(ev(doc, s) for s in v)
        elif k == "$nor":
            r = not any(ev(doc, s) for s in v)
        elif isinstance(v, dict):
            r = ev_ops(doc, k, v)
        else:
            r = eq(doc, k, v)
        out = out and r
    return out


lits = st.one_of(st.none(), st.sampled_from(["good", "bad", "READY", "a", "b", "true"]),
                 st.integers(-3, 12), st.sampled_from([0.0, 6.5, 100.5]), st.booleans())
cmp_ops = st.sampled_from(["$eq", "$ne", "$gt", "$gte", "$lt", "$lte"])
field = st.sampled_from(sorted(FIELDS))


def op_spec():
    simple = st.one_of(
        st.builds(lambda o, l: {o: l}, cmp_ops, lits),
        st.builds(lambda l: {"$in": l}, st.lists(lits, min_size=1, max_size=3)),
        st.builds(lambda l: {"$nin": l}, st.lists(lits, min_size=1, max_size=3)),
        st.builds(lambda b: {"$exists": b}, st.booleans()),
    )
    return st.one_of(simple, st.builds(lambda s: {"$not": s}, simple))


leaf = st.one_of(st.builds(lambda f, l: {f: l}, field, lits), st.builds(lambda f, s: {f: s}, field, op_spec()))
filters = st.recursive(leaf, lambda c: st.one_of(
    st.builds(lambda xs: {"$and": xs}, st.lists(c, min_size=1, max_size=3)),
    st.builds(lambda xs: {"$or": xs}, st.lists(c, min_size=1, max_size=3)),
    st.builds(lambda xs: {"$nor": xs}, st.lists(c, min_size=1, max_size=2))), max_leaves=6)


@pytest.fixture(scope="module")
def coll(spark):
    rows = [(d["id"], d["q"], d["v"], d["n"], d["tags"]) for d in DOCS]
    return spark.createDataFrame(rows, "id long, q string, v string, n long, tags array<string>")


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(filters, min_size=10, max_size=10))
def test_random_filters_match_reference(coll, flts):
    cols = [F.coalesce(compile_filter(f, coll.schema), F.lit(False)).alias(f"f{i}") for i, f in enumerate(flts)]
    got = {r.id: r for r in coll.select("id", *cols).collect()}
    for i, f in enumerate(flts):
        spark_ids = sorted(d for d, r in got.items() if r[f"f{i}"])
        ref_ids = sorted(d["id"] for d in DOCS if ev(d, f))
        assert spark_ids == ref_ids, f
