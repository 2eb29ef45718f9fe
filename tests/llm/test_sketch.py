import hashlib

from pyspark.sql import functions as F

from sensorloom.llm import sketch as S
from sensorloom.llm.queries import LLM_QUERIES

from .conftest import SF_SMALL


def test_query_against_plain_python(spark, texts):
    rows = {r.doc_id: r for r in LLM_QUERIES["op9_scaled_sketch"](spark, SF_SMALL).collect()}
    ids = sorted(texts, reverse=True)
    assert rows.keys() == texts.keys()
    edited = {}
    for i, d in enumerate(ids):
        t, n = texts[d], len(texts[d])
        edited[d] = t[:n - n // 2] + texts[ids[(i + 1) % len(ids)]][:n // 2]
        assert rows[d].n_chars == n
        assert rows[d].edited_sha256 == hashlib.sha256(edited[d].encode()).hexdigest()
    prints = {}
    for d, t in texts.items():
        assert prints.setdefault(t, rows[d].fingerprint) == rows[d].fingerprint
    near = [r.near_edited - r.near_next for r in rows.values() if r.n_chars > 500]
    assert sum(x > 0 for x in near) > 0.97 * len(near)
    exact = spark.createDataFrame([(d, texts[d], edited[d]) for d in ids], "doc_id long, a string, b string") \
        .select("doc_id", S.likeness(S.sketch(F.col("a"), fraction=0.999999), S.sketch(F.col("b"), fraction=0.999999)).alias("j"))
    off = [abs(r.j - rows[r.doc_id].near_edited) for r in exact.collect()]
    assert sum(off) / len(off) < 0.06


def test_plan_has_no_python(spark):
    plan = LLM_QUERIES["op9_scaled_sketch"](spark, SF_SMALL)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_merge_and_containment(spark):
    words = [f"w{i}" for i in range(400)]
    df = spark.createDataFrame([(" ".join(words[:200]), " ".join(words[200:]), " ".join(words))], "a string, b string, c string")
    a, b, c = (S.sketch(F.col(x)) for x in "abc")
    r = df.select(S.containment(a, c).alias("in_whole"), S.containment(S.merge(a, b), c).alias("both"), S.containment(c, a).alias("back")).first()
    assert r.in_whole == r.both == 1.0 and 0.3 < r.back < 0.7


def test_short_texts(spark):
    def words(prefix, n):
        return [f"{prefix}{i}" for i in range(n)]
    pairs, want = [], []
    for n in range(5, 21):
        for k in range(6):
            w = words(f"s{n}x{k}y", n)
            half = w[:n // 2 + 3] + words(f"t{n}x{k}y", n)[n // 2 + 3:]
            runs = [{tuple(v[i:i + 5]) for i in range(len(v) - 4)} for v in (w, half)]
            pairs.append((" ".join(w), " ".join(words(f"u{n}x{k}y", n)), " ".join(half), " ".join(w + words(f"v{n}x{k}y", 300))))
            want.append(len(runs[0] & runs[1]) / len(runs[0] | runs[1]))
    a, b, c, d = (S.sketch(F.col(x)) for x in "abcd")
    both = S.sketch(F.concat_ws(" ", F.lit("never"), "a"))
    rows = spark.createDataFrame(pairs, "a string, b string, c string, d string").select(
        F.size(a).alias("n"), S.likeness(a, b).alias("other"), S.likeness(a, c).alias("half"), S.likeness(a, a).alias("same"), S.containment(a, d).alias("part"),
        S.containment(S.merge(a, d), d).alias("merged"), S.containment(a, S.merge(a, b)).alias("union"), S.likeness(a, both).alias("longer")).collect()
    assert all(r.n > 0 and r.other == 0 and r.same == 1 and r.part in (1, None) and r.merged == 1 and r.union == 1 and r.longer > 0 for r in rows)
    assert sum(r.part is None for r in rows) < len(rows) / 2
    assert all(abs(r.half - x) < (1e-9 if r.n < S.LEAST else 0.2) for r, x in zip(rows, want))


def test_next_row_over_many_ranges(spark, odd):
    df = spark.createDataFrame([(i * 7, f"text {i}") for i in range(100)] + [(7, "again"), (7, "again")], "doc_id long, text string")
    for extra in ([], [(None, "none a"), (None, None)]):
        rows = df.union(spark.createDataFrame(extra, "doc_id long, text string")) if extra else df
        want = sorted([(r.doc_id, r.text or "") for r in rows.collect()], key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0, r[1]), reverse=True)
        for per_part in (3, 1000):
            got = [tuple(r) for r in S.with_next(rows, per_part).select("doc_id", "text", F.col("next.text").alias("n")).collect()]
            expect = [(d, t, want[(i + 1) % len(want)][1]) for i, (d, t) in enumerate(want)]
            key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
            assert sorted(got, key=key) == sorted(expect, key=key)
    assert S.with_next(df.limit(0)).count() == 0
    assert S.with_next(odd).count() == odd.count() and S.fingerprints(odd).count() == odd.count()
    one = S.with_next(df.limit(1)).first()
    assert one.next.text == one.text
    nulls = spark.createDataFrame([(None, "b"), (None, "a")], "doc_id long, text string")
    assert sorted((r.text, r.next.text) for r in S.with_next(nulls).collect()) == [("a", "b"), ("b", "a")]
