import random
import re
from collections import Counter, defaultdict

from sensorloom.llm import divergence as D
from sensorloom.llm.queries import LLM_ORACLE, LLM_QUERIES

from .conftest import SF_SMALL

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=30, alpha=5, scale=10 ** 9, top=50):
    found = [(lang or "", source or "", [t.translate(LOWER) for t in TERM.findall(text or "")]) for lang, source, text in rows]
    documents, counts = Counter(), defaultdict(Counter)
    for lang, source, terms in found:
        counts[lang, source].update(terms)
        documents.update({(lang, t) for t in terms})
    out = set()
    for lang in {x for x, _ in counts}:
        kept = {t for (x, t), n in documents.items() if x == lang and n >= least}
        sources = {s: {t: counts[lang, s][t] for t in kept} for x, s in counts if x == lang}

        def share(c):
            n = sum(c.values()) + alpha * len(kept)
            return {t: 1 + scale * (c[t] + alpha) // n for t in kept}
        p = {s: share(c) for s, c in sources.items()}
        q = share({t: sum(c[t] for c in sources.values()) for t in kept})
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if sources[s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, v, k) for k, (v, item) in enumerate(items, 1) if part == "pair" or k <= top}
    return out


def got(df):
    rows = [(r.lang, r.source, r.part, r.item, r.value, r.rank) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_query_against_sql_and_plain_python(spark, duck):
    rows = got(LLM_QUERIES["op12_source_divergence"](spark, SF_SMALL))
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("lang", "source", "text").collect()
    assert rows == plain([tuple(r) for r in docs])
    res = duck.sql(LLM_ORACLE["op12_source_divergence"])
    assert rows == {tuple(dict(zip(res.columns, r))[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in res.fetchall()}


def test_many_sources_and_terms(spark):
    rng = random.Random(5)
    words = [f"{a}{b}{c}é" for a in "abcdefghij" for b in "klmnopqrst" for c in "uvwxyzabcd"]
    rows = [(rng.choice(["x", "y", None]), f"s{rng.randrange(140)}", " ".join(rng.choices(words[:rng.choice([20, 300, 1000])], k=40))) for _ in range(1500)]
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    assert got(D.audit(df, least_documents=3, top=4)) == plain(rows, 3, top=4)


def test_terms():
    assert D.terms("Été ÉTÉ A-b_c1d \U0001f600x\n[z]^`{|}") == Counter(x.encode() for x in ["Été".translate(LOWER), "ÉtÉ", "a", "b", "c", "d", "\U0001f600x", "z"])
    every = "".join(chr(i) + "q" for i in range(300))
    assert D.terms(every) == Counter(t.translate(LOWER).encode() for t in TERM.findall(every))


def test_odd_rows(spark, odd):
    rows = [(r.lang, r.source, r.text) for r in odd.collect()]
    assert got(D.audit(odd, least_documents=2)) == plain(rows, 2)
    empty = [("l", s, None) for s in "abc"] + [("l", "a", "..."), (None, None, None)]
    df = spark.createDataFrame(empty, "lang string, source string, text string")
    assert got(D.audit(df)) == plain(empty) and {v for *_, v, _ in got(D.audit(df))} == {0}
    assert D.audit(odd.limit(0)).count() == 0
