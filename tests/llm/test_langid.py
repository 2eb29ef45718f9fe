import zlib

from sensorloom.llm import langid as L
from sensorloom.llm.queries import LLM_QUERIES

from .conftest import SF_SMALL


def test_held_out_accuracy(spark, docs):
    lang = {r.doc_id: r.lang for r in docs.collect()}
    rows = LLM_QUERIES["op6_language_backoff"](spark, SF_SMALL).collect()
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)


def test_back_off_and_odd_texts(spark, odd):
    train = spark.createDataFrame([(1, "the thing and that", "en"), (2, "der die und nicht", "de"), (3, None, "de"), (4, "x", None), (None, "y", "fr")], "doc_id long, text string, lang string")
    m = L.fit(train)
    predict = lambda t: L.Scorer(m).predict([t])[0]
    assert m.langs == ["de", "en"]
    assert predict("nicht")[0] == "de" and predict("thethat")[0] == "en"
    assert predict("nichtund")[0] == "de"  # unseen word, known n-grams
    assert predict(None) == predict("") == predict("12 !") == predict("½ ²") == predict("Ⅷ ⅷ ㊿ ① ٣") == ("und", 0.0)
    assert predict("²nicht½")[0] == "de" and L.LETTERS.findall("x²y ª一 ñ") == ["x", "y", "ª一", "ñ"]
    rows = L.identify(odd, m).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r.lang_pred for r in rows}
    assert by[1] == by[2] == by[3] == "und" and by[8] in ("de", "en")
    assert L.identify(odd.limit(0), m).count() == 0
    none = L.fit(train.limit(0))
    assert L.Scorer(none).predict(["word", None]) == [("und", 0.0)] * 2


def test_longest_known_gram_wins():
    import numpy as np
    m = L.Model.of(["a", "b"], {}, [{"x": np.array([0.0, -9.0])}, {"xy": np.array([-9.0, 0.0])}], np.zeros(2))
    assert [p for p, _ in L.Scorer(m).predict(["xy", "xz", "q"])] == ["b", "a", "a"]


def test_a_full_cache_changes_nothing(monkeypatch, texts, spark, docs):
    m = L.fit(docs)
    want = L.Scorer(m).predict(list(texts.values()))
    monkeypatch.setattr(L, "CACHE", 5)
    s = L.Scorer(m)
    got = [s.predict([t])[0] for t in texts.values()]
    assert [g[0] for g in got] == [w[0] for w in want] and max(abs(a[1] - b[1]) for a, b in zip(got, want)) < 1e-9


def test_letter_runs_are_those_of_the_whole_pattern(monkeypatch):
    every = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
    texts = [every[:128], every[:0xD800], every, "a\x1fb\x85c_d\u00b2e I\u0307\u0130 \U0001d400x \U0001f600y", "\u1160\u3164z", "", *(f"x{c}Y{c}" for c in every[:0x3000])]
    assert all(L.letter_runs(t) == L.LETTERS.findall(t.lower()) for t in texts)

    class Unused:
        def findall(self, text):
            raise AssertionError("the pattern that tries every class for a character")
    monkeypatch.setattr(L, "LETTERS", Unused())  # texts of ASCII or the first plane do without it
    assert L.letter_runs("One-two 3") == ["one", "two"] and L.letter_runs("Stra\u00dfe \u00bd") == ["stra\u00dfe"]
