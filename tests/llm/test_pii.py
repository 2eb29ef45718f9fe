import hashlib
import random
import re

from sensorloom.llm import pii as P
from sensorloom.llm.queries import LLM_QUERIES

from .conftest import SF_SMALL

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", m) for m in EMAIL.finditer(text)]
    out += [("ip", m) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", m) for m in CARD.finditer(text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", m) for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]
    return [f"{k}:{m.start()}:{m.end()}" for k, m in out]


def base(text):
    return [f"{s['kind']}:{s['start']}:{s['end']}" for s in P.scan(text) if s["kind"] in P.BASE]


def test_random_strings_equal_the_plain_patterns():
    rng = random.Random(3)
    pieces = ["a", "b.c", "@", ".", "-", " ", "4111111111111111", "4111 1111 1111 1111", "+1 (514) 555-8389", "10.0.0.1", "256.1.1.1", "00255.1.1.1", "1.2.3.4.5.6.7.8",
              "+", "(", ")", "7", "x@y.z", "é", "١", "%", "_", "\n", "0"]
    for _ in range(4000):
        t = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 25)))
        assert base(t) == brute(t), t


def test_query_on_whole_texts(spark, texts):
    for r in LLM_QUERIES["op3_personal_data"](spark, SF_SMALL).collect():
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k + ":") for w in want) for k in P.BASE]
        assert set(want) <= set(r.spans.split(",")) | {""}


def test_checksums_and_context():
    spans = P.scan("bank account DE89 3704 0044 0532 0130 00, social security 123-45-6789" + " z" * 30 + " part 123-45-6789")
    assert [s["kind"] for s in spans] == ["iban", "ssn"]
    assert P.scan("IBAN DE89 3704 0044 0532 0130 01") == []
    routing = P.scan("routing 021000021 " + "z" * 60 + " order 021000021")
    assert [s["kind"] for s in routing][:1] == ["routing"] and routing[-1]["end"] < 60
    near = P.scan("card 4111111111111111")[0]["score"]
    assert near > P.scan("sample 4111111111111111")[0]["score"]


def test_ibans_with_words_after():
    def found(text):
        return [text[x["start"]:x["end"]] for x in P.scan(text) if x["kind"] == "iban"]
    de, gb, no = "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "NO93 8601 1117 947"
    for iban in (de, gb, no, de.replace(" ", ""), "MT84MALT011000012345MTLCAST001S"):
        for after in ("", " BIC COBADEFF", " 12345", " EUR 100", " A", ", B", " and"):
            assert found(f"IBAN {iban}{after}") == [iban], (iban, after)
        assert found(f"IBAN {iban}X") == [] and found(f"IBAN {iban}7") == []
    assert found(f"IBAN {de} {gb} {no}") == [de, gb, no]
    assert found("IBAN AB12 " + de) == [de]
    other = next(x for x in (f"ZZ{c:02d} 1234 5678 9012 345" for c in range(100)) if P.mod97(x.replace(" ", "")))
    assert other in found(f"IBAN {other}") and P.scan("DE89 " * 40_000) == []


def test_odd_rows(spark, odd):
    got = P.find_personal_data(odd).collect()
    assert len(got) == odd.count() and all(r.found == [] for r in got)
    assert P.find_personal_data(odd.limit(0)).count() == 0
    assert P.scan("1" * 200_000) == [] and P.scan("a@" * 50_000) == [] and P.scan("9." * 50_000) != 1
