import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from sensorloom.llm import pieces as P
from sensorloom.llm.queries import LLM_QUERIES

from .conftest import SF_SMALL

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def lib():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def same(lib, texts):
    voc = P.vocabulary(MODEL)
    ids = [np.frombuffer(x, "<u4") for x in voc.encode(texts)]
    want = lib.encode(texts, num_threads=1)
    for text, a, b in zip(texts, ids, want):
        assert a.tolist() == b, text[:100]
    assert voc.decode(np.concatenate(ids), np.array([len(x) for x in ids])) == lib.decode(want)


def test_query_against_the_library(spark, lib, texts):
    rows = {r.doc_id: r for r in LLM_QUERIES["op13_sentence_pieces"](spark, SF_SMALL).collect()}
    assert rows.keys() == texts.keys()
    for d, text in texts.items():
        ids = lib.encode(text or "", add_bos=True, add_eos=True)
        assert rows[d].n_tokens == len(ids)
        assert rows[d].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[d].decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


def test_random_texts(lib):
    rng = random.Random(1)
    letters = ["abcdefghijklmnopqrstuvwxyz", "the and ing tion  ", "aA1 _-\n\t", "\u2581 x", " ab", "\u4e2d\u6587\u5b57\u7b26\u7684", "\u00e9\U0001f600\u00f1\x00\ufffd ", "<0x0A><s></s>"]
    texts = [""] + ["".join(rng.choice(rng.choice(letters) + rng.choice(letters)) for _ in range(rng.choice([1, 3, 8, 20, 70, 200]))) for _ in range(3000)]
    words = [lib.id_to_piece(i).replace("\u2581", " ") for i in range(259, 32000)]
    for gap in ("", " "):
        texts += [gap.join(rng.choice(words) for _ in range(rng.choice([2, 5, 15, 40, 300]))) for _ in range(800)]
    texts += ["".join(rng.choice(words).strip() for _ in range(400)) for _ in range(100)]
    same(lib, texts)


@pytest.mark.parametrize("text", ["a" * 100_000, " " * 100_000 + "x", "the" * 30_000, "ab" * 5000 + " " * 31, base64.b64encode(random.Random(2).randbytes(60_000)).decode()])
def test_long_texts_without_blanks(lib, text):
    same(lib, [text])


def test_ids_that_no_text_gives(lib):
    rng = random.Random(3)
    rows = [[rng.randrange(rng.choice([32000, 260])) for _ in range(rng.randrange(12))] for _ in range(2000)]
    got = P.vocabulary(MODEL).decode(np.array([x for r in rows for x in r]), np.array([len(r) for r in rows]))
    assert got == lib.decode(rows)
    with pytest.raises(ValueError):
        P.vocabulary(MODEL).decode(np.array([32000]), np.array([1]))


def test_full_cache_gives_the_same_ids(lib, texts):
    voc = P.Vocabulary(MODEL, max_words=50)
    some = [t for t in texts.values() if t][:30]
    for t in some:
        assert np.frombuffer(voc.encode([t])[0], "<u4").tolist() == lib.encode(t)


def test_odd_rows(spark, odd, lib):
    rows = P.encode_documents(odd, MODEL).collect()
    assert len(rows) == odd.count()
    by_id = {r.doc_id: r for r in rows}
    for d in (1, 2):
        assert np.frombuffer(by_id[d].ids, "<u4").tolist() == [1, 2] and by_id[d].n_tokens == 2
    for d, text in [(r.doc_id, r.text) for r in odd.collect() if r.doc_id is not None]:
        assert np.frombuffer(by_id[d].ids, "<u4").tolist() == lib.encode(text or "", add_bos=True, add_eos=True)
    assert P.encode_documents(odd.limit(0), MODEL).count() == 0
    back = spark.createDataFrame([(None,)], "ids binary").select(P.decode_ids("ids", MODEL).alias("t")).first()
    assert back.t == ""
