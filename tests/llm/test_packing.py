import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sensorloom.llm import packing as K
from sensorloom.llm.queries import LLM_QUERIES

from .conftest import SF_SMALL

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(PATH)


def ids_of(tok, text):
    return np.array(tok.encode(text or "", add_special_tokens=False).ids + [1], "<u4")


def check(rows, want):
    """Every id in exactly one piece, sequences gapless and of a power of two."""
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    assert docs.keys() == want.keys()
    for d, pieces in docs.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            part = want[d][r.start:r.start + r.length]
            assert r.start == at and len(part) == r.length and r.doc_tokens == len(want[d])
            assert r.ids_crc32 == zlib.crc32(part.tobytes()) if "ids_crc32" in r else bytes(r.ids) == part.tobytes()
            at += r.length
        assert at == len(want[d])
    for pieces in seqs.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == pieces[0].window and at & (at - 1) == 0 and at <= 2048
    return seqs


def test_query_is_an_exact_round_trip(spark, texts, tok):
    rows = LLM_QUERIES["op5_hierarchical_packing"](spark, SF_SMALL).collect()
    seqs = check(rows, {d: ids_of(tok, t) for d, t in texts.items()})
    groups = defaultdict(int)
    for r in rows:
        groups[r.step_group] += r.length
    assert max(groups.values()) <= 1 << 16
    small = sum(p[0].window < 256 for p in seqs.values())
    assert small <= 8 * spark.sparkContext.defaultParallelism


def test_words_are_encoded_as_in_the_whole_text(tok):
    enc = K.Encoder(PATH, max_words=50)
    texts = ["", " ", "a", "a b", " a b ", "a  b", "a\n b", "a \n\n b", "it's we'll 'tis", "a\tb c", "é à b c d", "12 3 4.5", "x <|endoftext|> y", "😀 😀a b",
             "a\x1c b", "a \u0085 b", "​ b c", "日本 語 text", "... ,, a!! b", "a b\n", "\na b", "Ġ Ġa b"]
    for _ in range(3):
        got = enc.encode(texts)
        for t, g in zip(texts, got):
            assert np.frombuffer(g, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_odd_rows_and_small_pool(spark, odd, tok):
    rows = K.pack(odd.where("doc_id is not null").dropDuplicates(["doc_id"]).repartition(2), PATH, pool_tokens=300).collect()
    want = {r.doc_id: ids_of(tok, r.text) for r in odd.collect() if r.doc_id is not None}
    check(rows, want)
    assert sum(r.length for r in K.pack(odd, PATH).collect()) == sum(len(ids_of(tok, r.text)) for r in odd.collect())
    assert K.pack(odd.limit(0), PATH).count() == 0


def test_tiers_fill_gaps():
    p = K.Packer(0, K.TIERS, 1 << 16, 1 << 30)
    for i, n in enumerate([1500, 500, 48, 1000, 24, 200, 56]):
        p.add(i, np.full(n, i, "<u4").tobytes())
    p.finish()
    windows = defaultdict(list)
    for doc, _, n, _, _, seq, _, size, _ in p.out:
        windows[seq, size].append((doc, n))
    assert windows[0, 2048] == [(0, 1500), (1, 500), (2, 48)]
    assert windows[1, 1024] == [(3, 1000), (4, 24)]
    assert sum(k[1] for k in windows) == 3328
