import re
from collections import Counter

import numpy as np
import pytest

from sensorloom.llm import ngram_join as J
from sensorloom.llm.components import components

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(texts, t=0.8):
    sets = {d: shingles(x) for d, x in texts.items()}
    ids = sorted(sets)
    links, root = Counter(), {d: d for d in ids}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) >= t * max(len(x), len(y)) and len(x & y) >= t * len(x | y):
                links[a] += 1
                links[b] += 1
                root[max(find(a), find(b))] = min(find(a), find(b))
    return links, {d: find(d) for d in ids}


def test_matches_brute_force(spark, docs, texts):
    links, root = brute(texts)
    got = {r.doc_id: r for r in J.jaccard_join(docs).collect()}
    assert got.keys() == texts.keys()
    assert {d: r.n_links for d, r in got.items()} == {d: links[d] for d in texts}
    assert {d: r.class_id for d, r in got.items()} == root
    assert sum(links.values()) > 0


def test_blocks_keep_every_link(spark, monkeypatch):
    """Tiny blocks: a component is compared in many tasks, with the same counts."""
    base = [f"w{i}" for i in range(200)]
    texts = {}
    for d in range(40):  # near copies of growing length, so that some pairs are too far apart
        texts[d] = " ".join(base[:150 + d] + [f"own{d}"])
    df = spark.createDataFrame([(d, t) for d, t in texts.items()], "doc_id long, text string")
    links, root = brute(texts)
    for n in (512, 3):
        monkeypatch.setattr(J, "BLOCK_DOCS", n)
        got = {r.doc_id: r for r in J.jaccard_join(df).collect()}
        assert {d: r.n_links for d, r in got.items()} == {d: links[d] for d in texts}
        assert {d: r.class_id for d, r in got.items()} == root


def test_pair_counts_dense_and_rare():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60 if i % 2 else 5000, 80)).astype(np.uint64) for i in range(30)]
    got = J.pair_counts(sets)
    for i in range(30):
        for j in range(30):
            if i != j:
                assert got[i, j] == len(np.intersect1d(sets[i], sets[j]))


def test_depth_is_shortened_until_the_target_recall():
    assert J.forest_depth(0.8, 16, 6, 0.999) == 4
    assert J.recall(0.8, 4, 16) >= 0.999 > J.recall(0.8, 5, 16)


def test_odd_rows(spark, odd):
    got = J.jaccard_join(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[5].text_class == by[6].text_class == 5 and by[6].class_id == 5 and by[7].class_id == 5
    assert by[8].class_id == by[9].class_id == 8
    assert by[1].n_links == by[2].n_links == by[3].n_links == 0
    assert [r.class_id for r in got if r.doc_id is None] == [None, None]
    kept = J.keep_one_per_class(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 2, 3, 4, 5, 8, 10, 11, 12]
    empty = odd.limit(0)
    assert J.jaccard_join(empty).count() == 0


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(i, i + 1) for i in range(60)], [(1, 5), (5, 9), (2, 7), (9, 1), (3, 3)]])
def test_components(spark, edges):
    root = {}
    for a, b in edges:
        if a != b:
            root.setdefault(a, a), root.setdefault(b, b)
    for _ in range(100):
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    df = spark.createDataFrame(edges, "a long, b long")
    assert {(r.node, r.root) for r in components(df).collect()} == set(root.items())
