import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from sensorloom.llm import merkle as M
from sensorloom.llm.queries import LLM_QUERIES

from .conftest import SF_SMALL


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes, fanout):
    """(root, proof of each node: steps of (place, siblings))"""
    proofs, at = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, where = [], []
        for a in range(0, len(nodes), fanout):
            run = nodes[a:a + fanout]
            for k in range(len(run)):
                for i in at[a + k]:
                    proofs[i].append((k, run[:k] + run[k + 1:]))
            up.append(h(*run))
            where.append([i for k in range(len(run)) for i in at[a + k]])
        nodes, at = up, where
    return nodes[0], proofs


def plain(rows, fanout):
    """rows of (group, key, leaf) -> {leaf: (subroot, root, proof)}"""
    groups = {}
    for g, k, x in rows:
        groups.setdefault(g, []).append((k is not None, k or 0, x))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x for *_, x in sorted(groups[g])], fanout) for g in order}
    root, upper = tree([trees[g][0] for g in order], fanout)
    out = {}
    for g, up in zip(order, upper):
        for (*_, x), proof in zip(sorted(groups[g]), trees[g][1]):
            out.setdefault(x, []).append((trees[g][0], root, proof + up))
    return out


@pytest.mark.parametrize("fanout,sizes", [(2, [1, 2, 3, 4, 5, 7, 9, 33, 100]), (3, [1, 10, 28, 82, 250, 244]), (16, [1, 16, 17, 257, 4097]), (4, [70])])
def test_against_a_plain_tree(spark, fanout, sizes):
    rng = random.Random(fanout)
    rows = [(None if g == 1 else f"é{g}" if g % 2 else f"s{g}", rng.randrange(10 ** 6) if i else None, h(str(g), str(i))) for g, n in enumerate(sizes) for i in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "source string, doc_id long, leaf string").repartition(5)
    got = M.manifest(df, fanout=fanout, block=3).select("*", M.fold(F.col("leaf"), F.col("proof")).alias("folded")).collect()
    want = plain(rows, fanout)
    assert len(got) == len(rows)
    for r in got:
        assert [(r.subroot, r.root, [(s.place, s.siblings) for s in r.proof])] == want[r.leaf]
        assert r.folded == r.root


def test_query_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()

    def leaf(d, text):
        values = [None if v is None else str(v) for v in (d.doc_id, d.source, d.lang, d.n_chars, text)]
        return h("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in values))
    want = plain([(d.source, d.doc_id, leaf(d, d.text)) for d in docs], 16)
    by_id = {d.doc_id: d for d in docs}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    bad = 0
    for r in LLM_QUERIES["op11_merkle_manifest"](spark, SF_SMALL).collect():
        d = by_id[r.doc_id]
        assert r.leaf == leaf(d, d.text)
        subroot, root, proof = want[r.leaf][0]
        assert (r.subroot, r.root, r.proof_sha256) == (subroot, root, h(*(x for _, s in proof for x in s)))
        text = d.text.translate(lower) if d.text is not None and zlib.crc32(str(d.doc_id).encode()) % 5 == 0 else d.text
        folded = leaf(d, text)
        for k, s in proof:
            folded = h(*s[:k], folded, *s[k:])
        assert (r.folded_root, r.verified) == (folded, folded == root)
        bad += not r.verified
    assert bad > 0


def test_equal_rows_and_a_hot_group(spark):
    df = spark.range(700).select(F.lit("s").alias("source"), F.lit(7).alias("doc_id"), F.lit(h("x")).alias("leaf"), F.lit(1).alias("idx"), F.lit("a").alias("n_words"))
    got = M.manifest(df, fanout=4).select("*", M.fold(F.col("leaf"), F.col("proof")).alias("folded")).collect()
    assert len(got) == 700 and {r.root for r in got} == {tree([h("x")] * 700, 4)[0]} and all(r.folded == r.root for r in got)
    assert sorted(r.idx for r in got) == list(range(700))
    assert "n_words" in got[0]


def test_odd_rows(spark, odd):
    leaves = odd.select("doc_id", "source", "next", "part", M.leaf(F.col("doc_id"), F.col("text")).alias("leaf"))
    got = M.manifest(leaves).select("*", M.fold(F.col("leaf"), F.col("proof")).alias("folded")).collect()
    assert len(got) == odd.count() and all(r.folded == r.root == r.subroot for r in got)
    assert M.manifest(leaves.limit(0)).count() == 0
    lone = M.manifest(leaves.where("doc_id = 1")).first()
    assert lone.root == lone.leaf and lone.proof == []
    assert spark.range(1).select(M.leaf(F.lit(None), F.lit("é"))).first()[0] == h("-2:é")
