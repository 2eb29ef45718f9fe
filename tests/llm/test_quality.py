import zlib

import numpy as np
import pyarrow as pa

from sensorloom.llm import quality as Q
from sensorloom.llm.queries import LLM_QUERIES

SF_MID = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_MID}/labels.parquet").collect()}
    rows = LLM_QUERIES["op8_quality_neighbours"](spark, SF_MID).collect()
    assert len(rows) == spark.read.parquet(f"{SF_MID}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in label]
    assert sum(r.predicted == label[r.doc_id] for r in held) >= 0.95 * len(held)
    good = [r for r in held if label[r.doc_id] == 1]
    assert sum(r.predicted for r in good) >= 0.98 * len(good)


def test_votes_equal_plain_cosines():
    rng = np.random.default_rng(0)
    x = rng.poisson(0.3, (40, Q.DIM)).astype(np.float32)
    m = Q.Model(np.ones(Q.DIM, np.float32), rng.normal(size=(Q.DIM, 8)).astype(np.float32), np.zeros((30, 8), np.float32), rng.integers(0, 2, 30).astype(float), 0.5, 5)
    m.vectors = m.project(x[:30])
    got = m.score(x[30:])
    for row, s in zip(x[30:], got):
        v = (Q.weigh(row[None], m.idf) @ m.basis)[0]
        sims = [float(v @ u) / np.linalg.norm(v) for u in m.vectors]
        top = sorted(range(30), key=lambda i: -sims[i])[:5]
        w = [max(sims[i], 0) ** 4 + 1e-9 for i in top]
        assert abs(sum(a * m.labels[i] for a, i in zip(w, top)) / sum(w) - s) < 1e-4


def test_features_follow_texts():
    texts = ["Word word WORD!!", "", "word", "a$ b$"]
    x = Q.features(pa.array(texts))
    for i, t in enumerate(texts):
        assert (x[i] == Q.features(pa.array([t]))[0]).all()
    assert x[0, Q.DIM - 1] == 1 and x[0, :Q.N_WORDS].sum() == 3 and x[0, Q.N_WORDS:-1].sum() == 3 and not x[1].any()


def test_odd_rows(spark, odd):
    labels = spark.createDataFrame([(4, 1, 0), (5, 1, 0), (5, 0, 0), (8, 1, None), (9, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = Q.fit(odd, labels)
    assert len(model.labels) == 3 and model.labels.sum() == 2  # 4, 5 (both labels: 0), 8
    out = Q.score_documents(odd, model)
    rows = out.collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    empty = {r.row.doc_id: r.score for r in rows}
    assert empty[1] == empty[2] == model.prior
    assert Q.keep_good(odd, labels.limit(0)).count() == odd.count()
    assert Q.score_documents(odd.limit(0), model).count() == 0
