"""Sinks: batch append, export guard, idempotent streaming document sink."""

import os
import uuid


from sensorloom.operators import store as S
from sensorloom.operators import twin as TW
from sensorloom.session import scratch_path
from sensorloom.streaming import stateful as ST


def test_append_and_latest(spark, fx):
    path = scratch_path(spark, "tests", f"store-{uuid.uuid4().hex}")
    docs = S.with_doc_id(fx.readings(), deterministic_from=["offset_id"], namespace="r")
    S.append(docs, path)
    S.append(docs.limit(5), path)
    back = spark.read.parquet(path)
    assert back.count() == docs.count() + 5
    top = S.latest(back, 3, tiebreak=["offset_id"]).collect()
    assert len(top) == 3 and "_id" not in top[0].asDict()


def test_export_skips_already_exported(spark, fx):
    path = scratch_path(spark, "tests", f"export-{uuid.uuid4().hex}")
    shells, refs, sms = fx.shells(), fx.submodel_refs(), fx.submodels()
    exported = shells.limit(3).select("shell_id")
    TW.export_shells(shells, refs, sms, exported, path)
    out = spark.read.json(path)
    assert out.join(exported, "shell_id", "left_semi").count() == 0
    assert out.select("shell_id").distinct().count() == shells.count() - 3
    # a second export with everything marked exported appends nothing new
    TW.export_shells(shells, refs, sms, shells.select("shell_id"), path)
    assert spark.read.json(path).count() == out.count()


def test_export_of_long_ids_is_small_on_disk(spark):
    path = scratch_path(spark, "tests", f"export-{uuid.uuid4().hex}")
    ids = [f"https://example.com/ids/sm/0000_0000_{i:08d}" for i in range(4000)]
    shells = spark.createDataFrame([("s1", "a"), ("s2", "b"), ("s3", None)], "shell_id string, id_short string")
    refs = spark.createDataFrame([("s1", m, i) for i, m in enumerate(ids)] + [("s2", "gone", 1), ("s2", ids[7], 5), (None, ids[8], 6)], "shell_id string, submodel_id string, pos long")
    submodels = spark.createDataFrame([(m, 1.5) for m in ids], "submodel_id string, price double")
    parts = TW.export_parts(shells, refs, submodels, shells.limit(0), part_size=500)
    assert TW.write_export(parts, path, "one")
    files = [os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.startswith("part-")]
    assert sum(map(os.path.getsize, files)) < sum(map(len, ids)) / 2  # the ids alone were 176,000 bytes before
    got = {(r.shell_id, r.part): [m.submodel_id for m in r.submodels] for r in TW.read_exports(spark, path, parts.schema).collect()}
    assert got == {("s1", p): ids[500 * p:500 * p + 500] for p in range(8)} | {("s2", 0): [ids[7]], ("s3", 0): []}


def test_document_sink_replay_is_idempotent(spark, fx):
    base = scratch_path(spark, "tests", f"sink-{uuid.uuid4().hex}")
    landing = os.path.join(base, "landing")
    fx.raw_messages().write.json(landing)
    from sensorloom.streaming import chain as CH
    from sensorloom.streaming import sources as SRC
    stream = CH.parsed_readings(SRC.json_messages(spark, landing))
    q = ST.document_sink(stream, f"{base}/coll", f"{base}/ckpt", "r", ["offset_id"])
    q.awaitTermination(300)
    first = spark.read.parquet(f"{base}/coll").drop("batch_id")
    n = first.count()
    # the same stream again has nothing new to add
    ST.document_sink(stream, f"{base}/coll", f"{base}/ckpt", "r", ["offset_id"]).awaitTermination()
    assert spark.read.parquet(f"{base}/coll").count() == n
    # another stream into the same collection overwrites nothing
    ST.document_sink(stream, f"{base}/coll", f"{base}/ckpt2", "other", ["offset_id"]).awaitTermination()
    both = spark.read.parquet(f"{base}/coll")
    assert both.count() == 2 * n and both.select("_id").distinct().count() == 2 * n


def test_messages_of_two_partitions_stay_apart(spark):
    from sensorloom.streaming import chain as CH
    rows = [("t", p, o, '{"source_type":"mqtt","asset_id":"a","timestamp":"2024-01-01 00:00:00","quality":"good","value":"1","unit":null}') for p in (0, 1) for o in range(3)]
    msgs = spark.createDataFrame([*rows, ("t", 1, 3, "{broken")], "topic string, partition int, offset_id long, value string")
    good = CH.parsed_readings(msgs)
    assert good.select("topic", "partition", "offset_id").distinct().count() == 6
    assert [(r.partition, r.offset_id, r.raw_value) for r in CH.rejected_messages(msgs).collect()] == [(1, 3, "{broken")]


def test_chain_taps_write_every_stage(spark, fx):
    from sensorloom.operators import readings as R
    from sensorloom.streaming import chain as CH
    from sensorloom.streaming import sources as SRC
    base = scratch_path(spark, "tests", f"taps-{uuid.uuid4().hex}")
    landing = os.path.join(base, "landing")
    fx.raw_messages().write.json(landing)
    flags = {"cleansing": True, "imputation": True, "normalization": True, "transformation": True}
    q = CH.start_chain(spark, SRC.json_messages(spark, landing), f"{base}/processed", flags,
                       taps={"cleansed": f"{base}/cleansed", "normalized": f"{base}/normalized"},
                       checkpoint=f"{base}/ckpt")
    q.awaitTermination(300)
    batch = CH.parsed_readings(spark.read.schema(SRC.MESSAGE).json(landing))
    expect = R.preprocess(batch, **flags).df
    got = spark.read.parquet(f"{base}/processed").drop("stream", "batch_id")
    assert sorted(got.columns) == sorted(expect.columns)
    assert got.count() == expect.count()
    assert spark.read.parquet(f"{base}/cleansed").count() == R.cleanse(batch).count()
    assert spark.read.parquet(f"{base}/normalized").where("asset_id IS NULL").count() == 0
