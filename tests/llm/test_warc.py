import duckdb
import gzip
import hashlib
import os

from sensorloom.llm import warc as W
from sensorloom.llm.queries import LLM_ORACLE, LLM_QUERIES

from .conftest import SF_SMALL


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{SF_SMALL}/pages.parquet')")
    want = sorted(con.sql(LLM_ORACLE["op2_legacy_archives"]).fetchall())
    got = LLM_QUERIES["op2_legacy_archives"](spark, SF_SMALL)
    assert sorted(map(tuple, got.collect())) == want


def test_round_trip_of_odd_pages(spark):
    big = "x\r\n\r\nWARC/1.1\r\né" * 200
    rows = [(1, "http://a/ b\n", big), (2, None, big), (3, "http://c", big), (None, "http://d", None), (4, "http://e", ""), (5, "ftp://f", "s" * 999),
            (6, "http://g", "s" * 999), (3, "http://c", big), (7, "http://h", "http://u 0.0.0.0 20200101000000 text/html 5\nabcde")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload string")
    for version in (1, 2):
        got = W.archive_pages(df.repartition(3), version=version, with_payload=True).collect()
        assert len(got) == len(rows)
        assert sorted(r.payload_bytes for r in got) == sorted(len((h or "").encode()) for _, _, h in rows)
        by = {}
        for r in got:
            by.setdefault(r.page_id, []).append(r)
        assert sorted(r.record_type for r in by[3]) == ["response", "revisit"]
        keeper = next(r for r in by[3] if r.record_type == "response")
        for r in got:
            if r.record_type == "revisit":
                assert r.refers_to == 3 and r.refers_to_record == keeper.record_id
                assert r.payload_digest == hashlib.sha1(big.encode()).hexdigest()
            else:
                assert r.digest_ok and hashlib.sha1(bytes(r.payload)).hexdigest() == r.payload_digest
        assert by[1][0].record_type == by[2][0].record_type == "revisit"
        assert bytes(by[7][0].payload).decode() == rows[8][2]
        assert len({r.record_id for r in got}) == len(rows)
    assert W.archive_pages(df.limit(0)).count() == 0


def test_versions_and_declared_lengths():
    v1 = b"filedesc://x.arc 0.0.0.0 19970101 text/plain 76\n1 0 org\nURL IP-address Archive-date Content-type Archive-length\n"
    v1 = v1.replace(b"76", str(len(v1.split(b"\n", 1)[1])).encode())
    body = v1 + b"\nhttp://a/with blank 1.2.3.4 19970102030405 text/html 12\nHello\nworld!\n\nhttp://b 1.2.3.4 19970102030405 text/html 0\n\n"
    got = list(W.arc_records(body))
    assert [(r["URL"], r["block"]) for r in got] == [("http://a/with blank", b"Hello\nworld!"), ("http://b", b"")]
    names = W.FIELDS[2]
    head = f"2 0 org\n{names}\n"
    v2 = f"filedesc://x.arc 0.0.0.0 19970101000000 text/plain 200 - - 0 x.arc {len(head)}\n{head}\nhttp://c 1.2.3.4 19970102030405 image/gif 200 - - 77 x.arc 3\nGIF\n".encode()
    rec = list(W.arc_records(gzip.compress(v2[:100]) + gzip.compress(v2[100:])))
    assert rec[0]["Result-code"] == "200" and rec[0]["block"] == b"GIF"
    assert W.timestamp("19970102030405") == "1997-01-02T03:04:05Z" and W.timestamp("1997") == "1997-01-01T00:00:00Z"


def test_stream_in_small_steps():
    data = os.urandom(5000).replace(b"\n", b" ") + b"\n" + b"tail"
    s = W.Stream(gzip.compress(data), step=7)
    assert s.line() == data[:5000] and s.read(4) == b"tail" and s.line() is None
