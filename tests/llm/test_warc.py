import gzip
import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from chronolith.llm.common import scratch_path
from chronolith.llm.warc import ORACLE, op7_warc, read_warc, write_warc


def test_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    want = sorted(con.execute(ORACLE).fetchall())
    got = sorted(map(tuple, op7_warc(spark, sf).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()))
    assert got == want


def test_round_trip_and_edges(spark):
    big = "é\r\n\r\nWARC/1.1\r\n" + "x" * 1500
    rows = [(1, "http://a/\r\nX: 1", big), (2, None, big), (3, "u", ""), (4, "u", None), (None, "u", big), (5, "u", "small"), (6, "u", "small"), (2, None, big), (7, "u", "y" * 100_000)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, bytes string").repartition(3)
    path = scratch_path(spark, "t")
    write_warc(df, path)
    got = read_warc(spark, path).collect()
    assert len(got) == len(rows)
    texts = {i: t or "" for i, _, t in rows}
    for r in got:
        assert r.payload_digest == "sha1:" + hashlib.sha1(texts[r.page_id].encode()).hexdigest()
        assert r.payload_length == len(texts[r.page_id].encode())
        assert r.payload == (texts[r.page_id] if r.warc_type == "response" else None)
    assert sorted((r.page_id, r.refers_to_page) for r in got if r.warc_type == "revisit") == [(1, 2)]
    assert [r.refers_to for r in got if r.page_id == 1] == ["<urn:page:2>"]
    empty = scratch_path(spark, "t")
    write_warc(df.limit(0), empty)
    assert read_warc(spark, empty).count() == 0


def test_predicates_are_pushed_down(spark):
    df = spark.range(50).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.lit("p"), F.lit(1200)).alias("html"))
    path = scratch_path(spark, "t")
    write_warc(df, path)
    read = read_warc(spark, path, ["warc_type", "page_id", "payload"]).where("warc_type = 'response' and page_id in (49, 3)")
    plan = read._jdf.queryExecution().toString()
    assert [r.page_id for r in read.collect()] == [49]
    assert "Filter (warc_type" not in plan.split("== Physical Plan ==")[1]


def test_rows_that_share_a_page_id(spark, tmp_path):
    x, y, z = ("x" * 1500, "y" * 1500, "z" * 1500)
    df = spark.createDataFrame([(7, "u", x), (9, "u", x), (7, "u", z), (7, "u", y), (11, "u", y)], "page_id long, url string, html string")
    df.write.parquet(f"{tmp_path}/pages.parquet")
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    want = [(7, sha(x), "revisit", 9), (9, sha(x), "response", None), (7, sha(z), "response", None), (7, sha(y), "revisit", 11), (11, sha(y), "response", None)]
    got = [(r.page_id, r.payload_digest, r.record_type, r.refers_to) for r in op7_warc(spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_gzip_members_and_malformed_records(spark, tmp_path):
    record = lambda kind, page, block, length=None: f"WARC/1.1\r\nWARC-Type: {kind}\r\nX-Page-ID: {page}\r\nContent-Length: {len(block) if length is None else length}\r\n\r\n{block}\r\n\r\n".encode()
    (tmp_path / "good").mkdir()
    members = [record("response", 1, "HTTP/1.1 200 OK\r\n\r\nhello"), record("warcinfo", "none", "about"), record("response", 2, "no blank line")]
    (tmp_path / "good/a.warc.gz").write_bytes(b"".join(map(gzip.compress, members)))
    (tmp_path / "good/b.warc").write_bytes(b"".join(members))
    got = sorted((r.page_id or 0, r.warc_type, r.payload or "") for r in read_warc(spark, f"{tmp_path}/good").collect())
    assert got == sorted([(0, "warcinfo", ""), (1, "response", "hello"), (2, "response", "")] * 2)
    for bad in (record("response", 1, "x", "soon"), b"not a record\r\n\r\n", gzip.compress(members[0])[:-20]):
        folder = tmp_path / str(len(bad))
        folder.mkdir()
        (folder / ("a.gz" if bad[:1] == b"\x1f" else "a.warc")).write_bytes(bad)
        with pytest.raises(Exception, match="a\\.(gz|warc)"):
            read_warc(spark, str(folder)).collect()
