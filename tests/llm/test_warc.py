import glob
import gzip
import os
import random

import duckdb
from pyspark.sql import functions as F

from quillon.llm import warc as W


def brute(rows, least=0):
    first = {}
    for i, _, html in rows:
        if i is not None:
            d = (html or "").encode()
            first[d] = min(first.get(d, i), i)
    for i, _, html in rows:
        d = (html or "").encode()
        f = first.get(d)
        other = len(d) >= least and i is not None and f != i
        yield i, len(d), W.digest(d), "revisit" if other else "response", f if other else None


def result(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=repr)


def test_whole_table(spark):
    path = "/root/testdata/sf0.01/pages.parquet"
    rows = duckdb.sql(f"select page_id, url, html from '{path}'").fetchall()
    assert result(W.round_trip(spark.read.parquet(path))) == sorted(brute(rows), key=repr)


def test_edges(spark):
    rows = [(5, "u", "same"), (3, None, "same"), (3, None, "same"), (9, "a b\r\nX: y", None), (8, "é", ""), (7, "u", "x" * 300000), (None, "n", "same"), (4, "u", "é😀\r\n\r\nWARC/1.1")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("i", F.lit(1)).withColumn("payload", F.lit("clash"))
    for least in (0, 5):
        assert result(W.round_trip(df, least_bytes=least)) == sorted(brute(rows, least), key=repr)
    assert W.round_trip(df.limit(0)).count() == 0


def test_ranges_and_false_magics(spark, tmp_path):
    """Every range length gives the same records, though payloads are full of magics in stored blocks."""
    draw = random.Random(3)
    rows = []
    for i in range(60):
        body = bytes(draw.choices(b"\x1f\x8b\x08", k=draw.randrange(400))) + W.MAGIC * draw.randrange(9) + os.urandom(50)
        rows.append((i, body))
    os.makedirs(tmp_path / "in")
    with open(tmp_path / "in" / "a.warc", "wb") as out:
        for i, body in rows:
            plain = gzip.decompress(W.record(f"urn:page:{i}", "u", body))
            out.write(gzip.compress(plain, 0, mtime=0))  # stored: magics of the payload stay as they are
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        for size in (97, 256, 1031, 1 << 20):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            got = W.read(spark, str(tmp_path / "in"))
            assert sorted((r.record_id, bytes(r.payload), r.payload_bytes) for r in got.collect()) == sorted((f"urn:page:{i}", b, len(b)) for i, b in rows), size
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_archives_are_gzip(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", f"page {i}") for i in range(20)], "page_id long, url string, html string")
    W.write(df, str(tmp_path / "w"))
    plain = b"".join(gzip.decompress(open(f, "rb").read()) for f in glob.glob(str(tmp_path / "w" / "part-*")))
    assert plain.count(b"WARC/1.1\r\n") == 20


def test_malformed_records_are_skipped():
    good = gzip.decompress(W.record("urn:page:1", "u", b"body"))
    assert W.parse(good)[4] == 4
    for bad in (b"x", b"100000000", b"-3", b"1e3", b"9" * 40, b""):
        length = str(good.split(b"Content-Length: ")[1].split(b"\r\n")[0].decode()).encode()
        assert W.parse(good.replace(b"Content-Length: " + length, b"Content-Length: " + bad, 1)) is None
    assert W.parse(b"") is None and W.parse(b"WARC/1.1\r\n\r\n") is None


def test_members_that_grow_without_end_are_dropped(monkeypatch):
    monkeypatch.setattr(W, "MOST_RECORD_BYTES", 100_000)
    state = W.Assembler()
    bomb, good = W.record("urn:page:1", "u", b"0" * 10_000_000), W.record("urn:page:2", "u", b"body")
    assert state.feed(bomb) is None and W.parse(state.feed(good))[0] == "response"
