import gzip
import hashlib
import io
import os

from pyspark.sql import functions as F

from spanlab.llm import warc

BIG = "<html>é " + "x" * 1000


def pages(spark):
    rows = [(1, "http://a/", BIG), (2, "http://b/ c\r\nX: y", BIG), (3, None, BIG), (4, "u", "small"), (5, "u", "small"),
            (6, None, None), (7, "u", ""), (8, "u", "\r\n\r\nWARC/1.0\r\n\r\n" * 90), (9, "u", "y" * 3_000_000),
            (10, "u", "z" * 999), (11, "u", "z" * 999), (12, "u", "é" * 500), (13, "u", "é" * 500)]
    return (spark.createDataFrame(rows, "page_id long, url string, html string")
            .withColumn("payload", F.lit(1)).withColumn("record_type", F.lit("x")))


def want(rows):
    out = []
    for r in rows:
        p = (r.html or "").encode()
        same = [q.page_id for q in rows if (q.html or "").encode() == p]
        revisit = len(p) >= 1000 and r.page_id != max(same)
        out.append((r.page_id, len(p), hashlib.sha1(p).hexdigest(), "revisit" if revisit else "response",
                    max(same) if revisit else None))
    return sorted(out)


def test_round_trip(spark, tmp_path):
    p = pages(spark).repartition(3)
    got = sorted(tuple(r) for r in warc.round_trip(p, f"file:{tmp_path}/w").collect())
    assert got == want(p.collect())
    assert [r[3] for r in got][:3] == ["revisit", "revisit", "response"]


def test_no_pages_and_null_ids(spark, tmp_path):
    assert warc.round_trip(pages(spark).limit(0), str(tmp_path / "none")).collect() == []
    odd = spark.createDataFrame([(None, None, BIG), (None, "u", BIG), (1, "u", BIG)], "page_id long, url string, html string")
    rows = warc.round_trip(odd, str(tmp_path / "odd")).collect()
    assert sorted((r.page_id or 0, r.record_type) for r in rows) == [(0, "response"), (0, "response"), (1, "response")]


def test_files_are_plain_warc(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write(warc.to_records(pages(spark)).coalesce(1), path)
    names = [n for n in os.listdir(path) if n.endswith(".warc.gz")]
    text = gzip.open(os.path.join(path, names[0])).read()
    assert text.startswith(b"WARC/1.1\r\n") and text.count(b"WARC-Type: ") == 13 + 0
    assert b"\r\nX: y" not in text  # a header stays on its line
    # unpublished files of a lost attempt are not read
    with open(os.path.join(path, "part-lost.warc.gz"), "wb") as f:
        f.write(warc.member({"record_type": "response", "payload": b"x"}))
    assert warc.scan(spark, path).count() == 13


def test_files_are_planned_and_rolled(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.register(spark)
    warc.to_records(pages(spark)).coalesce(1).write.format("warc").option("file_bytes", 1).mode("append").save(path)
    assert len([n for n in os.listdir(path) if n.endswith(".warc.gz")]) == 13
    assert spark.read.format("warc").option("partition_bytes", 1).load(path).rdd.getNumPartitions() == 13
    warc.write(warc.to_records(pages(spark)), path)  # a second commit
    assert warc.scan(spark, path).count() == 26


def test_pushdown_and_skipped_payloads(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write(warc.to_records(pages(spark)), path)
    only = warc.scan(spark, path).where("record_type = 'revisit' and target_uri in ('http://a/', 'none')")
    assert [r.record_id for r in only.collect()] == ["1"]
    assert "Filter" not in only._jdf.queryExecution().executedPlan().toString().replace("RuntimeFilters", "")
    heads = warc.scan(spark, path, payload=False)
    assert heads.where("payload is not null").count() == 0
    assert heads.agg(F.sum("content_length")).first()[0] > 3_000_000
    read = []

    class Counting(io.BytesIO):
        def read(self, n=-1):
            data = super().read(n)
            read.append(len(data))
            return data
    noise = os.urandom(1_000_000)
    data = warc.member({"record_type": "response", "payload": noise}) * 3
    assert len(list(warc.records(Counting(data), lambda row: True, False))) == 3
    assert sum(read) < 100_000
    assert list(warc.records(io.BytesIO(data), lambda row: True, True))[2][-1] == noise
    assert list(warc.records(io.BytesIO(data), lambda row: False, True)) == []


def test_foreign_members(tmp_path):
    """Members without a stated length, as other writers make them."""
    def foreign(payload):
        block = b"HTTP/1.1 200 OK\r\n\r\n" + payload
        return gzip.compress(b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: 5\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n"
                             % (len(block), block))
    payloads = [os.urandom(200_000), b"", b"abc" * 100_000]
    data = b"".join(map(foreign, payloads)) + warc.member({"record_type": "response", "payload": b"own"})
    for payload in (True, False):
        rows = list(warc.records(io.BytesIO(data), lambda row: True, payload))
        assert [r[-1] for r in rows] == ([*payloads, b"own"] if payload else [None] * 4)
