"""Archives: an exact round trip."""

import base64
import gzip
import hashlib

from pyspark.sql import functions as F

from locusframe.llm import warc
from locusframe.llm.warc import read_warc, write_warc
from locusframe.plans.session import scratch

PAGES = [
    (1, "http://a.example/x y", "<p>one</p>"), (2, "http://a.example/", "<p>one</p>"), (3, None, None), (4, "u\r\nv", ""), (5, "http://b", "é\r\n\r\nWARC/1.1 ß"),
    (None, "http://c", "<p>one</p>"), (6, "http://d", "z" * 300_000), (7, "http://e", "dup"), (7, "http://e", "dup"), (8, "http://f", "dup"),
]


def b32(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def frame(spark):
    return spark.createDataFrame([(*p, 1, "f") for p in PAGES], "page_id bigint, url string, html string, offset int, file string").repartition(3)


def test_round_trip(spark):
    folder, low = scratch(spark, "warc-test"), -(1 << 63)
    index = write_warc(frame(spark), folder)
    got = read_warc(index, folder, payload=True).collect()
    first = {}
    for i, _, html in PAGES:
        first[html or ""] = min(first.get(html or "", 1 << 62), low if i is None else i)
    exp = []
    for i, _, html in PAGES:
        i, text = low if i is None else i, html or ""
        new = first[text] == i
        exp.append((i, "response" if new else "revisit", None if new else first[text], len(text.encode()), b32(text), text.encode() if new else None))
    key = lambda r: (r[0], r[4])
    rows = [(r["id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"], None if r["payload"] is None else bytes(r["payload"])) for r in got]
    assert sorted(rows, key=key) == sorted(exp, key=key)
    some = read_warc(index.filter(F.col("id") == 5), folder, payload=True).collect()
    assert [bytes(r["payload"]).decode() for r in some] == ["é\r\n\r\nWARC/1.1 ß"]
    one = index.filter(F.col("id") == 1).first()
    with open(f"{folder.removeprefix('file://')}/{one['file']}", "rb") as f:
        f.seek(one["offset"])
        record = gzip.decompress(f.read(one["length"]))
    assert record.startswith(b"WARC/1.1\r\nWARC-Type: revisit") or record.startswith(b"WARC/1.1\r\nWARC-Type: response")


def test_least_size_and_empty(spark):
    folder = scratch(spark, "warc-test")
    got = read_warc(write_warc(frame(spark), folder, least=4), folder).collect()
    assert all(r["record_type"] == "response" for r in got if r["payload_bytes"] < 4)
    assert any(r["record_type"] == "revisit" for r in got)
    folder = scratch(spark, "warc-test")
    assert read_warc(write_warc(frame(spark).limit(0), folder), folder).count() == 0


def test_readers_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "READER_BYTES", 2000)
    rows = [(k, "u", f"{k} " * 300) for k in range(60)]
    index = warc.write_warc(spark.createDataFrame(rows, "page_id bigint, url string, html string"), str(tmp_path))
    found = warc.read_warc(index, str(tmp_path))
    assert found.rdd.getNumPartitions() > 3 and found.count() == 60


def test_folder_has_sparks_file_system(spark):
    assert warc.qualified(spark, "/a/b") == "file:///a/b" and warc.qualified(spark, "file:///a/b") == "file:///a/b"
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.defaultFS", "viewfs://store")
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.store.link./in", "file:///tmp")
    try:
        assert warc.qualified(spark, "/in/b") == "viewfs://store/in/b"
    finally:
        spark.sparkContext._jsc.hadoopConfiguration().set("fs.defaultFS", "file:///")
