"""Small files as rows of a bundle: same rows as from the files, and no file per row."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from check import rows
from conftest import tuples
from locusframe.plans.session import shared_dir
from locusframe.sources import bundles, reports

RE = r"lib=([^/]+)/"


def _write(base, texts):
    for name, text in texts.items():
        (base / f"lib={name}").mkdir(parents=True)
        (base / f"lib={name}" / "x.txt").write_bytes(text.encode())


def test_reports_of_files_and_of_a_bundle(spark, tmp_path):
    curve = lambda *v: '{"quality_curves": {"mean": [%s]}}' % ", ".join(v)
    _write(tmp_path / "in", {
        "a": '{"read1_before_filtering":\n %s, "read2_before_filtering": %s, "command": "x \\" \\\\ y"}' % (curve("30.5", "31"), curve("20")),
        "b-1": '{"read1_before_filtering": %s}\r\n' % curve("1e-3", "null"), "none": "{}", "broken": '{"read1_before', "empty": "",
    })
    bundles.pack_files(spark, str(tmp_path / "in" / "*"), str(tmp_path / "out"))
    got = tuples(reports.read_fastp(spark, str(tmp_path / "out"), RE, bundle=True), "libid", "read_type", "curve")
    assert got == tuples(reports.read_fastp(spark, str(tmp_path / "in" / "*"), RE), "libid", "read_type", "curve")
    assert got == [("a", "read1", [30.5, 31.0]), ("a", "read2", [20.0]), ("b-1", "read1", [0.001, None])]


def test_logs_of_files_and_of_a_bundle(spark, tmp_path):
    _write(tmp_path / "in", {
        "a": "cv: 1\ncv: 2.5\nn: 7\n", "b": "n: 1\r\ncv: 3\r\nn: 2\r\ncv: .\r\n", "c": "nothing", "d": "cv: 4\rcv: 5", "empty": "",
    })
    want = {"cv": r"cv: ([0-9.]+)", "n": r"n: (\d+)"}
    bundles.pack_files(spark, str(tmp_path / "in" / "*"), str(tmp_path / "out"))
    key = lambda df: sorted(map(tuple, df.collect()), key=repr)
    got = key(reports.read_log_values(spark, str(tmp_path / "out"), want, RE, bundle=True))
    assert got == key(reports.read_log_values(spark, str(tmp_path / "in" / "*"), want, RE))
    assert got == [("a", 2.5, 7.0), ("b", 3.0, 2.0), ("c", None, None), ("d", 5.0, None)]


@pytest.mark.parametrize("name", ["src_quality_json", "src_log_values"])
def test_files_do_not_grow_with_libraries(spark, tmp_path, name):
    """Also a user without a value, one below zero, one near zero and events without a user."""
    v = F.when(F.col("id") % 300 == 7, None).when(F.col("id") % 300 == 8, -2.5).when(F.col("id") % 300 == 9, 2.5e-5).otherwise(F.col("id") / 8)
    user = F.when(F.col("id") % 300 > 0, F.col("id") % 300)
    t = spark.range(900).select(user.alias("user_id"), v.alias("value"), F.col("id").alias("event_id"), F.lit('{"k": 1}').alias("props"))
    t.write.parquet(str(tmp_path / "events.parquet"))
    shared = Path(shared_dir(spark).removeprefix("file://").removeprefix("file:"))
    before = set(shared.rglob("part-*"))
    df = entry.queries()[name](spark, str(tmp_path))
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    rel = con.sql(entry.oracle_sql()[name])
    assert got == rows(rel.columns, rel.fetchall())
    assert 0 < len(set(shared.rglob("part-*")) - before) <= 8
