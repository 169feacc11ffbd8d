"""Streams over files that are bounded in rows."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from check import rows
from locusframe.plans.catalog import files
from locusframe.plans.session import shared_dir
from locusframe.streaming import intake

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, table", [("str_site_stats", "calls"), ("str_sample_coverage", "depth"), ("str_intake", "events"), ("str_dedup", "lines")])
def test_stream_files_grow_in_number(spark, monkeypatch, name, table):
    monkeypatch.setattr(files, "STREAM_ROWS", 150, raising=False)
    shared = Path(shared_dir(spark).removeprefix("file://").removeprefix("file:"))
    before = set(shared.glob("*"))
    df = entry.queries()[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    con = duckdb.connect()
    for t in ("orders", "lineitem", "events"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    rel = con.sql(entry.oracle_sql()[name])
    assert got == rows(rel.columns, rel.fetchall())
    made = {p.name.rpartition("-")[0]: p for p in set(shared.glob("*")) - before}
    sizes = [con.sql(f"select count(*) from '{f}'").fetchall()[0][0] for f in made[table].glob("*.parquet")]
    assert max(sizes) <= 150 and sum(sizes) > 600
    # the files come in two batches however many they are
    assert len([p for p in (made["mark"] / "commits").iterdir() if p.name.isdigit()]) == 2


def test_state_is_not_in_the_heap(spark, tmp_path):
    src, key = str(tmp_path / "in"), "spark.sql.streaming.stateStore.providerClass"
    calls = spark.createDataFrame([("c", 1, "A", "G", "S1", "0/1"), ("c", 1, "A", "G", "S2", "1/1")], "chrom string, pos long, ref string, alt string, sample_id string, gt string")
    calls.write.parquet(src)
    q = intake.running_site_stats(intake.file_stream(spark, src, calls.schema), str(tmp_path / "out"), str(tmp_path / "mark"))
    q.awaitTermination()
    assert any(k.startswith("rocksdb") for k in q.lastProgress["stateOperators"][0]["customMetrics"])
    assert spark.conf.get(key, None) is None
