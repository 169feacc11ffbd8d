"""Queries over odd texts, and the plans and tasks of those that have to hold at size."""

from pathlib import Path

import duckdb
import pytest
from check import rows
from pyspark.sql import functions as F

import __spark_entry__ as entry
from locusframe.operators import calls as C
from locusframe.operators import probes as P
from locusframe.sources import fasta, vcf
from locusframe.sources.fasta import FastaReader
from locusframe.sources.ranges import _rest

ODD = ["", None, "12, 3.", "ACGT", "a", "Lorem ipsum dolor sit amet"]


@pytest.fixture(scope="module")
def odd(tmp_path_factory, spark):
    path = str(tmp_path_factory.mktemp("odd"))
    docs = [(k, ODD[k % len(ODD)], "en", "web", 1) for k in range(-6, 30)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1).write.parquet(f"{path}/documents.parquet")
    return path


def same(spark, path, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{path}/documents.parquet/*.parquet'")
    rel, df = con.sql(entry.oracle_sql()[name]), entry.queries()[name](spark, path)
    assert sorted(rel.columns) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(rel.columns, rel.fetchall())


def test_probe_reference_of_texts_without_bases(spark, odd):
    same(spark, odd, "scl_probe_reference")


def test_tile_summary_is_that_of_the_tiles(spark):
    records = spark.createDataFrame([(1, "ACGT" * 200), (2, "A" * 119), (3, "GATTACA" * 18), (4, "Ägsſ" * 90 + "é"), (5, "")], "seq_id bigint, seq string")
    got = {r["seq_id"]: (r["tiles"], r["least_tile"], r["greatest_tile"], r["starts"]) for r in P.tile_summary(records, 120).collect()}
    exp: dict = {}
    for r in P.tile_sequence(records, 120).collect():
        exp.setdefault(r["seq_id"], []).append((r["tile"], r["tile_seq"]))
    ends = lambda t: (len(t), min(s for _, s in t), max(s for _, s in t), sum(k for k, _ in t))
    assert got == {k: ends(t) for k, t in exp.items()}
    is_gc = lambda s: sum(x.upper() in ("G", "C", "S") for x in s)
    best = {k: min(t, key=lambda x: (abs(2 * is_gc(x[1]) - 120), x[0])) for k, t in exp.items()}
    assert {r["seq_id"]: (r["tile"], r["tile_seq"]) for r in P.best_gc_tile(records, 120).collect()} == best


def test_tiles_are_not_sorted(spark):
    """No aggregate sorts a row per tile: the tiles are looked through where they are cut."""
    for name in ("win_tile_sequence", "win_tile_fasta"):
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" in plan and "explode(sequence(1, last" not in plan, name


def test_short_ranges_share_a_task(spark, tmp_path):
    path = tmp_path / "a.fa"
    path.write_text("".join(f">{k} x\n" + "ACGT\n" * 20 for k in range(400)))
    x = fasta.read_fasta_pieces(spark, str(path), 30, 100)
    assert x.groupBy("file", "record", "seq_id").agg(F.sum(F.length("seq")).alias("n")).filter("n = 80").count() == 400
    tasks = FastaReader({"files": f'["file:{path}"]', "split": "100", "width": "30", "task": "1000000", "slots": "4"}).partitions()
    assert len(tasks) <= 5 and sum(len(t.ranges) for t in tasks) > 300
    # the rest of a line is not looked for in megabytes
    sizes = []

    class Spy:
        def read_at(self, n, at):
            sizes.append(n)
            return b"x" * n

    next(_rest(Spy(), 0, 1 << 30))
    assert sizes == [4096]


def test_probe_sequences_fetch_once(spark):
    plan = entry.queries()["scl_probe_with_marker"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan


def test_accession_is_parsed_once_a_row(spark):
    """The text of an accession is in no filter, where each condition would work it out anew."""
    for name in ("jn_build_db", "flow_mutant_summary"):
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("format_string") and not any("Filter" in x and "format_string" in x for x in plan.split("\n")), name
        assert sum("format_string" in x for x in plan.split("\n")) <= 1, name


def test_few_and_many_families_have_the_same_rows(spark, monkeypatch):
    gts = ["0/0", "0/1", "1/1", "./.", None]
    rows_ = [("c", p, "A", "T", f"S{k}", gts[(p * k + k) % 5]) for p in range(40) for k in range(5) if (p + k) % 4] + [("c", 1, "A", "T", "S2", "1/1"), ("c", 2, "A", "T", None, "0/0"), (None, 3, "A", "T", "S1", "0/0"), (None, 3, "A", "T", "S2", "0/1")]
    calls = spark.createDataFrame(rows_, "chrom string, pos bigint, ref string, alt string, sample_id string, gt string")
    pairs = spark.createDataFrame([("S1", "S2"), ("S2", "S1"), ("S1", "S2"), ("S3", "S3"), ("S4", None), ("S0", "S9"), ("S0", "S4")], "sample_a string, sample_b string")
    got = sorted(map(repr, C.pair_calls(calls, pairs).collect()))
    plan = C.pair_calls(calls, pairs)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
    monkeypatch.setattr(C, "FEW_FAMILIES", 0)
    assert got and got == sorted(map(repr, C.pair_calls(calls, pairs).collect()))


def test_depth_lines_of_a_sample_are_several_files(spark, monkeypatch):
    """No task has all lines of a sample, and every file has its header first."""
    seen = []
    keep = vcf.read_vcf_depth
    monkeypatch.setattr(vcf, "read_vcf_depth", lambda s, path: seen.append(path) or keep(s, path))
    entry.queries()["src_vcf_depth"](spark, "/root/testdata/sf0.001")
    files = sorted(Path(seen[0], "part=S1").glob("*.txt"))
    assert len(files) > 1 and all(f.read_text().startswith("#CHROM") for f in files)
