"""Repeated, absent and null rows that operators once lost or mixed up."""

import pytest
from conftest import tuples

from locusframe.operators import calls, hits, intervals, ordered, probes, tables
from locusframe.plans import session
from locusframe.sources import reports
from locusframe.sources import tables as readers


def genome(spark):
    return probes.genome_chunks(spark.createDataFrame([("c", "ACGTTGTGCAACGTTGCAGGTTGCAACGTTGTGCAACGTTG")], "seq_id string, seq string"), 10)


def test_fetch_keeps_rows(spark):
    rows = [("c", 5, 15), ("c", 5, 15), ("c", 38, 60), ("c", 500, 510), ("none", 0, 5)]
    got = probes.fetch(spark.createDataFrame(rows, "chrom string, start long, end long"), genome(spark), 10)
    seq = "ACGTTGTGCAACGTTGCAGGTTGCAACGTTGTGCAACGTTG"
    key = lambda r: (r[:3], r[3] or "")
    exp = [("c", 5, 15, seq[5:15])] * 2 + [("c", 38, 60, seq[38:]), ("c", 500, 510, None), ("none", 0, 5, None)]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(exp, key=key)


def test_markers_of_repeated_and_absent_sites(spark):
    sites = spark.createDataFrame([("c", 25, "A", "G"), ("c", 25, "A", "G"), ("gone", 3, "T", "C")], "chrom string, pos long, ref string, alt string")
    got = sorted(r["sequence"] for r in probes.flank_markers(sites, genome(spark), 5, 10).collect())
    assert got == ["GTTGC[A/G]ACGTT", "GTTGC[A/G]ACGTT", "[T/C]"]
    assert [r["chrom"] for r in probes.check_ref(sites, genome(spark), 10).collect()] == ["gone"]


def test_intervals_with_one_id(spark):
    iv = spark.createDataFrame([("a", "c", 0, 10), ("a", "c", 100, 110)], "id string, chrom string, start long, end long")
    points = spark.createDataFrame([("c", 5, 1), ("c", 105, 1)], "chrom string, pos long, v int")
    assert tuples(intervals.map_overlap(iv, points, "v"), "start", "mapped") == [(0, 1), (100, 1)]
    other = spark.createDataFrame([("c", 3, 4)], "chrom string, start long, end long")
    assert tuples(intervals.subtract_overlapping(iv, other, "id"), "id", "start") == [("a", 100)]


def test_split_keeps_what_crosses(spark):
    pieces = spark.createDataFrame([("c", 0, 100, "ca"), ("c", 100, 200, "cb")], "chrom string, start long, end long, part string")
    iv = spark.createDataFrame([("c", 90, 110), ("c", 100, 120)], "chrom string, start long, end long")
    split = intervals.split_coords(iv, pieces)
    assert tuples(split, "chrom", "start", "end") == [("ca", 90, 110), ("cb", 0, 20)]
    assert tuples(intervals.restore_coords(split, pieces), "chrom", "start", "end") == [("c", 90, 110), ("c", 100, 120)]


def test_rows_without_order_stay(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("a", 5)], "k string, o long")
    assert sorted(r["id"] for r in hits.number_copies(df, "k", "o").collect()) == ["a", "a", "a-2"]
    assert ordered.numbered(df, ["k"], "o", "n").count() == 3


def test_unranked_chromosomes_come_last(spark):
    sizes = spark.createDataFrame([("b", 1), ("a", 2)], "chrom string, rank int")
    df = spark.createDataFrame([("z", 1), ("a", 1), ("b", 2)], "chrom string, pos long")
    assert [r["chrom"] for r in tables.sort_sites(df, sizes).collect()] == ["b", "a", "z"]


def test_last_match_in_a_log(spark, tmp_path):
    (tmp_path / "k.log").write_text("CV error (K=2): 0.9\nCV error (K=3): 0.5\nend\n")
    got = reports.read_log_values(spark, str(tmp_path / "k.log"), {"cv": r"CV error \(K=\d+\): ([0-9.]+)"}).first()
    assert got["cv"] == 0.5


def test_csv_files_meet_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("y,x,z\n4,3,5\n")
    got = readers.scan_csv_glob(spark, str(tmp_path / "*.csv"))
    assert sorted((r["x"], r["y"], r["z"] or "") for r in got.collect()) == [("1", "2", ""), ("3", "4", "5")]


def test_groups_that_repeat_a_chromosome(spark):
    rows = [("c", 1, "A", "G", s, g) for s, g in (("p", "0/0"), ("q", "1/1"), ("k", "0/0"))]
    c = spark.createDataFrame(rows, "chrom string, pos long, ref string, alt string, sample_id string, gt string")
    fam = spark.createDataFrame([("p", "q", "k")], "p1 string, p2 string, child string")
    groups = spark.createDataFrame([("c", "A")] * 3, "chrom string, chrom_group string")
    assert {r["n_diff"] for r in calls.contribution(c, fam, groups).collect()} == {1}


def test_no_local_folder_on_a_cluster():
    class Conf(dict):
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError):
        session.shared_dir(Session())
