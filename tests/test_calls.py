"""Call operators on small tables with known answers."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from conftest import tuples
from locusframe.operators import calls as C
from locusframe.operators import coverage as V
from locusframe.plans.markers import marker_set

SCHEMA = "chrom string, pos bigint, ref string, alt string, sample_id string, gt string"


def calls_of(spark, sites):
    rows = [
        (ch, p, r, a, f"S{i + 1}", g) for ch, p, r, a, gts in sites for i, g in enumerate(gts.split())
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_site_stats(spark):
    c = calls_of(
        spark,
        [
            ("chr1", 100, "A", "T", "0/0 0/1 0/1 1/1 0/0"), ("chr1", 200, "G", "C", "0/1 0/1 1/1 1/1 ./."),
            ("chr2", 150, "T", "A,G", "0/0 0/1 1/2 0/0 0/0"), ("chr3", 9, "T", "A", "0/. 1/1 1/1 ./. ./."),
        ],
    )
    s = C.filter_sites(C.site_stats(c))
    got = [tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in tuples(s, "chrom", "pos", "missing", "het", "maf")]
    assert got == [("chr1", 100, 0.0, 0.4, 0.4), ("chr1", 200, 0.2, 0.5, 0.25), ("chr3", 9, 0.4, 0.0, 0.2)]
    strict = C.site_stats(c, strict=True).filter("pos = 9").first()
    assert (strict.missing, strict.maf) == (pytest.approx(0.6), 0.0)


@pytest.fixture(scope="module")
def random_calls(spark):
    rng = random.Random(5)
    gts = ["0/0", "0/1", "1/1", "./.", "1/2", "2/2"]
    rows = [
        ("c1", p, "A", "G", f"S{i}", rng.choice(gts))
        for p in rng.sample(range(1, 3000), 120) for i in range(6) if rng.random() < 0.9
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_all_pairs_equal_listed_pairs(random_calls):
    listed = C.compare_samples(random_calls, C.sample_pairs(random_calls))
    every = C.compare_all_samples(random_calls, width=200)
    assert tuples(listed, *listed.columns) == tuples(every, *listed.columns)
    assert every.count() == 15


def test_mendel(spark):
    gts = ["0/0", "0/1", "1/1", "./."]
    sites = [("c", i + 1, "A", "G", " ".join(t)) for i, t in enumerate(itertools.product(gts, repeat=3))]
    ped = spark.createDataFrame([("S1", "S2", "S3")], "father string, mother string, child string")
    r = C.mendel_summary(calls_of(spark, sites), ped).first()
    assert (r.total, r.missing, r.consistent, r.inconsistent) == (64, 37, 15, 12)
    assert r.rate == pytest.approx(15 / 27)


def test_recovery_counts(spark):
    c = calls_of(spark, [("c", i + 1, "A", "G", g) for i, g in enumerate(["0/0 0/0", "0/0 0/1", "1/1 0/0", "0/1 0/0", "1/1 ./.", "0/0 1|0"])])
    pairs = spark.createDataFrame([("S1", "S2")], "sample_a string, sample_b string")
    r = C.recovery_rate(c, pairs).first()
    assert (r.total, r.a_sites, r.b_sites, r.h_sites, r.n_sites) == (5, 1, 1, 2, 1)
    assert r.bc_rate == pytest.approx((1 + 0.5 * 2) / 4)


def test_evenness(spark):
    rows = [("a", 1, "S1", 10), ("a", 2, "S1", 20), ("a", 3, "S1", 1), ("a", 1, "S2", 0), ("a", 2, "S2", 0)]
    d = spark.createDataFrame(rows, "chrom string, pos bigint, sample_id string, depth int")
    # S1: limit 0.2 * 31 / 3; S2 is all zero and passes where it has a row
    assert tuples(V.evenness(d), "pos", "pass_share") == [(1, 1.0), (2, 1.0), (3, 0.0)]


def test_window_edges(spark):
    d = spark.createDataFrame([("a", 0, 0, 50), ("a", 9, 11, 50), ("a", 10, 12, 5)], "chrom string, start bigint, end bigint, depth int")
    # midpoint 0 lies outside the right-closed windows
    assert tuples(V.window_coverage(d, 10), "win_start", "win_end", "coverage", "miss") == [(0, 10, 1.0, 0), (10, 20, 0.0, 1)]


def greedy(grid):
    """Brute force over whole sample vectors."""
    samples = range(len(next(iter(grid.values()))))
    parts, out = {s: "" for s in samples}, []
    apart = lambda g: sum(g[a] != g[b] for a, b in itertools.combinations(samples, 2))
    while True:
        now = apart(parts)
        best = min(grid, key=lambda k: (-apart({s: parts[s] + grid[k][s] for s in samples}), k))
        gain = apart({s: parts[s] + grid[best][s] for s in samples}) - now
        if gain == 0:
            return out
        out.append((len(out) + 1, best, gain))
        parts = {s: parts[s] + grid[best][s] for s in samples}


def test_marker_set(spark):
    rng = random.Random(6)
    rows, grid = [], {}
    for p in range(10, 22):
        gts = [rng.choice(["0/0", "0/0", "0/1", "1/1", "./.", None]) for _ in range(7)]
        seen = [g for g in gts if g and g != "./."]
        if not seen:
            continue
        common = min(set(seen), key=lambda g: (-seen.count(g), g))
        grid[f"c_{p}"] = [g if g and g != "./." else common for g in gts]
        rows += [("c", p, "A", "G", f"S{i}", g) for i, g in enumerate(gts) if g]
    got = marker_set(spark.createDataFrame(rows, SCHEMA))
    assert tuples(got, "step", "id", "gain") == greedy(grid)
