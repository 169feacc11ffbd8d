"""Runs, clusters and intervals against brute force.

Every random case is a chromosome of one table, and the bins are far narrower
than the data, so that state must cross many bin borders.
"""

import random

import pytest
from pyspark.sql import functions as F

from conftest import tuples
from locusframe.operators import intervals as I
from locusframe.operators import runs as R
from locusframe.operators import tracks as K
from locusframe.operators.enrich import bh_adjust

CASES = 25


def positions(rng, n=60, top=600):
    return sorted(rng.sample(range(1, top), n))


@pytest.fixture(scope="module")
def sites():
    rng = random.Random(1)
    return {f"c{i}": [(p, rng.randint(0, 9)) for p in positions(rng)] for i in range(CASES)}


@pytest.fixture(scope="module")
def site_df(spark, sites):
    return spark.createDataFrame(
        [(k, p, float(s), f"{k}_{p}") for k, ps in sites.items() for p, s in ps], "chrom string, pos bigint, stat double, id string"
    )


@pytest.mark.parametrize("width", [7, 50, 10_000])
def test_threshold_regions(site_df, sites, width):
    t, gap, least, length = 4, 25, 2, 3
    want = []
    for chrom, ps in sites.items():
        run = []
        for p, s in ps + [(None, -1)]:
            if run and (s < t or p - run[-1] > gap):
                if len(run) >= least and run[-1] - run[0] + 1 >= length:
                    want.append((chrom, run[0], run[-1], run[-1] - run[0] + 1, len(run)))
                run = []
            if s >= t:
                run.append(p)
    got = R.threshold_regions(site_df, t, least, length, gap, width=width)
    assert tuples(got, "chrom", "start", "end", "length", "no_snps") == sorted(want)


@pytest.mark.parametrize("k,window", [(2, 3), (3, 12), (4, 25), (2, 0)])
def test_filter_clusters(site_df, sites, k, window):
    want = []
    for chrom, ps in sites.items():
        pos = [p for p, _ in ps]
        bad = set()
        for i in range(len(pos) - k + 1):
            if pos[i + k - 1] - pos[i] <= window:
                bad.update(pos[i : i + k])
        want += [(chrom, p) for p in pos if p not in bad]
    assert tuples(R.filter_clusters(site_df, window, k, width=30), "chrom", "pos") == sorted(want)


def test_filter_clusters_given_cases(spark):
    rows = [("a", p) for p in (10, 30, 60)] + [("b", p) for p in (100, 105, 110, 200)]
    df = spark.createDataFrame(rows, "chrom string, pos bigint")
    assert tuples(R.filter_clusters(df, 10, 2 + 1), "chrom", "pos") == [("a", 10), ("a", 30), ("a", 60), ("b", 200)]
    edge = spark.createDataFrame([("a", p) for p in (100, 110, 120)], "chrom string, pos bigint")
    assert tuples(R.filter_clusters(edge, 10, 1 + 1), "pos") == []


@pytest.mark.parametrize("width", [11, 10_000])
def test_thin_by_distance(site_df, sites, width):
    want = []
    for chrom, ps in sites.items():
        chain = []
        for p, s in ps + [(10**9, 0)]:
            if chain and p - chain[-1][0] >= 12:
                want.append((chrom, min(chain, key=lambda x: (-x[1], f"{chrom}_{x[0]}"))[0]))
                chain = []
            chain.append((p, s))
    assert tuples(R.thin_by_distance(site_df, 12, "stat", width=width), "chrom", "pos") == sorted(want)


def test_origin_segments(site_df, sites):
    df = site_df.withColumn("origin", F.when(F.col("stat") < 5, "p1").otherwise("p2")).withColumn("child", F.lit("k"))
    want = []
    for chrom, ps in sites.items():
        seg = []
        for p, s in ps:
            o = "p1" if s < 5 else "p2"
            if seg and seg[-1][2] == o:
                seg[-1][1], seg[-1][3] = p, seg[-1][3] + 1
            else:
                seg.append([p, p, o, 1])
        want += [(chrom, *x) for x in seg]
    got = R.origin_segments(df, ["child"], width=13)
    assert tuples(got, "chrom", "start", "end", "origin", "n_sites") == sorted(want)


@pytest.fixture(scope="module")
def intervals():
    rng = random.Random(2)
    out = []
    for i in range(CASES):
        for j in range(40):
            s = rng.randint(0, 500)
            out.append((f"c{i}", s, s + rng.choice([1, 5, 30, 30, 200]), f"c{i}i{j}"))
    return out


@pytest.fixture(scope="module")
def interval_df(spark, intervals):
    return spark.createDataFrame(intervals, "chrom string, start bigint, end bigint, id string")


def by_chrom(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("width", [9, 100, 10_000])
def test_merge_intervals(interval_df, intervals, width):
    want = []
    for chrom, rows in by_chrom(intervals).items():
        block = None
        for _, s, e, _ in sorted(rows, key=lambda r: r[1:3]):
            if block and s <= block[1]:
                block[1] = max(block[1], e)
            else:
                block = [s, e]
                want.append((chrom, block))
    want = sorted((k, b[0], b[1]) for k, b in want)
    got = I.merge_intervals(interval_df, width=width)
    assert tuples(got, "chrom", "start", "end") == want
    assert tuples(I.merge_intervals(got, width=width), "chrom", "start", "end") == want


def test_segment_overlaps(interval_df, intervals):
    want = []
    for chrom, rows in by_chrom(intervals).items():
        cuts = sorted({x for r in rows for x in r[1:3]})
        for s, e in zip(cuts, cuts[1:]):
            ids = sorted(r[3] for r in rows if r[1] < e and s < r[2])
            if ids:
                want.append((chrom, s, e, ",".join(ids)))
    got = I.segment_overlaps(interval_df, "id", width=17, range_width=20)
    assert tuples(got, "chrom", "start", "end", "labels") == sorted(want)


@pytest.mark.parametrize("width", [3, 10, 10_000])
def test_overlaps_and_counts(interval_df, intervals, width):
    pairs, counts = [], []
    for rows in by_chrom(intervals).values():
        for a in rows:
            hit = [b[3] for b in rows if a[1] <= b[2] and b[1] <= a[2]]
            pairs += [(a[3], b) for b in hit]
            counts.append((a[3], len(hit)))
    assert tuples(I.overlap_join(interval_df, interval_df, width), "id_a", "id_b") == sorted(pairs)
    assert tuples(I.count_overlaps(interval_df, interval_df, width=width), "id", "n") == sorted(counts)


def test_points_in_regions(site_df, interval_df, sites, intervals):
    want = sorted(
        (p, r[3]) for r in intervals for p, _ in sites.get(r[0], []) if r[1] <= p <= r[2]
    )
    assert tuples(I.points_in_regions(site_df.drop("id"), interval_df, 16), "pos", "id") == want
    inside = {(r[0], p) for r in intervals for p, _ in sites[r[0]] if r[1] <= p <= r[2]}
    # bins of 3 make the longer regions go by the coarse tier
    for width in (3, 16):
        semi = I.points_in_regions(site_df, interval_df.drop("id"), width, how="left_semi")
        assert tuples(semi, "chrom", "pos") == sorted(inside)
        assert tuples(I.points_in_regions(site_df.drop("id"), interval_df, width), "pos", "id") == want


def test_subtract_overlapping(spark, interval_df, intervals):
    genes = [(c, s + 11, s + 13) for c, s, _, i in intervals if i.endswith("7")] + [("c3", 0, 2000)]
    df = spark.createDataFrame(genes, "chrom string, start bigint, end bigint")
    want = sorted((r[3],) for r in intervals if not any(g[0] == r[0] and r[1] < g[2] and g[1] < r[2] for g in genes))
    for width in (3, 50):
        assert tuples(I.subtract_overlapping(interval_df, df, "id", width), "id") == want


def test_split_then_restore(spark, interval_df):
    pieces = spark.createDataFrame(
        [(f"c{i}", s, e, f"c{i}{t}") for i in range(CASES) for s, e, t in ((0, 300, "a"), (300, 900, "b"))],
        "chrom string, start bigint, end bigint, part string",
    )
    back = I.restore_coords(I.split_coords(interval_df, pieces), pieces)
    whole = interval_df.filter("start < 900")  # what crosses a border goes with its start
    cols = ("chrom", "start", "end", "id")
    assert tuples(back, *cols) == tuples(whole, *cols)


def test_restore_given_case(spark):
    bed = spark.createDataFrame([("split1", 100, 200), ("split2", 0, 50)], "chrom string, start bigint, end bigint")
    m = spark.createDataFrame([("chr1", 0, 500, "split1"), ("chr1", 500, 1000, "split2")], "chrom string, start bigint, end bigint, part string")
    assert tuples(I.restore_coords(bed, m), "chrom", "start", "end") == [("chr1", 100, 200), ("chr1", 500, 550)]


def test_split_bed_is_balanced(interval_df, intervals):
    total = sum(e - s for _, s, e, _ in intervals)
    parts = {r[0]: r[1] for r in I.split_bed(interval_df, 5, width=40).groupBy("part").agg(F.sum(F.col("end") - F.col("start"))).collect()}
    assert set(parts) == set(range(5))
    assert all(abs(x - total / 5) <= 400 for x in parts.values())


def test_bh_adjust(spark):
    rng = random.Random(3)
    rows = [(f"k{i}", j, rng.choice([0.0, 1.0, 0.5, rng.random(), rng.random() ** 9])) for i in range(8) for j in range(50)]
    got = bh_adjust(spark.createDataFrame(rows, "k string, j int, p double"), "p", ["k"])
    want = {}
    for k in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: r[2], reverse=True)
        low = 1.0
        for i, r in enumerate(mine):
            low = min(low, r[2] * len(mine) / (len(mine) - i))
            want[(k, r[1])] = low
    # equal p-values share the value of the last of them
    for r in got.collect():
        same = [want[(r.k, x[1])] for x in rows if x[0] == r.k and x[2] == r.p]
        assert r.p_adjust == pytest.approx(min(same))


@pytest.mark.parametrize("q", [0.0, 0.3, 0.95, 1.0])
def test_quantile_nearest(spark, q):
    rng = random.Random(4)
    xs = [rng.choice([0.0, -3.5, rng.gauss(0, 1), rng.expovariate(0.01)]) for _ in range(301)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = spark.range(1).select(K.quantile_nearest(df, "x", q).alias("v")).first().v
    assert got == sorted(xs)[int(q * 300 + 0.5)]
