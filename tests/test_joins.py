"""Lookup join: both ways give the plain join; no exchange is keyed by the lookup key alone."""

import contextlib
import io

import pytest
from conftest import tuples

from locusframe.operators import calls
from locusframe.operators.joins import lookup_join


@pytest.mark.parametrize("most", [10, 2])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_both_ways(spark, most, how):
    big = spark.createDataFrame([(k % 4 if k % 5 else None, k) for k in range(60)], "s int, v int")
    small = spark.createDataFrame([(0, "a"), (1, "b"), (1, "c")], "s int, w string")
    key = lambda rows: sorted(rows, key=str)
    assert key(tuples_of(lookup_join(big, small, "s", how, ["v"], most))) == key(tuples_of(big.join(small, "s", how)))


def tuples_of(df):
    return [tuple(r) for r in df.select("s", "v", "w").collect()]


def test_no_exchange_by_sample(spark):
    rows = [("c", k, "A", "G", f"S{j}", "0/1") for k in range(5) for j in range(3)]
    c = spark.createDataFrame(rows, "chrom string, pos long, ref string, alt string, sample_id string, gt string")
    pairs = spark.createDataFrame([("S0", "S1")], "sample_a string, sample_b string")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            calls.family_calls(c, pairs, calls.PAIR).explain()
        assert "hashpartitioning(sample_id" not in out.getvalue()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_line_stats_are_site_stats(spark):
    gts = ["0/0", "0/1", "./.", "0/.", "1/1", "1/2", "."]
    lines = spark.createDataFrame([("c", k, "A", "G", gts[k:]) for k in range(len(gts))], "chrom string, pos long, ref string, alt string, gts array<string>")
    long = lines.selectExpr("chrom", "pos", "ref", "alt", "explode(gts) as gt")
    cols = ("pos", "n", "missing", "het", "maf")
    for strict in (False, True):
        assert tuples(calls.line_stats(lines, strict), *cols) == tuples(calls.site_stats(long, strict), *cols)
