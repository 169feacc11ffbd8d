"""Runs, clusters and thinning along a chromosome."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import BIN_WIDTH, assign_runs


def threshold_regions(
    df: DataFrame, threshold: float, min_snps: int = 5, min_length: int = 100_000,
    max_gap: int = 500_000, use_abs: bool = True, stat: str = "stat", pos: str = "pos",
    width: int = BIN_WIDTH,
) -> DataFrame:
    """Runs of consecutive points at or above the threshold.

    A run ends at a point below it or at a gap above ``max_gap``.
    """
    value = F.abs(stat) if use_abs else F.col(stat)
    flagged = df.select("chrom", pos, (value >= threshold).alias("hit"))

    def opens(cur, prev):
        cut = prev("hit").isNull() | ~prev("hit") | (cur(pos) - prev(pos) > max_gap)
        return cur("hit") & cut

    runs = assign_runs(flagged, ["chrom"], pos, opens, ["hit"], width)
    out = runs.filter("hit").groupBy("chrom", "run_start").agg(
        F.max(pos).alias("end"), F.count("*").alias("no_snps")
    )
    out = out.select(
        "chrom", F.col("run_start").alias("start"), "end",
        (F.col("end") - F.col("run_start") + 1).alias("length"), "no_snps",
    )
    return out.filter((F.col("no_snps") >= min_snps) & (F.col("length") >= min_length))


def filter_clusters(
    df: DataFrame, window: int = 120, k: int = 4, pos: str = "pos", width: int = BIN_WIDTH
) -> DataFrame:
    """Drop every row in some ``k`` consecutive rows spanning at most ``window``.

    Rows near a bin border are copied into the next bin; a cluster reaches at
    most ``window`` from its members, so each bin decides its own rows alone.
    The streaming form of the filter is ``k = snp_count + 1``.
    """
    width = max(width, window + 1)
    own = F.floor(F.col(pos) / width)
    near = F.array_distinct(
        F.array(own, F.floor((F.col(pos) - window) / width), F.floor((F.col(pos) + window) / width))
    )
    x = df.withColumn("_own", own).withColumn("_b", F.explode(near))
    w = Window.partitionBy("chrom", "_b").orderBy(pos)
    last = (F.col(pos) - F.lag(pos, k - 1).over(w)) <= window if k > 1 else F.lit(True)
    x = x.withColumn("_last", F.coalesce(last, F.lit(False)))
    hit = F.max("_last").over(w.rowsBetween(0, k - 1))
    return x.withColumn("_hit", hit).filter((F.col("_own") == F.col("_b")) & ~F.col("_hit")).drop(
        "_own", "_b", "_last", "_hit"
    )


def thin_by_distance(
    df: DataFrame, distance: int, score: str, key: str = "id", pos: str = "pos",
    keys: list[str] = ["chrom"], width: int = BIN_WIDTH,
) -> DataFrame:
    """Chain rows closer than ``distance`` and keep the best score per chain
    (ties: the smaller ``key``)."""
    cols = df.columns
    runs = assign_runs(
        df, keys, pos,
        lambda cur, prev: prev(pos).isNull() | (cur(pos) - prev(pos) >= distance), [], width,
    )
    best = runs.groupBy(*keys, "run_start").agg(
        F.min_by(F.struct(*cols), F.struct(-F.col(score), F.col(key))).alias("_b")
    )
    return best.select("_b.*")


def origin_segments(track: DataFrame, by: list[str], width: int = BIN_WIDTH) -> DataFrame:
    """Consecutive sites of one origin as segments."""
    keys = [*by, "chrom"]
    runs = assign_runs(
        track, keys, "pos",
        lambda cur, prev: prev("origin").isNull() | (cur("origin") != prev("origin")), ["origin"], width,
    )
    return runs.groupBy(*keys, "run_start", "origin").agg(
        F.max("pos").alias("end"), F.count("*").alias("n_sites")
    ).withColumnRenamed("run_start", "start")
