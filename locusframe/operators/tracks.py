"""Trait-mapping statistic tracks: thresholds, candidates, evidence labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import magnitude_bin
from .intervals import RANGE_BIN, points_in_regions
from .ordered import BIN, running

# Z factor of each confidence level.
CI_FACTORS = {"CI_95": 1.96, "CI_99": 2.58}


def filter_outside_band(df: DataFrame, x: str, ci: str) -> DataFrame:
    return df.filter(F.abs(x) > F.abs(ci))


def above_ci(
    df: DataFrame, stat: str, ci: str = "CI_95", keys: list[str] = ["chrom", "pos"]
) -> DataFrame:
    """Rows at or above mean + z sd, the moments taken over distinct positions."""
    one = df.groupBy(*keys).agg(F.max(stat).alias("_s"))
    limit = one.agg(F.avg("_s") + CI_FACTORS[ci] * F.stddev_samp("_s")).scalar()
    return df.filter(F.col(stat) >= limit)


def quantile_nearest(df: DataFrame, value: str, q: float) -> Column:
    """Exact quantile (nearest rank of ``q * (n - 1)``) as a scalar subquery.

    Equal values are counted first, then ranked through ordered bins, so no
    task sorts the whole column.
    """
    x = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_n"))
    total = x.agg(F.sum("_n")).scalar()
    binned = x.withColumn(BIN, magnitude_bin(F.col(value)))
    ranked = running(binned, [], value, {"_upto": ("sum", F.col("_n"))})
    rank = F.floor(q * (total - 1) + 0.5) + 1
    return ranked.filter(F.col("_upto") >= rank).agg(F.min(value)).scalar()


def above_quantile(
    windows: DataFrame, points: DataFrame, count: str, q: float, width: int = RANGE_BIN
) -> DataFrame:
    """Points inside the windows whose count exceeds the quantile."""
    high = windows.filter(F.col(count) > quantile_nearest(windows, count, q))
    regions = high.select("chrom", "start", "end")
    # windows of one size: short of the coarse tier when the bin fits them
    return points_in_regions(points, regions, width).drop("start", "end")


def label_sites(tracks: dict[str, DataFrame]) -> DataFrame:
    """Methods that support each site, sorted and joined by ``", "``."""
    parts = [
        df.select("chrom", "pos", F.lit(name).alias("label")) for name, df in tracks.items()
    ]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    labels = F.array_join(F.array_sort(F.collect_set("label")), ", ")
    return union.groupBy("chrom", "pos").agg(labels.alias("label"))


def filter_any_p(df: DataFrame, p: float, cols: list[str] = ["p_wald", "p_lrt", "p_score"]) -> DataFrame:
    keep = F.lit(False)
    for c in cols:
        keep = keep | (F.col(c) <= p)
    return df.filter(keep).distinct()


def explained_variance(eigen: DataFrame, by: list[str] = [], value: str = "eigenvalue") -> DataFrame:
    """Variance share of each component."""
    total = eigen.groupBy(*by).agg(F.sum(value).alias("_t"))
    out = eigen.join(total, by) if by else eigen.withColumn("_t", total.scalar())
    return out.withColumn("share", F.try_divide(F.col(value), F.col("_t"))).drop("_t")


def assign_group(q: DataFrame, by: str = "sample_id") -> DataFrame:
    """Best population per sample from long ``(sample, population, share)`` rows."""
    best = F.max_by(F.struct("population", "share"), F.struct("share", "population"))
    return q.groupBy(by).agg(best.alias("_b")).select(by, "_b.population", "_b.share")


def best_k(log: DataFrame, value: str, smallest: bool = False) -> DataFrame:
    """K of the largest likelihood, or of the smallest CV error."""
    key = F.struct(F.col(value) if smallest else -F.col(value), F.col("k"))
    return log.agg(F.min_by("k", key).alias("k"), (F.min if smallest else F.max)(value).alias(value))
