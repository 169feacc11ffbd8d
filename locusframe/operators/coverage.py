"""Coverage operators over long depth rows ``(region…, sample_id, depth)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_name
from ..plans.session import cut_lineage
from .calls import count_if, ratio
from .joins import lookup_join

CUTOFFS = [1, 5, 10, 20, 30, 50, 100]


def _breadth(cutoffs: list[int]) -> list[Column]:
    return [
        F.avg((F.col("depth") >= c).cast("double")).alias(f"coverage_{c}x") for c in cutoffs
    ]


def region_coverage(depth: DataFrame, keys: list[str], cutoffs: list[int] = CUTOFFS) -> DataFrame:
    """Depth extremes, mean, median and breadth per region over its samples."""
    return depth.groupBy(*keys).agg(
        F.min("depth").alias("min_cov"), F.max("depth").alias("max_cov"),
        F.avg("depth").alias("mean_cov"), F.percentile("depth", F.lit(0.5)).alias("median_cov"),
        *_breadth(cutoffs),
    )


def per_base(depth: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Summed region depth to depth per base."""
    return depth.withColumn("depth", F.try_divide(F.col("depth"), F.col(end) - F.col(start)))


def sample_coverage(depth: DataFrame, cutoffs: list[int] = CUTOFFS) -> DataFrame:
    """Mean depth, breadth and missing sites per sample."""
    hit = count_if(F.col("depth") > 0)
    return depth.groupBy("sample_id").agg(
        F.avg("depth").alias("mean_coverage"), *_breadth(cutoffs),
        F.count("*").alias("total_count"),
        (F.count("*") - hit).alias("missing_count"),
        ratio(hit, F.count("*")).alias("detected"),
        ratio(F.count("*") - hit, F.count("*")).alias("missing"),
    )


def _window_end(pos: Column, width: int) -> Column:
    """Right edge of the right-closed window holding a 1-based position."""
    return (F.ceil(pos / width) * width).cast("bigint")


def window_coverage(
    df: DataFrame, width: int, min_reads: int = 10, cutoff: float = 0.5, by: list[str] = []
) -> DataFrame:
    """Share of covered regions per window ``(start, end]``, miss below cutoff."""
    pos = F.floor((F.col("start") + F.col("end")) / 2)
    end = _window_end(pos, width)
    c = df.filter(pos >= 1).groupBy(
        *by, "chrom", (end - width).alias("win_start"), end.alias("win_end")
    ).agg(F.avg((F.col("depth") >= min_reads).cast("double")).alias("coverage"))
    return c.withColumn("miss", (F.col("coverage") < cutoff).cast("int"))


def miss_percent(windows: DataFrame, by: list[str] = []) -> DataFrame:
    return windows.groupBy(*by).agg(
        F.round(100 * F.avg(F.col("miss").cast("double")), 1).alias("miss_percent")
    )


def panel_window_coverage(
    depth: DataFrame, width: int, min_reads: int = 10, sample_cutoff: float = 0.5,
    cutoff: float = 0.5,
) -> DataFrame:
    """Per-sample window shares over the regions that enough samples cover."""
    region = ["chrom", "start", "end"]
    passed = (
        depth.groupBy(*region)
        .agg(F.avg((F.col("depth") >= min_reads).cast("double")).alias("share"))
        .filter(F.col("share") >= sample_cutoff)
        .select(*region)
    )
    return window_coverage(
        depth.join(passed, region, "left_semi"), width, min_reads, cutoff, ["sample_id"]
    )


def evenness(depth: DataFrame, share: float = 0.2, keys: list[str] = ["chrom", "pos"]) -> DataFrame:
    """Share of samples at or above ``share`` of their own mean, per position.

    A sample without a row at a position fails there.  The means are one row per
    sample, stored and looked up, so no sample is pulled into one task.
    """
    means = cut_lineage(depth.groupBy("sample_id").agg((F.avg("depth") * share).alias("_limit")))
    n = means.agg(F.count("*").alias("n")).scalar()
    hit = count_if(F.col("depth") >= F.col("_limit"))
    return lookup_join(depth, means, "sample_id", spread=keys).groupBy(*keys).agg(hit.alias("n_pass")).select(
        *keys, "n_pass", (F.col("n_pass") / n).alias("pass_share")
    )


def sample_thresholds(depth: DataFrame, share: float = 0.2) -> DataFrame:
    return depth.groupBy("sample_id").agg((F.avg("depth") * share).alias("threshold"))


def all_positions(depth: DataFrame) -> DataFrame:
    return depth.select("chrom", "pos").distinct()


def matrix(depth: DataFrame, keys: list[str], samples: list[str]) -> DataFrame:
    """Wide region x sample table; one aggregate instead of a join per sample."""
    cols = [
        F.max(F.when(F.col("sample_id") == s, F.col("depth"))).alias(s) for s in samples
    ]
    return depth.groupBy(*keys).agg(*cols)


def probe_density(reads: DataFrame, probes: DataFrame) -> DataFrame:
    """Reads per base of each probe and sample."""
    length = F.col("end") - F.col("start")
    return reads.join(probes.select("id", "start", "end"), "id").select(
        "id", "sample_id", F.try_divide(F.col("reads"), length).alias("density")
    )


def probe_counts(r1: DataFrame, r2: DataFrame, probes: DataFrame) -> DataFrame:
    """Distinct read pairs per probe, zero kept; reads are named ``prefix/side``."""
    both = r1.select("read_name", "id").unionByName(r2.select("read_name", "id"))
    pair = F.split_part("read_name", F.lit("/"), F.lit(1))
    n = both.groupBy("id").agg(F.countDistinct(pair).alias("n"))
    return probes.select("id").join(n, "id", "left").fillna(0, ["n"])


def grid_counts(grid: DataFrame, counts: DataFrame, name: str = "n") -> DataFrame:
    """Window grid with its counts, empty windows 0."""
    return grid.join(counts, ["chrom", "start", "end"], "left").fillna(0, [name])


def window_counts(sites: DataFrame, width: int) -> DataFrame:
    """Sites per right-closed window."""
    end = _window_end(F.col("pos"), width)
    return sites.filter(F.col("pos") >= 1).groupBy(
        "chrom", (end - width).alias("start"), end.alias("end")
    ).agg(F.count("*").alias("n"))


def filter_covered(df: DataFrame, sizes: DataFrame, cutoff: float) -> DataFrame:
    """Regions whose summed depth reaches ``cutoff`` per base, known chromosomes."""
    return df.filter(
        F.col("depth") >= cutoff * (F.col("end") - F.col("start"))
    ).join(sizes.select("chrom"), "chrom", "left_semi")


def capture_efficiency(
    target: DataFrame, mapping: DataFrame, sample_map: DataFrame, cutoffs: list[int] = [1, 5, 10]
) -> DataFrame:
    """Target bases over mapped bases joined to breadth and library names."""
    cov = target.groupBy(F.col("sample_id").alias("name")).agg(
        F.sum("depth").alias("target_bases"), *_breadth(cutoffs)
    )
    names = sample_map.select("lib_id", clean_name(F.col("name")).alias("name")).distinct()
    return (
        mapping.join(cov, "name")
        .withColumn("efficiency", F.try_divide(F.col("target_bases"), F.col("mapped_bases")))
        .join(names, "name")
    )


def panel_size(bed: DataFrame) -> DataFrame:
    return bed.agg(F.sum(F.col("end") - F.col("start")).alias("panel_bases"))


def panel_depth(bed: DataFrame, mapped: DataFrame) -> DataFrame:
    """Mean depth of each sample: mapped target bases over the panel size."""
    size = panel_size(bed).scalar()
    return mapped.withColumn("mean_depth", F.try_divide(F.col("mapped_bases"), size))


def probes_by_chrom(bed: DataFrame, sizes: DataFrame) -> DataFrame:
    """Probe count and length in Mb per chromosome, zero kept."""
    n = bed.groupBy("chrom").agg(F.count("*").alias("probes"))
    return sizes.join(n, "chrom", "left").fillna(0, ["probes"]).select(
        "chrom", (F.col("size") / 1e6).alias("length_mb"), "probes"
    )
