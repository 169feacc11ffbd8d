"""Greedy marker set: few SNPs that tell all samples apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import genotype as G
from ..functions.variant import site_id
from .session import cut_lineage


def _coded(calls: DataFrame) -> DataFrame:
    """Biallelic SNP calls as 0/1/2 with the site's most common code ``mc``."""
    snp = calls.filter((F.length("ref") == 1) & (F.length("alt") == 1))
    x = snp.select(site_id(F.col("chrom"), F.col("pos")).alias("id"), "sample_id", G.gt_code(F.col("gt")).alias("code"))
    x = x.filter(F.col("code") < 3)
    n = [F.count_if(F.col("code") == k).alias(f"n{k}") for k in range(3)]
    counts = x.groupBy("id").agg(*n)
    best = F.greatest("n0", "n1", "n2")
    mc = F.when(F.col("n0") == best, 0).when(F.col("n1") == best, 1).otherwise(2)
    return x.join(counts.select("id", mc.alias("mc")), "id")


def marker_set(calls: DataFrame, max_markers: int | None = None) -> DataFrame:
    """``step, id, gain`` of the chosen markers.

    ``gain`` is the number of sample pairs a marker newly separates; a sample
    without a call carries the site's most common code.  Each round is one
    aggregate over the calls; only the winning site reaches the driver, and the
    group table (one row per sample) is checkpointed.  There are fewer rounds
    than samples, as every marker splits a group.
    """
    spark = calls.sparkSession
    coded = cut_lineage(_coded(calls))
    groups = calls.select("sample_id").distinct().withColumn("grp", F.lit(""))
    groups = cut_lineage(groups)
    chosen: list[tuple[int, str, int]] = []
    pairs = lambda n: n * (n - 1) / 2
    while max_markers is None or len(chosen) < max_markers:
        sizes = groups.groupBy("grp").agg(F.count("*").alias("size"))
        c = coded.join(groups, "sample_id").groupBy("id", "mc", "grp").agg(
            F.count("*").alias("seen"), *[F.count_if(F.col("code") == k).alias(f"c{k}") for k in range(3)]
        ).join(sizes, "grp")
        same = F.lit(0.0)
        for k in range(3):
            extra = F.when(F.col("mc") == k, F.col("size") - F.col("seen")).otherwise(0)
            same = same + pairs(F.col(f"c{k}") + extra)
        gain = F.sum(pairs(F.col("size")) - same).cast("bigint")
        best = c.groupBy("id", "mc").agg(gain.alias("gain")).orderBy(F.desc("gain"), "id").first()
        if best is None or best["gain"] == 0:
            break
        chosen.append((len(chosen) + 1, best["id"], best["gain"]))
        code = coded.filter(F.col("id") == best["id"]).select("sample_id", "code")
        groups = cut_lineage(
            groups.join(code, "sample_id", "left").select(
                "sample_id", F.concat("grp", F.coalesce("code", F.lit(best["mc"])).cast("string")).alias("grp")
            )
        )
    return spark.createDataFrame(chosen, "step int, id string, gain bigint")
