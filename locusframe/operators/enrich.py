"""Gene-set enrichment, multiple testing and expression tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import hypergeom_log_sf, magnitude_bin
from .ordered import BIN, running


def bh_adjust(df: DataFrame, p: str, keys: list[str] = [], name: str = "p_adjust") -> DataFrame:
    """Benjamini-Hochberg adjusted p per key group.

    Equal p-values share one adjusted value, so the ranking works on distinct
    values with counts, in ordered bins; ties never pile up in one task.
    """
    n = df.groupBy(*keys, p).agg(F.count("*").alias("_n"))
    total = n.groupBy(*keys).agg(F.sum("_n").alias("_m"))
    ranked = running(
        n.withColumn(BIN, magnitude_bin(F.col(p))), keys, p, {"_rank": ("sum", F.col("_n"))}
    )
    ranked = ranked.join(total, keys) if keys else ranked.withColumn("_m", total.scalar())
    raw = F.col(p) * F.col("_m") / F.col("_rank")
    adj = running(ranked, keys, p, {name: ("min", raw)}, descending=True)
    adj = adj.select(*keys, p, F.least(F.lit(1.0), F.col(name)).alias(name))
    return df.join(adj, [*keys, p])


def _bh_small(df: DataFrame, p: str, keys: list[str], name: str) -> DataFrame:
    """The same adjustment for groups of bounded size, by plain windows."""
    w = Window.partitionBy(*keys)
    rank = F.count("*").over(w.orderBy(p).rangeBetween(Window.unboundedPreceding, 0))
    raw = F.col(p) * F.count("*").over(w) / F.col("_rank")
    tail = w.orderBy(p).rangeBetween(0, Window.unboundedFollowing)
    return (
        df.withColumn("_rank", rank).withColumn("_raw", raw)
        .withColumn(name, F.least(F.lit(1.0), F.min("_raw").over(tail))).drop("_rank", "_raw")
    )


def enrich(gene_term: DataFrame, picked: DataFrame, by: list[str] = []) -> DataFrame:
    """Over-representation of each term among the picked genes of each list.

    ``gene_term`` is ``gene, term``; ``picked`` is ``gene`` plus the list keys
    ``by``, so all lists are tested in one job.  ``neglog10_p`` holds where ``pvalue`` is
    below the smallest double.
    """
    gt = gene_term.select("gene", "term").distinct()
    bg_total = gene_term.agg(F.countDistinct("gene")).scalar()
    bg = gt.groupBy("term").agg(F.count("*").alias("bg_count"))
    hit = gt.join(picked.select(*by, "gene").distinct(), "gene")
    totals = hit.groupBy(*by).agg(F.countDistinct("gene").alias("pick_total"))
    c = hit.groupBy(*by, "term").agg(
        F.count("*").alias("pick_count"),
        F.array_join(F.array_sort(F.collect_list("gene")), "/").alias("genes"),
    ).join(bg, "term")
    c = c.join(totals, by) if by else c.withColumn("pick_total", totals.scalar())
    c = c.withColumn("bg_total", bg_total)
    log_p = hypergeom_log_sf(*[F.col(x) for x in ("pick_count", "bg_total", "pick_total", "bg_count")])
    c = c.withColumns(
        {
            "pvalue": F.exp(log_p),
            "neglog10_p": -log_p / math.log(10),
            "gene_ratio": F.concat_ws("|", "pick_count", "pick_total"),
            "bg_ratio": F.concat_ws("|", "bg_count", "bg_total"),
        }
    )
    # a list has at most one row per term of the ontology
    return _bh_small(c, "pvalue", by, "p_adjust")


def name_terms(result: DataFrame, names: DataFrame) -> DataFrame:
    """Attach term names and categories; unnamed terms are dropped."""
    return result.join(names, "term")


def translate_genes(picked: DataFrame, id_map: DataFrame, by: list[str] = []) -> DataFrame:
    """Picked ``gene`` ids to the ``target`` ids of ``id_map (gene, target)``."""
    return picked.join(id_map, "gene").select(*by, F.col("target").alias("gene")).distinct()


def shown_genes(result: DataFrame, id_map: DataFrame, by: list[str] = []) -> DataFrame:
    """Rewrite the ``genes`` list to source ids; many-to-one as ``(a,b)``."""
    n = F.count("*")
    listed = F.array_join(F.array_sort(F.collect_list("gene")), ",")
    back = id_map.select("gene", "target").distinct().groupBy("target").agg(
        F.when(n > 1, F.concat(F.lit("("), listed, F.lit(")"))).otherwise(listed).alias("_shown")
    )
    parts = result.select(*by, "term", F.posexplode(F.split("genes", "/")).alias("_i", "target"))
    text = parts.join(back, "target").groupBy(*by, "term").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("_i", "_shown"))), lambda x: x["_shown"]), "/"
        ).alias("genes")
    )
    return result.drop("genes").join(text, [*by, "term"])


def enrich_kegg(
    gene_term: DataFrame, picked: DataFrame, id_map: DataFrame, by: list[str] = [], prefix: str = ""
) -> DataFrame:
    """Enrichment with ids translated on the way in and back on the way out."""
    out = enrich(gene_term, translate_genes(picked, id_map, by), by)
    out = shown_genes(out, id_map, by)
    return out.withColumn("term", F.concat(F.lit(prefix), F.col("term"))) if prefix else out


def diff_genes(df: DataFrame, logfc: float = 1.0, p: float = 0.05, adjust: bool = True) -> DataFrame:
    """Differential genes with an UP / DOWN label."""
    col = "fdr" if adjust else "pvalue"
    side = F.when(F.col("logfc") >= logfc, "UP").when(F.col("logfc") <= -logfc, "DOWN")
    return df.filter(F.col(col) <= p).withColumn("direction", side).filter(
        F.col("direction").isNotNull()
    )


def diff_lists(diff: DataFrame) -> DataFrame:
    """The UP, DOWN and ALL gene lists as one keyed table."""
    both = F.array(F.col("direction"), F.lit("ALL"))
    return diff.withColumn("gene_list", F.explode(both)).drop("direction")


def zscore_long(values: DataFrame, gene: str = "gene") -> DataFrame:
    """Raw values and row z-scores (population sd) of long expression rows."""
    m = values.groupBy(gene).agg(F.avg("value").alias("_a"), F.stddev_pop("value").alias("_s"))
    z = F.try_divide(F.col("value") - F.col("_a"), F.col("_s"))
    both = F.array(
        F.struct(F.lit("tpm_raw").alias("value_type"), F.col("value").alias("value")),
        F.struct(F.lit("tpm_zscore").alias("value_type"), z.alias("value")),
    )
    return values.join(m, gene).select(gene, "sample_name", F.explode(both).alias("v")).select(
        gene, "sample_name", "v.value_type", "v.value"
    )


def explode_terms(df: DataFrame, col: str, gene: str = "gene") -> DataFrame:
    """Comma term lists to distinct gene-term pairs; ``-`` is no term."""
    return (
        df.filter((F.col(col) != "-") & (F.col(col) != ""))
        .select(F.col(gene).alias("gene"), F.explode(F.split(col, ",")).alias("term"))
        .distinct()
    )
