"""Library bookkeeping, report summaries and read-quality checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .calls import count_if, ratio


def match_libraries(sheet: DataFrame, files: DataFrame) -> DataFrame:
    """Sample sheet with its files; a library without files keeps a null path."""
    return sheet.join(files, "libid", "left")


def library_qc(sheet: DataFrame, files: DataFrame) -> DataFrame:
    """Distinct and missing samples and libraries."""
    m = match_libraries(sheet, files)
    gone = F.col("path").isNull()
    return m.agg(
        F.countDistinct("sample_id").alias("samples"), F.countDistinct("libid").alias("libraries"),
        F.countDistinct(F.when(gone, F.col("sample_id"))).alias("missing_samples"),
        F.countDistinct(F.when(gone, F.col("libid"))).alias("missing_libraries"),
    )


def library_errors(sheet: DataFrame, files: DataFrame, low_data: float = 0.01) -> DataFrame:
    """``name, error_type, message`` rows of every sheet and file problem."""
    row = lambda name, kind, text: [name.cast("string").alias("name"), F.lit(kind).alias("error_type"), text.alias("message")]
    twice = sheet.groupBy("libid", "sample_id", "dir_name").count().filter("count > 1").select(
        *row(F.col("libid"), "DUPLICATED", F.concat_ws(" | ", F.lit("duplicate sheet row"), "libid", "sample_id", "dir_name"))
    )
    low = sheet.filter(F.col("data_size") < low_data).distinct().select(
        *row(F.col("libid"), "INCOMPLETE", F.concat_ws(" | ", F.lit("low data"), "libid", "sample_id", "dir_name"))
    )
    r1, r2 = (count_if(F.col("read_type") == r) for r in ("R1", "R2"))
    uneven = files.groupBy("libid").agg(r1.alias("r1"), r2.alias("r2")).filter("r1 <> r2").select(
        *row(F.col("libid"), "INCOMPLETE", F.concat(F.lit("R1 "), F.col("r1"), F.lit(" R2 "), F.col("r2")))
    )
    gone = sheet.join(files, "libid", "left_anti").distinct().select(
        *row(F.col("libid"), "INCOMPLETE", F.concat_ws(" | ", F.lit("no files"), "libid", "sample_id", "dir_name"))
    )
    return twice.unionByName(low).unionByName(uneven).unionByName(gone)


def merge_plan(matched: DataFrame) -> DataFrame:
    """Files to be merged per (sample, read), in order; skipped if any is missing."""
    lost = count_if(F.col("path").isNull())
    g = matched.groupBy("sample_id", "read_type").agg(
        F.array_join(F.array_sort(F.collect_list("path")), ",").alias("files"),
        F.count("path").alias("n_files"), lost.alias("_lost"),
    )
    return g.filter(F.col("_lost") == 0).drop("_lost")


def quality_anomalies(curves: DataFrame, by: list[str], curve: str = "curve", share: float = 0.1) -> DataFrame:
    """Positions where quality jumps by more than a tenth of the head-tail drop.

    ``curve`` is one read-length array per row; reads under ten bases are
    skipped and a flat curve uses the fixed limit 2.0.
    """
    n = F.size(curve)
    k = F.least(F.lit(10), F.floor(n / 4)).cast("int")
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / k
    c = curves.filter(n >= 10).withColumns(
        {"head_quality": mean(F.slice(curve, 1, k)), "tail_quality": mean(F.slice(curve, -k, k))}
    )
    diff = F.col("head_quality") - F.col("tail_quality")
    c = c.withColumn("dynamic_threshold", F.when(diff > 0, diff * share).otherwise(2.0))
    # each value beside the one before it
    steps = F.arrays_zip(
        F.slice(curve, F.lit(1), n - 1).alias("quality_before"), F.slice(curve, F.lit(2), n - 1).alias("quality_after")
    )
    x = c.select(*by, "head_quality", "tail_quality", "dynamic_threshold", F.posexplode(steps).alias("_i", "_s"))
    return x.select(
        *by, (F.col("_i") + 1).alias("position"), "_s.quality_before", "_s.quality_after",
        F.abs(F.col("_s.quality_before") - F.col("_s.quality_after")).alias("drop"),
        (F.col("_s.quality_after") < 30).alias("below_q30"),
        "head_quality", "tail_quality", "dynamic_threshold",
    ).filter(F.col("drop") > F.col("dynamic_threshold"))


def quality_summary(anomalies: DataFrame, libraries: DataFrame, by: str = "libid") -> DataFrame:
    """Number, first, last and largest jump per library, zero kept."""
    s = anomalies.groupBy(by).agg(
        F.count("*").alias("bad_number"), F.min("position").alias("bad_start"),
        F.max("position").alias("bad_end"), F.max("drop").alias("max_drop"),
    )
    return libraries.select(by).distinct().join(s, by, "left").fillna(0)


def q30_rate(curves: DataFrame, curve: str = "curve", threshold: int = 30) -> DataFrame:
    n = F.size(F.filter(curve, lambda q: q >= threshold))
    return curves.withColumn("q30_rate", ratio(n, F.size(curve)))


def psc_summary(psc: DataFrame, psi: DataFrame) -> DataFrame:
    """Per-sample totals of the SNP and indel sections of a variant report."""
    s = psc.select(
        "sample_id", "n_ref_hom", "n_non_ref_hom", "n_hets", "n_ts", "n_tv", "n_indels", "n_missing",
        (F.col("n_ref_hom") + F.col("n_non_ref_hom") + F.col("n_hets") + F.col("n_missing")).alias("snp_total"),
        (F.col("n_ref_hom") + F.col("n_indels") + F.col("n_missing")).alias("indel_total"),
    )
    return s.join(psi, "sample_id")


def effect_matrix(rows: DataFrame, effects: list[str], by: str = "sample_id") -> DataFrame:
    """Effect counts per sample, zero filled."""
    cols = [
        F.coalesce(F.sum(F.when(F.col("effect") == e, F.col("n"))), F.lit(0)).alias(e) for e in effects
    ]
    return rows.groupBy(by).agg(*cols)


def _distinct_text(c: str, sep: str) -> Column:
    """Distinct descriptions without ``-``; a lone ``-`` stays."""
    kept = F.array_sort(F.collect_set(F.when(F.col(c) != "-", F.col(c))))
    return F.when(F.size(kept) == 0, "-").otherwise(F.array_join(kept, sep))


def gene_locus(features: DataFrame, anno: DataFrame) -> DataFrame:
    """Gene locus text and its distinct names and descriptions.

    ``features``: gene_id, transcript_id, chrom, start, end, strand;
    ``anno``: transcript_id, gene_name, gene_description.
    """
    loc = features.groupBy("gene_id").agg(
        F.min("chrom").alias("_c"), F.min("start").alias("_s"), F.max("end").alias("_e"), F.min("strand").alias("_t")
    )
    locus = F.concat(F.col("_c"), F.lit(":"), F.col("_s").cast("string"), F.lit("-"), F.col("_e").cast("string"), F.lit("|"), F.col("_t"))
    tr = features.select("gene_id", "transcript_id").distinct()
    text = tr.join(anno, "transcript_id", "left").fillna("-").groupBy("gene_id").agg(
        _distinct_text("gene_name", "|").alias("gene_name"),
        _distinct_text("gene_description", "|").alias("gene_description"),
    )
    return loc.select("gene_id", locus.alias("locus")).join(text, "gene_id")


def gene_products(features: DataFrame) -> DataFrame:
    """Distinct products per gene joined by `` | ``, ``--`` when none."""
    kept = F.array_sort(F.collect_set(F.when(F.col("product") != "", F.col("product"))))
    return features.groupBy("gene_id").agg(
        F.when(F.size(kept) == 0, "--").otherwise(F.array_join(kept, " | ")).alias("description")
    )


def representative(seqs: DataFrame, tx2gene: DataFrame, order: str = "ord") -> DataFrame:
    """Longest transcript per gene, the first of equals."""
    j = seqs.join(tx2gene, "transcript_id").withColumn("_n", F.length("seq"))
    best = F.max_by(F.struct("transcript_id", "seq"), F.struct(F.col("_n"), -F.col(order)))
    return j.groupBy("gene_id").agg(best.alias("b")).select("gene_id", "b.*")
