"""Tool-report readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import QUALITY_JSON
from .bundles import read_bundle
from .tables import numbered_lines

_FILE_STEM = r"([^/]+?)(?:\.[^/.]+)*$"


def read_fastp(spark: SparkSession, path: str | list[str], name_re: str = _FILE_STEM, bundle: bool = False) -> DataFrame:
    """Mean quality curves per library and read side; the library's name comes from the path.

    ``bundle``: the reports are rows of a bundle in place of files.
    """
    if bundle:
        raw = read_bundle(spark, path).select("path", F.from_json("text", QUALITY_JSON).alias("x")).select("path", "x.*")
    else:
        raw = spark.read.json(path, schema=QUALITY_JSON, multiLine=True).select("*", F.col("_metadata.file_path").alias("path"))
    lib = F.regexp_extract("path", name_re, 1)
    side = lambda n: F.struct(
        F.lit(n).alias("read_type"), F.col(f"{n}_before_filtering.quality_curves.mean").alias("curve")
    )
    return raw.select(lib.alias("libid"), F.explode(F.array(side("read1"), side("read2"))).alias("x")).select(
        "libid", "x.*"
    ).filter(F.col("curve").isNotNull())


# Columns of the per-sample sections of a variant-stats report.
PSC = {
    "sample_id": 2, "n_ref_hom": 3, "n_non_ref_hom": 4, "n_hets": 5, "n_ts": 6, "n_tv": 7,
    "n_indels": 8, "n_missing": 13,
}
PSI = {"sample_id": 2, "n_frameshift": 3, "n_in_frame": 4}


def _tagged(lines: DataFrame, tag: str, cols: dict[str, int]) -> DataFrame:
    c = F.split("value", "\t")
    pick: list[Column] = [
        c[i].alias(n) if n == "sample_id" else F.coalesce(F.try_element_at(c, F.lit(i + 1)).try_cast("bigint"), F.lit(0)).alias(n)
        for n, i in cols.items()
    ]
    return lines.filter(F.col("value").startswith(tag + "\t")).select(*pick)


def read_bcfstats(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """The PSC and PSI rows of sectioned variant-stats reports."""
    lines = spark.read.text(path)
    return _tagged(lines, "PSC", PSC), _tagged(lines, "PSI", PSI)


def read_snpeff_stats(
    spark: SparkSession, path: str | list[str], section: str = "effects", name_re: str = _FILE_STEM
) -> DataFrame:
    """``sample_id, effect, n, percent`` rows of one "Count by …" section."""
    lines = numbered_lines(spark, path)
    w = Window.partitionBy("file").orderBy("line_no")
    head = F.when(F.col("line").startswith("#"), F.col("line"))
    inside = lines.withColumn("head", F.last(head, ignorenulls=True).over(w)).filter(
        F.col("head").contains(f"Count by {section}") & ~F.col("line").startswith("#")
    )
    c = F.split("line", r"\s*,\s*")
    return inside.select(
        F.regexp_extract("file", name_re, 1).alias("sample_id"), c[0].alias("effect"),
        c[1].try_cast("bigint").alias("n"), F.try_element_at(c, F.lit(3)).alias("percent"),
    ).filter(F.col("n").isNotNull())


def read_log_values(
    spark: SparkSession, path: str | list[str], patterns: dict[str, str], name_re: str = _FILE_STEM, bundle: bool = False
) -> DataFrame:
    """Numbers scraped from logs, one row per name: the last match of each pattern.

    Lines are in order of the block that they are in, then of reading.  With ``bundle``
    the logs are rows of a bundle and their lines in order of the path, then of the log.
    """
    if bundle:
        logs = read_bundle(spark, path).filter("text <> ''").select("path", F.posexplode(F.split("text", "\r\n|\r|\n")).alias("line", "value"))
        at = F.struct("path", "line")
    else:
        logs = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))
        at = F.struct("block", F.monotonically_increasing_id().alias("line"))
    lines = logs.select(F.regexp_extract("path", name_re, 1).alias("name"), "value", at.alias("at"))
    found = []
    for n, p in patterns.items():
        number = F.nullif(F.regexp_extract("value", p, 1), F.lit("")).try_cast("double")
        found.append(F.max_by(number, F.when(number.isNotNull(), F.col("at"))).alias(n))
    return lines.groupBy("name").agg(*found)
