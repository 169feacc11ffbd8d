"""Many small files as one table, a row ``path, text`` for each.

A file per library or run takes some milliseconds to write, list and open, most of
them on the driver, whatever it holds.  In a bundle its cost is that of its bytes;
readers take the name from ``path`` as they would from the file's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_bundle(files: DataFrame, path: str) -> None:
    files.select("path", "text").write.parquet(path)


def read_bundle(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.schema("path string, text string").parquet(*([path] if isinstance(path, str) else path))


def pack_files(spark: SparkSession, source: str | list[str], path: str) -> None:
    """Bundle of files that have arrived one by one, so that they are opened once only."""
    whole = spark.read.text(source, wholetext=True)
    write_bundle(whole.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")), path)
