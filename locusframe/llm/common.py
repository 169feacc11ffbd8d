"""Shared plumbing: tables, scratch copies and Arrow batches of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.plans.session import scratch

BATCH_ROWS = 1000
SLICE_BYTES = 2 << 20
#: A row without an identifier counts as the one with the smallest.
NO_ID = -(1 << 63)
_SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lean(df: DataFrame) -> DataFrame:
    """Keep Arrow batches small: texts are wide, and a batch is held whole."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared scratch folder and read back, so that it is made once.

    What was shuffled for it is not needed again and goes with the end of the write.
    """
    conf, path = df.sparkSession.conf, scratch(df.sparkSession, name)
    before = conf.get(_SHUFFLES_GO, "false")
    conf.set(_SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(_SHUFFLES_GO, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ident(col: str) -> Column:
    return F.coalesce(F.col(f"`{col}`").cast("bigint"), F.lit(NO_ID))


def given(col: str) -> Column:
    """The identifier as the table has it: null again where there was none."""
    return F.nullif(ident(col), F.lit(NO_ID))


def held_out(col: str, mod: int, rest: int) -> Column:
    """Whether crc32 of the identifier's text leaves ``rest``; null counts as the empty text."""
    return F.crc32(F.coalesce(given(col).cast("string"), F.lit("")).cast("binary")) % mod == rest


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and where each row begins; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(at):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text; a longer text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = raw(batch.column(text))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi
