"""Structured Streaming forms of the file-intake and chunk loops.

Writers append one folder of changed rows per batch and overwrite it when the
batch is replayed, so a batch costs what it holds and a lost executor changes
nothing.  :func:`latest` resolves the newest row of each key.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.calls import site_stats
from ..operators.coverage import sample_coverage


def newest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row per key; aggregated map-side, so a busy key stays small."""
    rest = [c for c in df.columns if c not in keys]
    by = F.struct(*order, *[c for c in rest if c not in order])
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), by).alias("_x"))
    return best.select(*keys, "_x.*").select(*df.columns)


def _log(path: str, shape: Callable[[DataFrame], DataFrame] = lambda df: df):
    def save(batch: DataFrame, n: int) -> None:
        shape(batch).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return save


def latest(spark: SparkSession, path: str, keys: list[str], ts: str | None = None) -> DataFrame:
    """Current table of a writer here: newest by ``ts``, else by batch."""
    df = spark.read.parquet(path)
    return newest(df, keys, [ts] if ts else ["batch"]).drop("batch")


_STORE = "spark.sql.streaming.stateStore"
#: State on local disk behind a bounded cache; Spark's own choice keeps two versions of all keys in the heap.
STATE = {
    f"{_STORE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_STORE}.rocksdb.boundedMemoryUsage": "true",
}


@contextmanager
def _state_on_disk(spark: SparkSession):
    """A stream takes its settings when it starts; what the session sets itself stays."""
    mine = {} if spark.conf.get(f"{_STORE}.providerClass", None) else {k: v for k, v in STATE.items() if spark.conf.get(k, None) is None}
    for k, v in mine.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k in mine:
            spark.conf.unset(k)


def _start(stream: DataFrame, save, checkpoint: str, mode: str) -> StreamingQuery:
    with _state_on_disk(stream.sparkSession):
        return (
            stream.writeStream.foreachBatch(save).outputMode(mode)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_batch: int = 100, **options) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(path)


def intake_stream(stream: DataFrame, keys: list[str], ts: str, path: str, checkpoint: str) -> StreamingQuery:
    """One status row per key and batch, the newest by ``ts``."""
    return _start(stream, _log(path, lambda b: newest(b, keys, [ts])), checkpoint, "append")


def running_site_stats(calls: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Site statistics that are updated as call files arrive."""
    return _start(site_stats(calls), _log(path), checkpoint, "update")


def running_sample_coverage(depth: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return _start(sample_coverage(depth), _log(path), checkpoint, "update")


def dedup_stream(
    stream: DataFrame, keys: list[str], path: str, checkpoint: str, ts: str | None = None,
    delay: str = "1 hour",
) -> StreamingQuery:
    """First row of each key over all files.

    With a load time ``ts`` the state is dropped ``delay`` after the watermark.
    """
    if ts is None:
        once = stream.dropDuplicates(keys)
    else:
        once = stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)
    with _state_on_disk(stream.sparkSession):
        return (
            once.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start()
        )
