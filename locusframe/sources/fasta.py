"""FASTA readers: whole records, or pieces of records by byte ranges.

For pieces, a task reads a range of lines without knowing what came before it: bases
ahead of its first header belong to a record that an earlier range opened.  Each range
also has a summary of one row (headers, bases ahead of the first and behind the last);
summaries add up in order, which gives every range the record it begins in and how
many of its bases are already read.  No row or task holds a record.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from .ranges import Range, Task, cut, files_of, lines, split_bytes, task_options, tasks

_SPACE = b" \t\r\n\x0b\x0c"


class FastaSource(DataSource):
    """Options: ``files`` (JSON list), ``split`` (bytes), ``width`` (bases of a piece; 0 for summaries)."""

    @classmethod
    def name(cls) -> str:
        return "locusframe_fasta"

    def schema(self) -> str:
        if self.options["width"] == "0":
            return "file string, no int, heads bigint, last string, bases bigint"
        return "file string, no int, segment bigint, head string, start bigint, seq string"

    def reader(self, schema) -> DataSourceReader:
        return FastaReader(self.options)


class FastaReader(DataSourceReader):
    def __init__(self, options):
        self.files, self.split, self.width = json.loads(options["files"]), int(options["split"]), int(options["width"])
        self.options = options

    def partitions(self) -> list[Task]:
        return tasks(cut(self.files, self.split), self.options)

    def read(self, task: Task):
        for part in task.ranges:
            yield from self._range(part)

    def _range(self, part: Range):
        """``segment`` 0 is what comes ahead of the range's first header."""
        import pyarrow as pa

        heads, last, bases = 0, None, 0
        rows: list[tuple] = []
        start, left = 0, b""

        def flush(whole: bool):
            nonlocal start, left
            end = len(left) if whole else len(left) - len(left) % self.width
            for k in range(0, end, self.width):
                rows.append((heads, last, start + k, left[k : min(k + self.width, end)]))
            start, left = start + end, left[end:]

        def packed():
            cols = list(zip(*rows))
            return pa.record_batch(
                [
                    pa.array([part.file] * len(rows)), pa.array([part.no] * len(rows), pa.int32()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()),
                    pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary()).cast(pa.string()),
                ],
                ["file", "no", "segment", "head", "start", "seq"],
            )

        for piece in lines(part):
            first, *records = (b"\n" + piece).split(b"\n>")
            for k, text in enumerate([first, *records]):
                if k:
                    if self.width:
                        flush(True)
                    head, _, text = text.partition(b"\n")
                    heads, last, bases, start = heads + 1, head.decode().strip(), 0, 0
                    if self.width:
                        rows.append((heads, last, 0, b""))
                more = text.translate(None, _SPACE)
                bases += len(more)
                if self.width:
                    left += more
                    flush(False)
            if rows:
                yield packed()
                rows.clear()
        if self.width:
            flush(True)
            if rows:
                yield packed()
        else:
            names = ["file", "no", "heads", "last", "bases"]
            yield pa.record_batch(
                [pa.array([part.file]), pa.array([part.no], pa.int32()), pa.array([heads], pa.int64()), pa.array([last], pa.string()), pa.array([bases], pa.int64())], names
            )


def read_fasta_pieces(spark: SparkSession, path: str | list[str], width: int = 10_000, split: int | None = None) -> DataFrame:
    """``file, record, seq_id, description, start, seq``: pieces of at most ``width`` bases.

    ``start`` is 0-based in the record, ``record`` its number in the file from 1.  A record
    also has one piece without bases at its header, so that an empty record is there too.
    Lines ahead of a file's first header belong to no record.  ``split`` is the number of
    bytes of a range, by default what Spark lets a task read, and a task has as many ranges
    as make up that; the text is read twice.
    """
    spark.dataSource.register(FastaSource)
    files = json.dumps(files_of(spark, path))

    def source(width: int) -> DataFrame:
        read = spark.read.format("locusframe_fasta").option("files", files).option("split", split or split_bytes(spark))
        return read.options(**task_options(spark)).option("width", width).load()

    # a row per range; ranges since the one with the last header add up
    order = Window.partitionBy("file").orderBy("no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    s = source(0).withColumn("since", F.sum((F.col("heads") > 0).cast("int")).over(order))
    s = s.withColumn("read", F.sum("bases").over(Window.partitionBy("file", "since").orderBy("no")))
    carry = s.select(
        "file", "no", F.coalesce(F.sum("heads").over(before), F.lit(0)).alias("heads"), F.last("last", True).over(before).alias("open"),
        F.coalesce(F.lag("read").over(order), F.lit(0)).alias("read"),
    )
    ahead = F.col("segment") == 0
    rows = source(width).join(F.broadcast(carry), ["file", "no"]).withColumn("head", F.when(ahead, F.col("open")).otherwise(F.col("head")))
    return rows.filter("head is not null").select(
        "file", (F.col("heads") + F.col("segment")).alias("record"), F.regexp_extract("head", r"^(\S*)", 1).alias("seq_id"),
        F.trim(F.regexp_replace("head", r"^\S*", "")).alias("description"), (F.col("start") + F.when(ahead, F.col("read")).otherwise(0)).alias("start"), "seq",
    )


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``seq_id, description, seq`` per record.

    The reader splits at a line break followed by ``>``, so a ``>`` inside a
    description is harmless.
    """
    raw = spark.read.text(path, lineSep="\n>").filter(F.trim("value") != "")
    rec = F.regexp_replace("value", "^>", "")
    head = F.trim(F.regexp_extract(rec, r"^([^\r\n]*)", 1))
    seq = F.regexp_replace(F.regexp_replace(rec, r"^[^\r\n]*", ""), r"\s+", "")
    return raw.select(
        F.regexp_extract(head, r"^(\S*)", 1).alias("seq_id"),
        F.trim(F.regexp_replace(head, r"^\S*", "")).alias("description"),
        seq.alias("seq"),
    )
