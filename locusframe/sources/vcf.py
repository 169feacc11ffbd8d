"""VCF readers.

A Python data source reads VCF text in byte ranges, so that one large plain or bgzip
file is many tasks, and parses a range's lines in Arrow.  Each task takes the sample
names from the beginning of its own file: no job runs while a plan is built, no
header is joined, and nothing goes through the driver.  A file without a header, as
the later parts of a written folder are, has that of the folder's first file.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, LessThan, LessThanOrEqual,
)

from ..functions import genotype as G
from ..functions.variant import site_id
from .ranges import Range, cut, files_of, lines, split_bytes

_PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
_SITE = "chrom string, pos bigint, ref string, alt string, id string"


def _header(file: str) -> list[str] | None:
    """Sample names of a file's header; None where it has none."""
    for part in cut([file], 1 << 62):
        for piece in lines(part):
            for line in piece.splitlines():
                if line.startswith(b"#CHROM"):
                    return line.decode().split("\t")[9:]
                if not line.startswith(b"#"):
                    return None
    return None


def _names(part: Range) -> list[str]:
    """Sample names of the range's file, or of its folder's first."""
    names = _header(part.file)
    return (_header(part.first) or []) if names is None else names


class VcfSource(DataSource):
    """Options: ``files`` (JSON list), ``split`` (bytes), ``mode`` (lines, samples or calls), ``fields`` (JSON list)."""

    @classmethod
    def name(cls) -> str:
        return "locusframe_vcf"

    def schema(self) -> str:
        mode = self.options["mode"]
        if mode == "lines":
            return "value string"
        if mode == "samples":
            return "file string, ordinal int, sample_id string"
        return _SITE + ", sample_id string" + "".join(f", `{f}` string" for f in json.loads(self.options["fields"]))

    def reader(self, schema) -> DataSourceReader:
        return VcfReader(self.options)


class VcfReader(DataSourceReader):
    def __init__(self, options):
        self.mode, self.files, self.split = options["mode"], json.loads(options["files"]), int(options["split"])
        self.fields = json.loads(options.get("fields", "[]"))
        self.chroms: set[str] | None = None
        self.low, self.high = None, None

    def pushFilters(self, filters):
        """Lines outside of the chromosomes and positions asked for are dropped before their calls are taken apart.

        Spark applies all filters again.
        """
        for f in filters:
            if self.mode == "calls" and f.attribute == ("chrom",) and isinstance(f, (EqualTo, In)):
                found = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.chroms = found if self.chroms is None else self.chroms & found
            elif self.mode == "calls" and f.attribute == ("pos",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = f.value if self.low is None else max(self.low, f.value)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high = f.value if self.high is None else min(self.high, f.value)
            yield f

    def partitions(self) -> list[Range]:
        ranges = cut(self.files, self.split)
        return [r for r in ranges if r.no == 0] if self.mode == "samples" else ranges

    def read(self, part: Range):
        import pyarrow as pa

        if self.mode == "samples":
            names = _header(part.file) or []
            yield pa.record_batch([pa.array([part.file] * len(names), pa.string()), pa.array(range(len(names)), pa.int32()), pa.array(names, pa.string())], ["file", "ordinal", "sample_id"])
            return
        names = None
        for piece in lines(part):
            rows = [x for x in piece.replace(b"\r\n", b"\n").split(b"\n") if x and not x.startswith(b"#")]
            if not rows:
                continue
            if self.mode == "lines":
                yield pa.record_batch([pa.array(rows, pa.binary()).cast(pa.string())], ["value"])
                continue
            if names is None:
                names = _names(part)
            yield from self._calls(rows, names)

    def _calls(self, rows: list[bytes], names: list[str]):
        """The calls of some lines, sample by sample."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if self.chroms is not None or self.low is not None or self.high is not None:
            rows = [x for x in rows if self._wanted(x)]
        width = 9 + len(names)
        kinds: dict[bytes, list[list[bytes]]] = {}
        for x in rows:
            cols = x.split(b"\t")
            # a short line lacks the calls of its last samples, a long one has more than the header names
            cols = cols[:width] if len(cols) >= width else cols + [None] * (width - len(cols))
            kinds.setdefault(cols[8] or b"", []).append(cols)
        text = lambda values: pa.array(values, pa.binary()).cast(pa.string())
        for form, some in kinds.items():
            keys, n = form.decode().split(":"), len(some)
            if not names:
                continue
            turns = list(zip(*some))
            site = [text(turns[0]), pa.array([int(p) for p in turns[1]], pa.int64()), text(turns[3]), text(turns[4]), text(turns[2])]
            again = pa.array(np.tile(np.arange(n), len(names)))
            calls = text([v for t in turns[9:] for v in t])
            cols = [c.take(again) for c in site] + [pa.array(np.repeat(np.arange(len(names), dtype=np.int32), n))]
            cols[5] = pa.array(names, pa.string()).take(cols[5])
            for f in self.fields:
                if f not in keys:
                    cols.append(pa.nulls(len(calls), pa.string()))
                else:
                    cols.append(pc.struct_field(pc.extract_regex(calls, "^(?:[^:]*:){%d}(?P<v>[^:]*)" % keys.index(f)), 0))
            yield pa.record_batch(cols, ["chrom", "pos", "ref", "alt", "id", "sample_id", *self.fields])

    def _wanted(self, line: bytes) -> bool:
        chrom, pos = line.split(b"\t", 2)[:2]
        return (
            (self.chroms is None or chrom.decode() in self.chroms)
            and (self.low is None or int(pos) >= self.low) and (self.high is None or int(pos) <= self.high)
        )


def _source(spark: SparkSession, path: str | list[str], mode: str, fields: list[str] = [], split: int | None = None) -> DataFrame:
    spark.dataSource.register(VcfSource)
    if spark.conf.get(_PUSHDOWN) != "true":
        spark.conf.set(_PUSHDOWN, "true")
    if split is None:
        split = split_bytes(spark)
    return (
        spark.read.format("locusframe_vcf").option("files", json.dumps(files_of(spark, path))).option("split", split)
        .option("mode", mode).option("fields", json.dumps(fields)).load()
    )


def _site(cols: Column) -> list[Column]:
    return [
        cols[0].alias("chrom"), cols[1].cast("bigint").alias("pos"),
        cols[3].alias("ref"), cols[4].alias("alt"),
    ]


def read_vcf_sites(spark: SparkSession, path: str | list[str], split: int | None = None) -> DataFrame:
    """``chrom, pos, id, ref, alt`` of every record.

    ``split`` is the number of bytes of a file that one task reads, by default Spark's own.
    """
    # the limit keeps the split away from the sample columns
    cols = F.split("value", "\t", 6)
    return _source(spark, path, "lines", split=split).select(*_site(cols), cols[2].alias("id"))


def vcf_samples(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``sample_id, ordinal`` in header order, per file; only headers are read."""
    return _source(spark, path, "samples").select("file", "ordinal", "sample_id")


SITE = ["chrom", "pos", "ref", "alt"]


def read_vcf_calls(spark: SparkSession, path: str | list[str], ids: DataFrame | None = None, split: int | None = None) -> DataFrame:
    """Long genotype calls, unphased; ``ids`` restricts to ``chrom_pos`` ids.

    Filters on ``chrom`` and ``pos`` reach the tasks that read the text.
    """
    out = _source(spark, path, "calls", ["GT"], split).select(
        *SITE, "sample_id", F.translate(F.coalesce("GT", F.lit(".")), "|", "/").alias("gt")
    ).withColumn("gt", F.when(F.col("gt") == ".", "./.").otherwise(F.col("gt")))
    if ids is None:
        return out
    return out.join(ids.select("id"), site_id(F.col("chrom"), F.col("pos")) == F.col("id"), "left_semi")


def read_vcf_site_lines(spark: SparkSession, path: str | list[str], split: int | None = None) -> DataFrame:
    """A row per VCF line: the site and its unphased calls in header order as ``gts``.

    For :func:`calls.line_stats`; needs neither the header nor a shuffle.
    """
    cols = F.split("value", "\t")
    lines = _source(spark, path, "lines", split=split).select(*_site(cols), F.array_position(F.split(cols[8], ":"), "GT").cast("int").alias("_at"), F.slice(cols, F.lit(10), F.greatest(F.size(cols) - 9, F.lit(0))).alias("_v"))
    call = lambda v: F.translate(F.coalesce(F.when(F.col("_at") > 0, F.try_element_at(F.split(v, ":"), F.col("_at"))), F.lit(".")), "|", "/")
    gts = F.transform(F.transform("_v", call), lambda g: F.when(g == ".", "./.").otherwise(g))
    return lines.select(*SITE, gts.alias("gts"))


def read_vcf_coded(
    spark: SparkSession, path: str | list[str], max_alleles: int = 2, max_variants: int | None = None
) -> DataFrame:
    """Calls coded 0 / 1 / 2 / 3 (missing); wider sites are skipped.

    ``max_variants`` keeps the first sites in (chrom, pos) order.
    """
    calls = read_vcf_calls(spark, path)
    calls = calls.filter(F.size(F.split("alt", ",")) + 1 <= max_alleles)
    if max_variants is not None:
        first = read_vcf_sites(spark, path).filter(F.size(F.split("alt", ",")) + 1 <= max_alleles)
        first = first.orderBy("chrom", "pos").limit(max_variants).select("chrom", "pos")
        calls = calls.join(first, ["chrom", "pos"], "left_semi")
    return calls.withColumn("code", G.gt_code(F.col("gt")))


def read_vcf_depth(spark: SparkSession, path: str | list[str], split: int | None = None) -> DataFrame:
    """Genotype, total depth and allele depths; unreadable depths are 0."""
    ad = F.split("AD", ",")
    num = lambda c: F.coalesce(c.try_cast("int"), F.lit(0))
    return _source(spark, path, "calls", ["GT", "DP", "AD"], split).select(
        *SITE, "sample_id",
        F.translate(F.coalesce("GT", F.lit("./.")), "|", "/").alias("gt"),
        num(F.col("DP")).alias("depth"),
        num(F.try_element_at(ad, F.lit(1))).alias("ref_depth"),
        num(F.try_element_at(ad, F.lit(2))).alias("alt_depth"),
    )
