"""Writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from ..operators.ordered import numbered
from .bgzip import write_bgzip


def formatted(df: DataFrame, cols: list[str] | None = None, precision: int | None = None) -> DataFrame:
    """Chosen columns with floats at a fixed number of decimals."""
    cols = cols or df.columns
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def show(c: str) -> Column:
        if precision is not None and isinstance(kinds[c], (DoubleType, FloatType)):
            return F.format_string(f"%.{precision}f", F.col(c)).alias(c)
        return F.col(c)

    return df.select(*[show(c) for c in cols])


def write_table(
    df: DataFrame, path: str, cols: list[str] | None = None, precision: int | None = None,
    sep: str = "\t", header: bool = True, compression: str = "none", mode: str = "errorifexists",
) -> None:
    formatted(df, cols, precision).write.csv(path, sep=sep, header=header, compression=compression, mode=mode)


def gt_to_vcf(wide: DataFrame, samples: list[str]) -> DataFrame:
    """VCF body columns of a wide genotype table."""
    dot = F.lit(".")
    return wide.select(
        "chrom", "pos", F.concat_ws("_", "chrom", "pos").alias("id"), "ref", "alt",
        dot.alias("qual"), dot.alias("filter"), dot.alias("info"), F.lit("GT").alias("format"),
        *[F.coalesce(F.col(s), F.lit("./.")).alias(s) for s in samples],
    )


def vcf_lines(wide: DataFrame, sizes: DataFrame, samples: list[str]) -> DataFrame:
    """Header and body lines with their sort keys.  ``sizes``: chrom, size, rank."""
    zero = F.lit(0).cast("bigint")
    fixed = [
        (0, "##fileformat=VCFv4.2"),
        (2, '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">'),
        (3, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples])),
    ]
    head = wide.sparkSession.createDataFrame(fixed, "kind int, value string").select(
        "kind", zero.alias("rank"), zero.alias("pos"), "value"
    )
    contigs = sizes.select(
        F.lit(1).alias("kind"), F.col("rank").cast("bigint").alias("rank"), zero.alias("pos"),
        F.format_string("##contig=<ID=%s,length=%d>", "chrom", "size").alias("value"),
    )
    body = gt_to_vcf(wide, samples)
    cols = [F.col(f"`{c}`").cast("string") for c in body.columns]
    lines = body.join(sizes.select("chrom", "rank"), "chrom", "left").select(
        F.lit(4).alias("kind"), F.coalesce(F.col("rank").cast("bigint"), F.lit(1 << 62)).alias("rank"), "pos",
        F.concat_ws("\t", *cols).alias("value"),
    )
    return head.unionByName(contigs).unionByName(lines)


def write_vcf(wide: DataFrame, sizes: DataFrame, samples: list[str], path: str, bgzip: bool = False) -> None:
    """Ordered parts, as text or in bgzip blocks; part 0 begins with the header."""
    lines = vcf_lines(wide, sizes, samples).orderBy("kind", "rank", "pos").select("value")
    if bgzip:
        write_bgzip(lines, path)
    else:
        lines.write.text(path)


def fasta_lines(df: DataFrame, seq_id: str = "seq_id", seq: str = "seq") -> DataFrame:
    return df.select(F.concat(F.lit(">"), F.col(seq_id).cast("string"), F.lit("\n"), F.col(seq)).alias("value"))


def write_fasta(df: DataFrame, path: str, seq_id: str = "seq_id", seq: str = "seq") -> None:
    fasta_lines(df, seq_id, seq).write.text(path)


def write_bed(df: DataFrame, sizes: DataFrame, path: str, cols: list[str] = ["chrom", "start", "end"]) -> None:
    """BED in genome order; chromosomes without a rank come last."""
    ordered = df.join(sizes.select("chrom", "rank"), "chrom", "left").orderBy(F.asc_nulls_last("rank"), "chrom", cols[1])
    ordered.select(*cols).write.csv(path, sep="\t")


def write_by(df: DataFrame, key: str | list[str], path: str, sep: str = "\t") -> None:
    """One folder per key value."""
    keys = [key] if isinstance(key, str) else key
    df.write.partitionBy(*keys).csv(path, sep=sep, header=True)


def clean_header(df: DataFrame) -> DataFrame:
    """Lower-case column names with ``_`` for every other character."""
    import re

    return df.toDF(*[re.sub(r"\W+", "_", c.strip()).strip("_").lower() for c in df.columns])


def write_jdbc(
    df: DataFrame, url: str, table: str, mode: str = "append", properties: dict[str, str] = {},
    id_order: str | None = None,
) -> None:
    """Append to or replace a database table; ``id_order`` adds a 1-based ``id``
    in the order of a numeric column."""
    out = clean_header(df)
    if id_order is not None:
        out = numbered(out, [], id_order, "id")
    out.write.jdbc(url, table, mode=mode, properties=properties)
