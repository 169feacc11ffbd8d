"""Delimited-table readers: genotype tables, BED, GTF, alignments, sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..functions import text as X
from ..functions.variant import parse_accession

Paths = str | list[str]


def read_tsv(spark: SparkSession, path: Paths, schema: str, header: bool = False, **options) -> DataFrame:
    return spark.read.csv(path, schema=schema, sep="\t", header=header, **options)


def numbered_lines(spark: SparkSession, path: Paths) -> DataFrame:
    """``file, line_no, line`` of small text files (reports, size tables)."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    lines = whole.select("file", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))
    return lines.filter(F.col("line") != "")


def read_gt_table(spark: SparkSession, path: Paths, samples: list[str] | None = None) -> DataFrame:
    """Wide genotype TSV to long calls; without a header the samples are given."""
    if samples is None:
        wide = spark.read.csv(path, sep="\t", header=True)
        wide = wide.toDF(*["chrom", "pos", "ref", "alt"], *wide.columns[4:])
        samples = wide.columns[4:]
    else:
        cols = ", ".join(f"`{c}` string" for c in ["chrom", "pos", "ref", "alt", *samples])
        wide = read_tsv(spark, path, cols)
    return wide.unpivot(["chrom", "pos", "ref", "alt"], samples, "sample_id", "gt").withColumn(
        "pos", F.col("pos").cast("bigint")
    )


def read_depth_table(spark: SparkSession, path: Paths, samples: list[str]) -> DataFrame:
    """Wide depth TSV to long depths; anything but digits is 0."""
    cols = ", ".join(f"`{c}` string" for c in ["chrom", "pos", *samples])
    long = read_tsv(spark, path, cols).unpivot(["chrom", "pos"], samples, "sample_id", "depth")
    return long.select("chrom", F.col("pos").cast("bigint").alias("pos"), "sample_id", F.coalesce(F.col("depth").try_cast("int"), F.lit(0)).alias("depth"))


def read_bed(spark: SparkSession, path: Paths, cols: str = "") -> DataFrame:
    """BED; ``cols`` names columns after the first three, e.g. ``id string``."""
    schema = "chrom string, start bigint, end bigint" + (f", {cols}" if cols else "")
    return read_tsv(spark, path, schema, comment="#")


def read_chrom_sizes(spark: SparkSession, path: Paths) -> DataFrame:
    """``chrom, size, rank`` of a size table or ``.fai``; rank is file order."""
    c = F.split("line", "\t")
    return numbered_lines(spark, path).select(
        c[0].alias("chrom"), c[1].cast("bigint").alias("size"), F.col("line_no").alias("rank")
    )


def read_gtf(spark: SparkSession, path: Paths, style: str = "gtf") -> DataFrame:
    """Nine GTF/GFF columns and the attributes as a map."""
    schema = (
        "chrom string, source string, feature string, start bigint, end bigint, score string, "
        "strand string, frame string, attributes string"
    )
    df = read_tsv(spark, path, schema, comment="#", quote="")
    if style == "gff":
        return df.withColumn("attrs", S.gff_attrs(F.col("attributes")))
    pat = r'(\S+) "([^"]*)"'
    keys, vals = (F.regexp_extract_all("attributes", F.lit(pat), F.lit(i)) for i in (1, 2))
    # repeated keys keep their first value
    pairs = F.arrays_zip(keys.alias("k"), vals.alias("v"))
    firsts = F.filter(pairs, lambda x, i: F.array_position(keys, x["k"]) == i + 1)
    return df.withColumn("attrs", F.map_from_entries(firsts))


def read_blast(spark: SparkSession, path: Paths) -> DataFrame:
    """Alignment table with the twelve standard columns."""
    schema = (
        "id string, chrom string, identity double, match_len int, mismatch int, gapopen int, "
        "qstart bigint, qend bigint, start bigint, end bigint, evalue double, bitscore double"
    )
    return read_tsv(spark, path, schema)


def read_paf(spark: SparkSession, path: Paths) -> DataFrame:
    """PAF lines with CIGAR and mismatch tags parsed in the same scan."""
    c = F.split("value", "\t")
    big = lambda i: c[i].cast("bigint")
    return spark.read.text(path).filter(F.col("value") != "").select(
        c[0].alias("id"), big(1).alias("probe_length"), big(2).alias("probe_start"),
        big(3).alias("probe_end"), c[4].alias("strand"), c[5].alias("chrom"),
        big(6).alias("chrom_length"), big(7).alias("match_start"), big(8).alias("match_end"),
        big(9).alias("match_length"), big(10).alias("block_length"), big(11).alias("mapq"),
        F.regexp_extract("value", r"cg:Z:(\w+)", 1).alias("cigar"),
        F.regexp_extract("value", r"NM:i:(\d+)", 1).try_cast("int").alias("n_mismatch"),
    )


def scan_csv_glob(spark: SparkSession, paths: Paths, sep: str = ",", schema: str | None = None) -> DataFrame:
    """Many CSV files as one table, columns matched by name.

    Files are grouped by their header line, one scan a group; a column that a file
    lacks is null in its rows.  With a ``schema`` the files are taken to have that shape.
    """
    if schema is not None:
        return spark.read.csv(paths, header=True, sep=sep, schema=schema)
    first = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("at"), "value",
    )
    # one header line per file reaches the driver, as the file listing does
    heads = first.filter("at.block = 0").groupBy("file").agg(F.min_by("value", "at").alias("head")).collect()
    groups: dict[str, list[str]] = {}
    for r in sorted(heads, key=lambda r: r["file"]):
        groups.setdefault(r["head"], []).append(r["file"])
    if not groups:
        return spark.read.csv(paths, header=True, sep=sep)
    parts = [spark.read.csv(files, header=True, sep=sep) for files in groups.values()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def read_per_sample(
    spark: SparkSession, path: Paths, schema: str, name_re: str = r"([^/]+?)(?:\.[^/.]+)*$", sep: str = "\t",
    header: bool = False,
) -> DataFrame:
    """One file per sample in one scan; the sample comes from the file path."""
    df = spark.read.csv(path, schema=schema, sep=sep, header=header, comment="#")
    return df.withColumn("sample_id", F.regexp_extract(F.col("_metadata.file_path"), name_re, 1))


# Fixed value: sample named by the parent folder.
PARENT_DIR = r"([^/]+)/[^/]+$"


def read_depth(spark: SparkSession, path: Paths, name_re: str = PARENT_DIR) -> DataFrame:
    """Per-position depth files ``#Chr Pos depth …`` as long rows."""
    return read_per_sample(spark, path, "chrom string, pos bigint, depth int", name_re)


def read_accessions(spark: SparkSession, path: Paths) -> DataFrame:
    """Ragged lines ``chrom pos ref alt n sample=…`` exploded to accessions."""
    c = F.split("value", "\t")
    packed = F.slice(c, F.lit(6), F.greatest(F.size(c) - 5, F.lit(0)))
    return spark.read.text(path).filter(F.col("value") != "").select(
        c[0].alias("chrom"), c[1].cast("bigint").alias("pos"), c[2].alias("refer"), c[3].alias("alt"),
        F.explode(packed).alias("accession"),
    )


def flat_accessions(accessions: DataFrame) -> DataFrame:
    return accessions.withColumn("_a", parse_accession(F.col("accession"))).select("chrom", "pos", "refer", "alt", "_a.*")


def read_eggnog(spark: SparkSession, path: Paths) -> DataFrame:
    """Transcript name, description, GO and KO columns of an orthology table."""
    c = F.split("value", "\t")
    return spark.read.text(path).filter(~F.col("value").startswith("#") & (F.col("value") != "")).select(
        c[0].alias("transcript_id"), c[8].alias("gene_name"), c[7].alias("gene_description"), c[9].alias("go"), c[12].alias("ko")
    )


def read_interpro(spark: SparkSession, path: Paths) -> DataFrame:
    """Transcript with its GO list and pathway ids as comma lists, ``-`` if none."""
    c = F.split("value", "\t")
    go = F.try_element_at(c, F.lit(14))
    raw = F.filter(F.split(F.coalesce(F.try_element_at(c, F.lit(15)), F.lit("")), r"\|"), lambda x: x.startswith("KEGG"))
    ko = F.array_join(F.transform(raw, lambda x: X.kegg_id(x)), ",")
    blank = lambda x: F.when(F.coalesce(x, F.lit("")) == "", "-").otherwise(x)
    return spark.read.text(path).filter(F.col("value") != "").select(
        c[0].alias("transcript_id"), blank(F.translate(go, "|", ",")).alias("go"), blank(ko).alias("ko")
    )


def read_ws(spark: SparkSession, path: Paths, cols: dict[str, int], types: dict[str, str] = {}) -> DataFrame:
    """Whitespace table; ``cols`` maps a name to its 0-based column."""
    c = F.split(F.trim("value"), r"\s+")
    pick = [c[i].try_cast(types.get(n, "string")).alias(n) for n, i in cols.items()]
    return spark.read.text(path).filter(F.trim("value") != "").select(*pick)


def read_table(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """Separator by suffix, else by the first line of the file."""
    name = path.removesuffix(".gz")
    if name.endswith((".tsv", ".bed")):
        sep = "\t"
    elif name.endswith(".csv"):
        sep = ","
    else:
        first = spark.read.text(path).first()
        sep = "\t" if first and "\t" in first.value else ","
    return spark.read.csv(path, header=header, sep=sep)


def read_jdbc(
    spark: SparkSession, url: str, table: str, properties: dict[str, str] = {},
    column: str | None = None, lower: int = 0, upper: int = 0, partitions: int = 8,
) -> DataFrame:
    """Database table, split by ranges of ``column`` when one is given."""
    if column is None:
        return spark.read.jdbc(url, table, properties=properties)
    return spark.read.jdbc(
        url, table, column=column, lowerBound=lower, upperBound=upper, numPartitions=partitions, properties=properties
    )


def file_inventory(spark: SparkSession, base: str, glob: str) -> DataFrame:
    """``path, length`` of the files below a folder; contents are not read."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob).load(base).select("path", "length")
    )


def fastq_fields(files: DataFrame) -> DataFrame:
    """``libid, read_type, path, bytes``; files of no known read side are dropped."""
    folder = F.substring_index(F.substring_index("path", "/", -2), "/", 1)
    # the folder is named Sample_<library> or Sample-<library>
    lib = X.lib_id(F.regexp_replace(folder, "^Sample_", ""))
    name = F.substring_index("path", "/", -1)
    return files.select(
        lib.alias("libid"), X.read_type(name).alias("read_type"), "path", F.col("length").alias("bytes")
    ).filter(F.col("read_type").isNotNull())


def scan_fastq_tree(spark: SparkSession, base: str) -> DataFrame:
    """Inventory of a sequencing delivery tree."""
    return fastq_fields(file_inventory(spark, base, "*.fastq.gz"))
