"""Name cleaning, library ids and quality-report JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File-name endings of each read side.
READ_ENDINGS = {
    "R1": ["_R1.fastq.gz", "_1.fastq.gz"],
    "R2": ["_R2.fastq.gz", "_2.fastq.gz"],
}

CURVES = "quality_curves: struct<A: array<double>, T: array<double>, C: array<double>, G: array<double>, mean: array<double>>"
QUALITY_JSON = f"read1_before_filtering struct<{CURVES}>, read2_before_filtering struct<{CURVES}>"


def clean_name(x: Column) -> Column:
    return F.regexp_replace(F.trim(x), "[^a-zA-Z0-9_-]", "_")


def lib_id(name: Column) -> Column:
    """Last ``-`` part; a number or a single small letter takes one part more."""
    last = F.substring_index(name, "-", -1)
    return F.when(
        last.rlike("^[0-9]+$") | last.rlike("^[a-z]$"), F.substring_index(name, "-", -2)
    ).otherwise(last)


def read_type(filename: Column) -> Column:
    out = None
    for side, endings in READ_ENDINGS.items():
        hit = F.lit(False)
        for e in endings:
            hit = hit | filename.endswith(e)
        out = F.when(hit, side) if out is None else out.when(hit, side)
    return out


def chip_code(path: Column) -> Column:
    """Chip code of a capture report path, without a ``-S1`` style suffix."""
    name = F.regexp_replace(F.substring_index(path, "/", -1), r"\.capture\.report\.tsv$", "")
    return F.regexp_replace(name, "[-_][sS][0-9]+$", "")


def kegg_id(x: Column) -> Column:
    """``KEGG: 00010+1.1.1.1`` to ``ko00010``."""
    return F.concat(F.lit("ko"), F.split_part(F.substring_index(x, ": ", -1), F.lit("+"), F.lit(1)))


def quality_curves(json: Column) -> Column:
    """The two ``quality_curves`` structs of a quality report."""
    return F.from_json(json, QUALITY_JSON)
