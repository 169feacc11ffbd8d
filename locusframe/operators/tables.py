"""General table operators: annotation joins, sets, sorts, validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .probes import drop_dups


def annotate(df: DataFrame, anno: DataFrame, on: list[str]) -> DataFrame:
    return df.join(anno, on, "left")


def inner_on(df: DataFrame, other: DataFrame, on: list[str], order: list[Column] | None = None) -> DataFrame:
    """Inner join after the build side is made unique on its keys."""
    return df.join(drop_dups(other, on, order) if order else other, on)


def outer_counts(frames: list[DataFrame], on: list[str], counts: list[str]) -> DataFrame:
    """Full outer join of count tables, nulls to 0."""
    return reduce(lambda a, b: a.join(b, on, "full_outer"), frames).fillna(0, counts)


def keep_in(df: DataFrame, ids: DataFrame, on: list[str]) -> DataFrame:
    return df.join(ids.select(*on), on, "left_semi")


def keep_not_in(df: DataFrame, ids: DataFrame, on: list[str]) -> DataFrame:
    return df.join(ids.select(*on), on, "left_anti")


def rename_keys(df: DataFrame, mapping: DataFrame, col: str, keep: bool = True) -> DataFrame:
    """Replace ``col`` by ``mapping (old, new)``; unknown keys stay or are dropped."""
    m = mapping.select(F.col("old").alias(col), F.col("new").alias("_new"))
    out = df.join(m, col, "left" if keep else "inner")
    return out.withColumn(col, F.coalesce("_new", col)).drop("_new").select(*df.columns)


def rename_map(df: DataFrame, names: dict[str, str], fill: str | None = None) -> DataFrame:
    out = df.select(*names).withColumnsRenamed(names)
    return out if fill is None else out.fillna(fill)


def attach_by_line(a: DataFrame, b: DataFrame, line: str = "line_no") -> DataFrame:
    """Positional join of two tables that carry their line numbers."""
    return a.join(b, line)


def slice_region(df: DataFrame, chrom: str, start: int, end: int, snp_only: bool = False) -> DataFrame:
    keep = (F.col("chrom") == chrom) & F.col("pos").between(start, end)
    if snp_only:
        keep = keep & (F.length("ref") == 1) & (F.length("alt") == 1)
    return df.filter(keep).distinct()


def filter_no_variant(df: DataFrame, kind: str) -> DataFrame:
    """Drop ``ALT='.'`` records that belong to the other variant class."""
    other = (F.length("ref") > 1) if kind == "snp" else (F.length("ref") == 1)
    return df.filter(~((F.col("alt") == ".") & other))


def validate(df: DataFrame, schema: StructType) -> DataFrame:
    """One row per problem: missing column, wrong type, nulls where not allowed.

    Null counts of all columns come from a single aggregate.
    """
    spark = df.sparkSession
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    bad = [(f.name, "missing column", 0) for f in schema.fields if f.name not in have]
    bad += [
        (f.name, f"type {have[f.name]}, wanted {f.dataType.simpleString()}", 0)
        for f in schema.fields
        if f.name in have and have[f.name] != f.dataType.simpleString()
    ]
    out = spark.createDataFrame(bad, "column string, problem string, rows bigint")
    strict = [f.name for f in schema.fields if f.name in have and not f.nullable]
    if strict:
        counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in strict])
        nulls = counts.unpivot([], strict, "column", "rows").filter("rows > 0")
        out = out.unionByName(nulls.select("column", F.lit("null values").alias("problem"), "rows"))
    return out


# --- sorts and limits --------------------------------------------------------


def sort_sites(df: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """(chrom, pos) order, or genome order by the ``rank`` of a size table, unranked chromosomes last."""
    if sizes is None:
        return df.orderBy("chrom", "pos")
    return df.join(sizes.select("chrom", "rank"), "chrom", "left").orderBy(F.asc_nulls_last("rank"), "chrom", "pos").drop("rank")


def sort_priority(df: DataFrame, cols: list[str], ascending: list[bool]) -> DataFrame:
    return df.orderBy(*[F.asc(c) if a else F.desc(c) for c, a in zip(cols, ascending)])


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def head_sites(df: DataFrame, n: int) -> DataFrame:
    """First ``n`` sites in (chrom, pos) order."""
    return df.orderBy("chrom", "pos").limit(n)


def down_sample(df: DataFrame, n: int, seed: int, key: str = "id") -> DataFrame:
    """``n`` rows chosen by a seeded hash of their key, the same on every run."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


# --- sets --------------------------------------------------------------------


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_distinct_by(frames: list[DataFrame], keys: list[str], order: list[Column]) -> DataFrame:
    return drop_dups(union_all(frames), keys, order)


def distinct_by(df: DataFrame, keys: list[str] | None = None, order: list[Column] | None = None) -> DataFrame:
    return drop_dups(df, keys, order) if keys else df.distinct()


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys seen more than once with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def upsert_latest(df: DataFrame, new: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Newest row per key over old and new rows (max_by aggregates map-side)."""
    rest = [c for c in df.columns if c not in keys]
    both = df.unionByName(new)
    newest = F.max_by(F.struct(*rest), F.struct(ts, *[c for c in rest if c != ts]))
    return both.groupBy(*keys).agg(newest.alias("_x")).select(*keys, "_x.*").select(*df.columns)
