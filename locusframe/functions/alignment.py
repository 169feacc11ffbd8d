"""Column expressions over alignment hits, CIGAR strings and probe windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_CIGAR = r"(\d+)([MIDNSHPX=])"


def cigar_ops(cigar: Column) -> Column:
    """``array<struct<n, op>>``."""
    return F.arrays_zip(
        F.transform(F.regexp_extract_all(cigar, F.lit(_CIGAR), F.lit(1)), lambda x: x.cast("int")).alias("n"),
        F.regexp_extract_all(cigar, F.lit(_CIGAR), F.lit(2)).alias("op"),
    )


def cigar_match_length(cigar: Column) -> Column:
    return F.aggregate(
        cigar_ops(cigar),
        F.lit(0),
        lambda acc, x: acc + F.when(x["op"] == "M", x["n"]).otherwise(0),
    )


def cigar_indels(cigar: Column, offset: Column) -> Column:
    """Struct (m, ins, del, lost) counted until ``offset`` matches are passed.

    ``lost`` is set when the offset falls exactly on a deletion.
    """
    off = offset.cast("int")
    # the whole M block that passes the offset is taken, then nothing more
    def step(acc, x):
        live = (acc["m"] <= off) & ~acc["lost"]
        return F.struct(
            (acc["m"] + F.when(live & (x["op"] == "M"), x["n"]).otherwise(0)).alias("m"),
            (acc["ins"] + F.when(live & (x["op"] == "I"), x["n"]).otherwise(0)).alias("ins"),
            (acc["dels"] + F.when(live & (x["op"] == "D"), x["n"]).otherwise(0)).alias("dels"),
            (acc["lost"] | (live & (x["op"] == "D") & (acc["m"] == off))).alias("lost"),
        )

    zero = F.struct(
        F.lit(0).alias("m"), F.lit(0).alias("ins"), F.lit(0).alias("dels"), F.lit(False).alias("lost")
    )
    return F.aggregate(cigar_ops(cigar), zero, step)


def lift_pos(
    cigar: Column,
    strand: Column,
    offset_start: Column,
    offset_end: Column,
    match_start: Column,
    probe_start: Column,
) -> Column:
    """1-based target position of a probe site; null if it cannot be placed."""
    off = F.when(strand == "+", offset_start).otherwise(offset_end)
    c = cigar_indels(cigar, off)
    pos = match_start + off + 1 - probe_start + c["dels"] - c["ins"]
    return F.when(c["lost"] | (c["m"] < off), None).otherwise(pos)


def real_match_length(
    match_len: Column, mismatch: Column, gap: Column, probe_len: Column
) -> Column:
    """Match length less mismatches and gaps, capped by the probe length."""
    return F.when(match_len > probe_len, probe_len - mismatch + gap).otherwise(
        match_len - mismatch - gap
    )


def hit_strand(start: Column, end: Column) -> Column:
    return F.when(start > end, "-").otherwise("+")


def hit_center(start: Column, end: Column) -> Column:
    return F.floor((start + end) / 2).cast("bigint")


def pair_bounds(ls: Column, le: Column, rs: Column, re: Column) -> Column:
    """Span from the first primer's low end to the second primer's high end."""
    forward = hit_center(ls, le) < hit_center(rs, re)
    return F.struct(
        F.when(forward, F.least(ls, le)).otherwise(F.least(rs, re)).alias("start"),
        F.when(forward, F.greatest(rs, re)).otherwise(F.greatest(ls, le)).alias("end"),
    )


def blast_to_paf(
    qstart: Column, qend: Column, sstart: Column, send: Column, probe_len: Column
) -> Column:
    """0-based probe and target starts with the minus strand flipped."""
    minus = sstart > send
    return F.struct(
        F.when(minus, probe_len - qend).otherwise(qstart - 1).alias("probe_start"),
        F.when(minus, "-").otherwise("+").alias("strand"),
        (F.least(sstart, send) - 1).alias("match_start"),
    )


def probe_start(pos: Column, length: Column, kind: Column, offset: Column) -> Column:
    """0-based start of a centre, left or right probe around a site."""
    back = (
        F.when(kind == "center", F.floor(length / 2))
        .when(kind == "left", length)
        .otherwise(F.lit(0))
    )
    return (pos - 1 - back + offset).cast("bigint")


def flank_window(start: Column, end: Column, flank: int, size: Column) -> Column:
    """Widen an interval to about ``flank`` bases, clipped to the chromosome."""
    grow = F.floor((F.lit(flank) - (end - start)) / 2).cast("bigint")
    return F.struct(
        F.greatest(F.lit(0).cast("bigint"), start - grow).alias("start"),
        F.least(size, end + grow).alias("end"),
    )


def split_band(size: Column, max_len: float = 500e6, low: float = 0.3) -> Column:
    """Allowed band for the split point of a long chromosome."""
    lo = F.greatest(F.lit(low), 1 - F.lit(max_len) / size) * size
    return F.struct(lo.alias("lo"), (size - lo).alias("hi"))
