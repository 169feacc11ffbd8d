"""Alignment-hit operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import alignment as A
from ..functions import variant as V
from .calls import count_if
from .ordered import BIN_WIDTH, numbered


def filter_hits(
    hits: DataFrame, min_length: int = 0, min_identity: float | None = None,
    max_mismatch: int | None = None, max_gap: int | None = None,
) -> DataFrame:
    keep = F.col("match_len") >= min_length
    if min_identity is not None:
        keep = keep & (F.col("identity") >= min_identity)
    if max_mismatch is not None:
        keep = keep & (F.col("mismatch") <= max_mismatch)
    if max_gap is not None:
        keep = keep & (F.col("gapopen") <= max_gap)
    return hits.filter(keep)


def hit_summary(
    hits: DataFrame, probe_len: int = 120, max_count: int | None = None, tie: list[str] = []
) -> DataFrame:
    """Hit count, best and second-best hit per id.

    Hits rank by real match length, then mismatches, gaps and ``tie``; the
    two-row limit is pushed below the shuffle, so a repeat-rich id stays cheap.
    """
    real = A.real_match_length(F.col("match_len"), F.col("mismatch"), F.col("gapopen"), F.lit(probe_len))
    x = hits.withColumn("real_len", real)
    w = Window.partitionBy("id").orderBy(F.desc("real_len"), "mismatch", "gapopen", *tie)
    top = x.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= 2)
    at = lambda r, c: F.max(F.when(F.col("_r") == r, F.col(c)))
    two = top.groupBy("id").agg(
        at(1, "real_len").alias("max_length"), at(1, "gapopen").alias("best_gapopen"),
        at(1, "mismatch").alias("best_mismatch"),
        F.coalesce(at(2, "real_len"), F.lit(0)).alias("second_max_length"),
        F.coalesce(at(2, "gapopen"), F.lit(0)).alias("second_gapopen"),
        F.coalesce(at(2, "mismatch"), F.lit(0)).alias("second_mismatch"),
    )
    n = hits.groupBy("id").agg(F.count("*").alias("blast_match"))
    if max_count is not None:
        n = n.filter(F.col("blast_match") <= max_count)
    return n.join(two, "id")


def match_counts(paf: DataFrame, probes: DataFrame, cutoffs: list[int] = [0, 60, 100]) -> DataFrame:
    """Alignments per probe at or above each match cutoff, zero kept."""
    cols = {f"match_{c}": count_if(F.col("matches") >= c) for c in cutoffs}
    n = paf.groupBy("id").agg(*[v.alias(k) for k, v in cols.items()])
    return probes.join(n, "id", "left").fillna(0, list(cols))


def best_hits(hits: DataFrame, key: str, order: list[Column], ties: bool = True) -> DataFrame:
    """First hit(s) per key; ``ties`` keeps all equal ones."""
    w = Window.partitionBy(key).orderBy(*order)
    rank = F.rank() if ties else F.row_number()
    return hits.withColumn("_r", rank.over(w)).filter(F.col("_r") == 1).drop("_r")


def pair_hits(left: DataFrame, right: DataFrame, max_dist: int = 1000) -> DataFrame:
    """Left/right primer hits on opposite strands closer than ``max_dist``.

    Joins on (name, chrom, distance bin): a left hit looks into its own bin and
    the two beside it, so far pairs of a repeat-rich primer are never built.
    """
    def side(df: DataFrame, tag: str) -> DataFrame:
        s, e = F.col("start"), F.col("end")
        df = df.withColumns({"pos": A.hit_center(s, e), "strand": A.hit_strand(s, e)})
        return df.select("name", "chrom", *[F.col(c).alias(f"{tag}_{c}") for c in df.columns if c not in ("name", "chrom")])

    l, r = side(left, "left"), side(right, "right")
    lb = F.floor(F.col("left_pos") / max_dist)
    l = l.withColumn("_b", F.explode(F.array(lb - 1, lb, lb + 1)))
    r = r.withColumn("_b", F.floor(F.col("right_pos") / max_dist))
    dist = F.abs(F.col("left_pos") - F.col("right_pos"))
    j = l.join(r, ["name", "chrom", "_b"]).withColumn("distance", dist)
    j = j.filter((F.col("left_strand") != F.col("right_strand")) & (F.col("distance") < max_dist))
    b = A.pair_bounds(*[F.col(c) for c in ("left_start", "left_end", "right_start", "right_end")])
    return (
        j.withColumn("_p", b)
        .withColumns({"ssr_left": F.col("_p.start"), "ssr_right": F.col("_p.end")})
        .withColumn("ssr_length", F.col("ssr_right") - F.col("ssr_left"))
        .drop("_b", "_p")
    )


def number_copies(df: DataFrame, key: str, order: str, width: int = BIN_WIDTH) -> DataFrame:
    """``id`` with ``-2, -3, …`` for the repeats of a key, in ``order``; a row without an order keeps its key."""
    n = numbered(df, [key], order, "_n", width=width)
    return n.withColumn(
        "id", F.when(F.coalesce("_n", F.lit(1)) == 1, F.col(key)).otherwise(F.concat_ws("-", F.col(key), F.col("_n")))
    ).drop("_n")


def frequent_and_best(hits: DataFrame, max_mismatch: int = 5) -> DataFrame:
    """Regions hit at least twice plus the first hit, per source id."""
    ok = hits.filter(F.col("mismatch") <= max_mismatch)
    regions = ok.groupBy("raw_id", "chrom", "start").agg(
        F.count("*").alias("n"), F.min("mismatch").alias("mismatch")
    )
    row = F.struct("mismatch", "chrom", "start", "n")
    best = regions.groupBy("raw_id").agg(F.min(row).alias("_b")).select(
        "raw_id", "_b.chrom", "_b.start", "_b.n", "_b.mismatch"
    )
    return regions.filter(F.col("n") >= 2).unionByName(best).distinct()


def lift_sites(paf: DataFrame, offsets: DataFrame, min_ratio: float = 0.0) -> DataFrame:
    """Id map of probe sites placed on a new genome by their best alignment.

    ``paf``: id, probe_length, probe_start, strand, chrom, match_start,
    match_length, n_mismatch, mapq, cigar.  ``offsets``: id, offset_start,
    offset_end.
    """
    order = [F.desc("match_length"), F.asc("n_mismatch"), F.asc("chrom"), F.asc("match_start")]
    best = best_hits(paf, "id", order, ties=False)
    best = best.filter(F.col("match_length") / F.col("probe_length") > min_ratio).join(offsets, "id")
    pos = A.lift_pos(*[F.col(c) for c in ("cigar", "strand", "offset_start", "offset_end", "match_start", "probe_start")])
    return (
        best.withColumn("pos", pos.cast("bigint"))
        .filter(F.col("pos").isNotNull())
        .select("id", V.site_id(F.col("chrom"), F.col("pos")).alias("new_id"), "chrom", "pos", "mapq", "strand")
    )


def relocate(anno: DataFrame, idmap: DataFrame, by_position: bool = False) -> DataFrame:
    """Annotation rows moved to their new ids, probe windows re-centred.

    ``idmap`` is ``id, new_id``.  With ``by_position`` its ids are read as sites and
    meet the annotation's ``chrom`` and ``pos``, so the annotation may have any ids or
    none.  Rows without a new place are left out.
    """
    chrom, pos = V.split_site_id(F.col("new_id"))
    if by_position:
        old_chrom, old_pos = V.split_site_id(F.col("id"))
        j = idmap.select(old_chrom.alias("chrom"), old_pos.alias("pos"), "new_id").join(anno, ["chrom", "pos"])
    else:
        j = idmap.select("id", "new_id").join(anno.drop("chrom", "pos"), "id")
    j = j.withColumns({"chrom": chrom, "pos": pos})
    length = F.col("probe_end") - F.col("probe_start")
    start = A.probe_start(F.col("pos"), length, F.col("probe_type"), F.col("offset"))
    return (
        j.withColumn("_len", length).withColumn("probe_start", start)
        .withColumn("probe_end", F.col("probe_start") + F.col("_len")).drop("_len", "new_id")
    )


def attach_tags(paf: DataFrame) -> DataFrame:
    """CIGAR and mismatch tags of raw PAF lines, read in the same scan."""
    return paf.withColumns(
        {
            "cigar": F.regexp_extract("tags", r"cg:Z:(\w+)", 1),
            "n_mismatch": F.regexp_extract("tags", r"NM:i:(\d+)", 1).try_cast("int"),
        }
    )
