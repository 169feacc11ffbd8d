"""Interval operators: range joins, merging, segmentation, coordinate lifts.

Intervals are ``(chrom, start, end)``, 0-based half-open unless noted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.alignment import split_band
from .ordered import BIN, BIN_WIDTH, carry_neighbour, running, with_bin

RANGE_BIN = 10_000
# An interval in more than FINE bins goes by bins COARSE times as wide, so that it
# is copied a bounded number of times whatever its length.
FINE, COARSE = 16, 256


def _at(pos: str | Column, width: int) -> Column:
    return F.floor((F.col(pos) if isinstance(pos, str) else pos) / width).cast("bigint")


def _cell(tier: int, b: Column) -> Column:
    return F.struct(F.lit(tier).alias("t"), b.alias("b"))


def _cells(tier: int, start: str, end: str, width: int) -> Column:
    return F.transform(F.sequence(_at(start, width), _at(end, width)), lambda b: _cell(tier, b))


def _is_long(start: str, end: str, width: int) -> Column:
    return _at(end, width) - _at(start, width) > FINE


def points_in_regions(
    points: DataFrame, regions: DataFrame, width: int = RANGE_BIN,
    pos: str = "pos", start: str = "start", end: str = "end", how: str = "inner",
    long_regions: bool = True,
) -> DataFrame:
    """Every (point, region) with ``start <= pos <= end`` on one chromosome.

    An equi join on (chrom, tier, bin) with a range residual.  A region lies in
    one tier and is repeated once per bin it touches, so no pair is doubled.  A
    point looks into both tiers, or, with ``long_regions=False``, into the fine
    one alone.  ``how='left_semi'`` keeps the points only; the regions are merged
    for it, as a point may then meet just one.
    """
    if how == "left_semi":
        regions = merge_intervals(regions, start=start, end=end)
    fine = _cells(0, start, end, width)
    if long_regions:
        cells = F.when(_is_long(start, end, width), _cells(1, start, end, width * COARSE)).otherwise(fine)
        looks = F.explode(F.array(_cell(0, _at(pos, width)), _cell(1, _at(pos, width * COARSE))))
    else:
        cells, looks = fine, _cell(0, _at(pos, width))
    r = regions.withColumn("_x", F.explode(cells)).withColumns({"_rt": F.col("_x.t"), "_rb": F.col("_x.b")})
    r = r.withColumnRenamed("chrom", "_rc").drop("_x")
    p = points.withColumn("_y", looks).withColumns({"_pt": F.col("_y.t"), "_pb": F.col("_y.b")}).drop("_y")
    cond = (
        (F.col("chrom") == F.col("_rc")) & (F.col("_pt") == F.col("_rt")) & (F.col("_pb") == F.col("_rb"))
        & F.col(pos).between(F.col(start), F.col(end))
    )
    return p.join(r, cond, how).drop("_pt", "_pb", "_rt", "_rb", "_rc")


def _in_cells(df: DataFrame, start: str, end: str, width: int, tag: str, left: bool) -> DataFrame:
    """Interval rows per cell.

    Two short intervals meet in tier 0, in fine bins.  A long one on the left
    meets any on the right in tier 1, a short one on the left meets a long one
    in tier 2, both in coarse bins.  Every pair has one tier, and short pairs
    never meet in a coarse bin.
    """
    wide = width * COARSE
    fine, first, second = (_cells(t, start, end, w) for t, w in ((0, width), (1, wide), (2, wide)))
    is_long = _is_long(start, end, width)
    if left:
        cells = F.when(is_long, first).otherwise(F.concat(fine, second))
    else:
        cells = F.when(is_long, F.concat(first, second)).otherwise(F.concat(fine, first))
    x = df.withColumn("_x", F.explode(cells))
    return x.withColumns({f"_t{tag}": F.col("_x.t"), f"_c{tag}": F.col("_x.b")}).drop("_x")


def _same_cell(ta: str, tb: str) -> Column:
    return (F.col(f"_t{ta}") == F.col(f"_t{tb}")) & (F.col(f"_c{ta}") == F.col(f"_c{tb}"))


def overlap_join(
    a: DataFrame, b: DataFrame, width: int = RANGE_BIN, start: str = "start", end: str = "end",
    closed: bool = True, tags: tuple[str, str] = ("_a", "_b"),
) -> DataFrame:
    """All overlapping pairs, each once, columns suffixed by ``tags``.

    A pair is kept only in the bin that holds the later of its two starts, so
    no de-duplication shuffle is needed.
    """
    ta, tb = tags
    side = lambda df, t: _in_cells(
        df.select(*[F.col(c).alias(f"{c}{t}") for c in df.columns]), start + t, end + t, width, t, t == ta
    )
    left, right = side(a, ta), side(b, tb)
    s1, e1, s2, e2 = (F.col(c) for c in (start + ta, end + ta, start + tb, end + tb))
    touch = ((s1 <= e2) & (s2 <= e1)) if closed else ((s1 < e2) & (s2 < e1))
    later = F.greatest(s1, s2)
    home = F.when(F.col(f"_t{ta}") == 0, _at(later, width)).otherwise(_at(later, width * COARSE))
    cond = (
        (F.col("chrom" + ta) == F.col("chrom" + tb)) & _same_cell(ta, tb) & touch
        & (F.col(f"_c{ta}") == home)
    )
    extra = [f"{c}{t}" for c in ("_t", "_c") for t in tags]
    return left.join(right, cond).drop(*extra)


def count_overlaps(
    regions: DataFrame, features: DataFrame, name: str = "n",
    start: str = "start", end: str = "end", width: int = BIN_WIDTH,
) -> DataFrame:
    """Features overlapping each closed region, zero kept.

    ``#(feature start <= region end) - #(feature end < region start)``: two
    running counts over the merged end points, so no pair is ever built.
    """
    f = features.groupBy("chrom", F.col(start).alias("at")).agg(F.count("*").alias("n_s"))
    g = features.groupBy("chrom", F.col(end).alias("at")).agg(F.count("*").alias("n_e"))
    zero = F.lit(0).cast("bigint")
    # a query at a region end sees starts at the same place; one at a region
    # start sees only the ends strictly before it
    asks = regions.select("chrom", F.col(end).alias("at")).unionByName(
        regions.select("chrom", (F.col(start) - 1).alias("at"))
    ).distinct()
    events = (
        f.select("chrom", "at", F.col("n_s"), zero.alias("n_e"))
        .unionByName(g.select("chrom", "at", zero.alias("n_s"), "n_e"))
        .unionByName(asks.select("chrom", "at", zero.alias("n_s"), zero.alias("n_e")))
        .groupBy("chrom", "at")
        .agg(F.sum("n_s").alias("n_s"), F.sum("n_e").alias("n_e"))
    )
    events = running(
        with_bin(events, "at", width), ["chrom"], "at",
        {"begun": ("sum", F.col("n_s")), "ended": ("sum", F.col("n_e"))},
    )
    begun = events.select("chrom", F.col("at").alias("_at_end"), "begun")
    ended = events.select("chrom", F.col("at").alias("_at_start"), "ended")
    return (
        regions.withColumn("_at_end", F.col(end))
        .withColumn("_at_start", F.col(start) - 1)
        .join(begun, ["chrom", "_at_end"])
        .join(ended, ["chrom", "_at_start"])
        .withColumn(name, F.col("begun") - F.col("ended"))
        .drop("_at_end", "_at_start", "begun", "ended")
    )


def map_overlap(
    a: DataFrame, b: DataFrame, value: str, agg: str = "sum", name: str = "mapped",
    width: int = RANGE_BIN, start: str = "start", end: str = "end", pos: str = "pos", key: str = "id",
    long_regions: bool = True,
) -> DataFrame:
    """Sum or count of ``value`` over the points of ``b`` inside each interval.

    Half-open intervals over 1-based points: ``start < pos <= end``.  The
    points are summed per position first and the pair rows are aggregated
    map-side per distinct interval, before the rows are joined back; ``key`` is
    carried along and need not be unique.
    """
    pts = b.groupBy("chrom", pos).agg(F.sum(value).alias("_v"), F.count(value).alias("_c"))
    iv = a.select("chrom", start, end).distinct().withColumn(start, F.col(start) + 1)
    hit = points_in_regions(pts, iv, width, pos=pos, start=start, end=end, long_regions=long_regions)
    total = hit.groupBy("chrom", start, end).agg(F.sum("_v" if agg == "sum" else "_c").alias(name))
    total = total.withColumn(start, F.col(start) - 1)
    return a.join(total, ["chrom", start, end], "left").withColumn(name, F.coalesce(F.col(name), F.lit(0))).select(*a.columns, name)


def subtract_overlapping(
    a: DataFrame, b: DataFrame, key: str, width: int = RANGE_BIN,
    start: str = "start", end: str = "end",
) -> DataFrame:
    """Intervals of ``a`` that overlap nothing in ``b``; ``key`` need not be unique."""
    left = _in_cells(
        a.select(F.col("chrom").alias("_k1"), F.col(start).alias("_s1"), F.col(end).alias("_e1")).distinct(),
        "_s1", "_e1", width, "1", left=True,
    )
    merged = merge_intervals(b, start=start, end=end)
    right = _in_cells(
        merged.select(F.col("chrom").alias("_k2"), F.col(start).alias("_s2"), F.col(end).alias("_e2")),
        "_s2", "_e2", width, "2", left=False,
    )
    cond = (
        (F.col("_k1") == F.col("_k2")) & _same_cell("1", "2")
        & (F.col("_s1") < F.col("_e2")) & (F.col("_s2") < F.col("_e1"))
    )
    hit = left.join(right, cond, "left_semi").select(F.col("_k1").alias("chrom"), F.col("_s1").alias(start), F.col("_e1").alias(end))
    return a.join(hit, ["chrom", start, end], "left_anti")


def merge_intervals(df: DataFrame, start: str = "start", end: str = "end", width: int = BIN_WIDTH) -> DataFrame:
    """Union of intervals per chromosome; touching intervals (``s <= end``) merge."""
    flat = df.filter(F.col("chrom").isNotNull()).groupBy("chrom", start).agg(F.max(end).alias(end))
    inner = Window.partitionBy("chrom", BIN).orderBy(start)
    before = Window.partitionBy("chrom").orderBy(BIN).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(end).over(inner.rowsBetween(Window.unboundedPreceding, -1))
    flat = with_bin(flat, start, width).withColumn("_reach", reach)
    # a row can only open a block if nothing earlier in its bin reaches it
    maybe = F.col("_reach").isNull() | (F.col(start) > F.col("_reach"))
    flat = flat.withColumn("_maybe", F.when(maybe, F.col(start)))
    edge = flat.groupBy("chrom", BIN).agg(F.max(end).alias("_end"), F.max("_maybe").alias("_open"))
    edge = edge.withColumn("_in", F.max("_end").over(before))
    free = F.col("_in").isNull() | (F.col("_open") > F.col("_in"))
    edge = edge.withColumn("_carry", F.max(F.when(free, F.col("_open"))).over(before))
    out = flat.join(edge.select("chrom", BIN, "_in", "_carry"), ["chrom", BIN])
    opened = F.when(F.col("_in").isNull() | (F.col("_maybe") > F.col("_in")), F.col("_maybe"))
    here = F.max(opened).over(inner.rowsBetween(Window.unboundedPreceding, 0))
    return (
        out.withColumn("_run", F.coalesce(here, "_carry"))
        .groupBy("chrom", "_run").agg(F.max(end).alias(end))
        .select("chrom", F.col("_run").alias(start), end)
    )


def segment_overlaps(
    df: DataFrame, label: str, start: str = "start", end: str = "end", width: int = BIN_WIDTH,
    range_width: int = RANGE_BIN,
) -> DataFrame:
    """Cut at every end point; each covered segment lists its labels."""
    points = (
        df.select("chrom", F.col(start).alias("at"))
        .union(df.select("chrom", F.col(end).alias("at")))
        .distinct()
    )
    seg = carry_neighbour(with_bin(points, "at", width), ["chrom"], "at", ["at"], following=True)
    seg = seg.filter(F.col("next_at").isNotNull()).select(
        "chrom", F.col("at").alias(start), F.col("next_at").alias(end)
    )
    pairs = overlap_join(
        seg, df.select("chrom", start, end, label), range_width, start, end, closed=False
    )
    return pairs.groupBy(
        F.col("chrom_a").alias("chrom"), F.col(start + "_a").alias(start), F.col(end + "_a").alias(end)
    ).agg(F.array_join(F.array_sort(F.collect_list(label + "_b")), ",").alias("labels"))


# --- coordinates split by an offset table -----------------------------------
# map table: chrom, start, end, part (piece name), 0-based half-open


def split_coords(df: DataFrame, pieces: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """BED on whole chromosomes to BED on pieces: an interval goes with the piece its start is in."""
    m = pieces.select(
        "chrom", F.col("start").alias("_ps"), (F.col("end") - 1).alias("_pe"), F.col("part").alias("_part")
    )
    return (
        points_in_regions(df, m, pos=start, start="_ps", end="_pe")
        .withColumn(start, F.col(start) - F.col("_ps"))
        .withColumn(end, F.col(end) - F.col("_ps"))
        .withColumn("chrom", F.col("_part"))
        .drop("_ps", "_pe", "_part")
    )


def restore_coords(df: DataFrame, pieces: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Inverse of :func:`split_coords`; unknown pieces are dropped."""
    m = pieces.select(
        F.col("part").alias("chrom"), F.col("chrom").alias("_whole"), F.col("start").alias("_ps")
    )
    return (
        df.join(m, "chrom")
        .withColumn(start, F.col(start) + F.col("_ps"))
        .withColumn(end, F.col(end) + F.col("_ps"))
        .withColumn("chrom", F.col("_whole"))
        .drop("_ps", "_whole")
    )


def split_features(gtf: DataFrame, pieces: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Features cut at piece borders: a crossing feature gives a row per piece,
    and its second row starts at 0."""
    m = pieces.select(
        "chrom", F.col("start").alias("_ps"), F.col("end").alias("_pe"), F.col("part").alias("_part")
    )
    lo = F.greatest(F.col(start), F.col("_ps")) - F.col("_ps")
    hi = F.least(F.col(end), F.col("_pe")) - F.col("_ps")
    begins = F.col(start).between(F.col("_ps"), F.col("_pe"))
    enters = (F.col(start) < F.col("_ps")) & (F.col(end) > F.col("_ps"))
    return (
        gtf.join(m, "chrom")
        .filter(begins | enters)
        .withColumn("_lo", lo).withColumn("_hi", hi)
        .withColumn("chrom", F.col("_part"))
        .withColumn(start, F.col("_lo")).withColumn(end, F.col("_hi"))
        .drop("_lo", "_hi", "_ps", "_pe", "_part")
    )


def split_positions(sites: DataFrame, pieces: DataFrame, pos: str = "pos") -> DataFrame:
    """1-based positions onto pieces (``start < pos <= end``)."""
    m = pieces.select(
        "chrom", (F.col("start") + 1).alias("_ps"), F.col("end").alias("_pe"), F.col("part").alias("_part")
    )
    return (
        points_in_regions(sites, m, pos=pos, start="_ps", end="_pe")
        .withColumn(pos, F.col(pos) - F.col("_ps") + 1)
        .withColumn("chrom", F.col("_part"))
        .drop("_ps", "_pe", "_part")
    )


# --- tiling and balanced splits ----------------------------------------------


def make_windows(sizes: DataFrame, width: int) -> DataFrame:
    """``[0, L)`` in steps of ``width``; the last window is not clipped."""
    return sizes.select(
        "chrom",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(width).cast("bigint"))).alias("start"),
    ).withColumn("end", F.col("start") + width)


def design_sites(bed: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Design positions of small intervals: three sites, or one per step."""
    span = F.col(end) - F.col(start)
    mid = F.floor((F.col(start) + F.col(end)) / 2).cast("bigint")
    step = F.when(span < 3000, F.lit(300)).otherwise(F.lit(500)).cast("bigint")
    sites = F.when(span < 500, F.array(F.col(start), mid, F.col(end))).otherwise(
        F.sequence(F.col(start), F.col(end) + step - 1, step)
    )
    return bed.withColumn("pos", F.explode(sites))


def split_bed(
    bed: DataFrame, n: int, start: str = "start", end: str = "end", key: str = "id",
    width: int = BIN_WIDTH,
) -> DataFrame:
    """Give each interval a part number so that the parts hold equal lengths.

    The length before an interval, in (chrom, start, end, key) order, is the
    running length in its bin plus bin and chromosome totals.
    """
    span = F.col(end) - F.col(start)
    chroms = bed.groupBy("chrom").agg(F.sum(span).alias("_len"))
    # one row per chromosome
    order = Window.orderBy("chrom").rowsBetween(Window.unboundedPreceding, -1)
    offsets = chroms.select(
        "chrom",
        F.coalesce(F.sum("_len").over(order), F.lit(0)).alias("_off"),
        F.sum("_len").over(Window.partitionBy()).alias("_total"),
    )
    keyed = with_bin(bed, start, width).withColumn("_o", F.struct(start, end, key))
    done = running(keyed, ["chrom"], "_o", {"_cum": ("sum", span)}, exclusive=True)
    part = F.floor((F.col("_cum") + F.col("_off")) * n / F.col("_total"))
    return (
        done.join(offsets, "chrom")
        .withColumn("part", F.least(F.lit(n - 1), part).cast("int"))
        .drop(BIN, "_o", "_cum", "_off", "_total")
    )


def split_genome(sizes: DataFrame, n: int) -> DataFrame:
    """Cut a genome into ``n`` equal pieces, joined within a chromosome.

    Tiles of a tenth of a piece are numbered along the genome; ``sizes`` holds
    one row per chromosome, so the tile table has at most 10 n + chromosomes rows.
    """
    order = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    g = sizes.select(
        "chrom", "size",
        F.coalesce(F.sum("size").over(order), F.lit(0)).alias("_off"),
        F.sum("size").over(Window.partitionBy()).alias("_total"),
    ).withColumn("_tile", F.greatest(F.lit(1), F.ceil(F.col("_total") / (10 * n))).cast("bigint"))
    tiles = g.withColumn(
        "start", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.col("_tile")))
    ).withColumn("end", F.least(F.col("start") + F.col("_tile"), F.col("size")))
    part = F.least(F.lit(n - 1), F.floor((F.col("_off") + F.col("start")) / (F.col("_total") / n))).cast("int")
    return tiles.groupBy("chrom", part.alias("part")).agg(
        F.min("start").alias("start"), F.max("end").alias("end")
    )


def split_points(
    sizes: DataFrame, repeats: DataFrame, genes: DataFrame, max_len: int = 500_000_000, min_repeat: int = 100,
) -> DataFrame:
    """Best cut of each long chromosome: the largest repeat inside the band and
    outside genes; chromosomes below ``max_len`` come back whole.

    ``size`` and ``cut`` columns; ``cut`` is null for a long chromosome with no
    usable repeat, which the caller must treat as an error.
    """
    free = subtract_overlapping(repeats, genes, "id")
    long_ones = sizes.filter(F.col("size") >= max_len).withColumn("_b", split_band(F.col("size"), max_len))
    best = (
        free.join(long_ones, "chrom")
        .filter(
            (F.col("start") >= F.col("_b.lo")) & (F.col("end") <= F.col("_b.hi"))
            & (F.col("repeat_size") >= min_repeat)
        )
        .groupBy("chrom")
        .agg(F.max_by(F.struct("start", "end", "id"), F.struct("repeat_size", -F.col("start"))).alias("_r"))
        .select("chrom", F.floor((F.col("_r.start") + F.col("_r.end")) / 2).cast("bigint").alias("cut"), F.col("_r.id").alias("repeat_id"))
    )
    return sizes.withColumn("is_long", F.col("size") >= max_len).join(best, "chrom", "left")


def split_pieces(points: DataFrame) -> DataFrame:
    """Map table (chrom, start, end, part) from :func:`split_points`."""
    zero = F.lit(0).cast("bigint")
    whole = points.filter(~F.col("is_long")).select("chrom", zero.alias("start"), F.col("size").alias("end"), F.col("chrom").alias("part"))
    left = points.filter("is_long").select("chrom", zero.alias("start"), F.col("cut").alias("end"), F.concat("chrom", F.lit("a")).alias("part"))
    right = points.filter("is_long").select("chrom", F.col("cut").alias("start"), F.col("size").alias("end"), F.concat("chrom", F.lit("b")).alias("part"))
    return whole.unionByName(left).unionByName(right)
