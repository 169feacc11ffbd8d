"""Probe design: genome access, flanks, tiles, scores and site choice.

A genome is a chunk table ``chrom, chunk_no, seq`` of fixed-size pieces, so a
fetch touches only the chunks it needs, and no chunk table row holds a chromosome.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import alignment as A
from ..functions import sequence as S
from .calls import count_if
from .intervals import RANGE_BIN, points_in_regions

CHUNK = 10_000
#: Tile pieces that are put together at once where a record comes in pieces.
SPAN = 40


def _pieces(seq: Column | str, n: int) -> Column:
    """Sequence cut into pieces of ``n`` bases in one pass.

    ``substr`` walks a string from its start, so cutting by offsets would take
    quadratic time on a long sequence.
    """
    return F.regexp_extract_all(seq, F.lit(".{1,%d}" % n), F.lit(0))


def genome_chunks(records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Sequence records ``seq_id, seq`` to a chunk table."""
    return records.filter(F.length("seq") > 0).select(
        F.col("seq_id").alias("chrom"), F.posexplode(_pieces("seq", chunk)).alias("chunk_no", "seq")
    ).withColumn("chunk_no", F.col("chunk_no").cast("bigint"))


def spans(pieces: DataFrame, step: int, reach: int = 0) -> DataFrame:
    """Bases of every stretch of ``step`` bases and the ``reach`` behind it, from pieces of records.

    ``pieces`` has ``file, record, seq_id, start, seq``, as ``read_fasta_pieces`` returns them;
    the result has ``file, record, seq_id, no, seq``.  A piece goes to the stretches it touches,
    and a stretch is put together from the few pieces that touch it.
    """
    keys = ["file", "record", "seq_id"]
    n = F.length("seq").cast("bigint")
    at, lo = F.col("start"), F.col("no") * step
    touched = F.sequence(F.greatest(F.floor((at - reach) / step), F.lit(0).cast("bigint")), F.floor((at + n - 1) / step))
    x = pieces.filter(n > 0).select(*keys, "start", "seq", F.explode(touched).alias("no"))
    first = F.greatest(lo - at, F.lit(0))
    last = F.least(lo + step + reach - at, n)
    part = F.struct("start", F.substr("seq", (first + 1).cast("int"), (last - first).cast("int")).alias("s"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["s"]), "")
    return x.groupBy(*keys, "no").agg(whole.alias("seq"))


def genome_from_pieces(pieces: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Pieces of records to a chunk table; no row holds more than a chunk."""
    return spans(pieces, chunk).select(F.col("seq_id").alias("chrom"), F.col("no").alias("chunk_no"), "seq")


def chrom_sizes(genome: DataFrame) -> DataFrame:
    return genome.groupBy("chrom").agg(F.sum(F.length("seq")).alias("size"))


def fetch(
    regions: DataFrame, genome: DataFrame, chunk: int = CHUNK, start: str = "start",
    end: str = "end", name: str = "seq", keys: list[str] | None = None,
) -> DataFrame:
    """0-based half-open sequence of each region, clipped to its chromosome.

    Distinct regions meet the chunks they touch by an equi join on (chrom, chunk); the
    pieces of one region are put together in chunk order and joined back to the rows, so
    repeated rows stay.  A region that touches no chunk, as on an absent chromosome or
    past the end, gets null.
    """
    keys = keys or regions.columns
    lo = F.greatest(F.col(start), F.lit(0).cast("bigint"))
    rows = regions.withColumns({"_lo": lo, "_hi": F.greatest(F.col(end), lo)})
    r = rows.select("chrom", "_lo", "_hi").distinct()
    wanted = F.sequence(F.floor(F.col("_lo") / chunk), F.floor(F.greatest(F.col("_hi") - 1, F.col("_lo")) / chunk))
    r = r.withColumn("chunk_no", F.explode(wanted))
    g = genome.select("chrom", "chunk_no", F.col("seq").alias("_piece"))
    first = F.greatest(F.col("_lo") - F.col("chunk_no") * chunk, F.lit(0))
    last = F.least(F.col("_hi") - F.col("chunk_no") * chunk, F.lit(chunk))
    piece = F.substr("_piece", (first + 1).cast("int"), F.greatest(last - first, F.lit(0)).cast("int"))
    j = r.join(g, ["chrom", "chunk_no"]).withColumn("_p", F.struct("chunk_no", piece.alias("s")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("_p")), lambda x: x["s"]), "")
    found = j.groupBy("chrom", "_lo", "_hi").agg(joined.alias("_found"))
    return rows.join(found, ["chrom", "_lo", "_hi"], "left").select(*keys, F.col("_found").alias(name))


def check_ref(sites: DataFrame, genome: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Sites whose reference allele is not what the genome holds."""
    r = sites.withColumns(
        {"_s": (F.col("pos") - 1).cast("bigint"), "_e": (F.col("pos") - 1 + F.length("ref")).cast("bigint")}
    )
    out = fetch(r, genome, chunk, "_s", "_e", "check_ref")
    return out.filter(F.upper("ref") != F.upper(F.coalesce("check_ref", F.lit("")))).drop("_s", "_e")


def flank_markers(sites: DataFrame, genome: DataFrame, n: int = 100, chunk: int = CHUNK) -> DataFrame:
    """``left[REF/ALT]right`` with ``n`` bases on each side where there are any."""
    keys = sites.columns
    win = F.struct(
        F.greatest(F.col("pos") - 1 - n, F.lit(0)).cast("bigint").alias("s"),
        (F.col("pos") - 1 + F.length("ref") + n).cast("bigint").alias("e"),
    )
    r = sites.withColumn("_w", win).withColumns({"_s": F.col("_w.s"), "_e": F.col("_w.e")}).drop("_w")
    f = fetch(r, genome, chunk, "_s", "_e", "_seq").fillna("", ["_seq"])
    left = (F.col("pos") - 1 - F.col("_s")).cast("int")
    marker = S.flank_text(
        F.substr("_seq", F.lit(1), left), F.col("ref"), F.col("alt"),
        F.substr("_seq", left + F.length("ref") + 1),
    )
    return f.select(*keys, marker.alias("sequence"))


def probe_sequences(probes: DataFrame, genome: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Probe windows with their marker; a window outside the genome gives Ns."""
    keys = probes.columns
    f = fetch(probes, genome, chunk, "probe_start", "probe_end", "_seq", keys)
    known = S.probe_with_marker(F.col("_seq"), F.col("pos"), F.col("probe_start"), F.col("alleles"))
    lost = S.unknown_sequence(F.col("probe_end") - F.col("probe_start"))
    return f.select(*keys, F.when(F.col("_seq").isNull(), lost).otherwise(known).alias("sequence"))


def probe_references(markers: DataFrame) -> DataFrame:
    """Reference of each probe from its marker records ``id, line_no, seq``.

    Ids end in ``_<marker position>``.  The first record gives the sequence and
    every later one sets its own reference base in it.
    """
    pat = "^(.*)_([0-9]+)$"
    ref = S.probe_reference(F.col("seq"))["ref_seq"]
    base = F.substring(F.regexp_extract("seq", S.MARKER, 1), 1, 1)
    m = markers.select(
        F.regexp_extract("id", pat, 1).alias("probe_id"),
        F.struct("line_no", F.regexp_extract("id", pat, 2).cast("int").alias("at"), base.alias("base"), ref.alias("seq")).alias("m"),
    )
    # a probe has at most as many markers as bases
    g = m.groupBy("probe_id").agg(F.array_sort(F.collect_list("m")).alias("ms"))
    put = lambda acc, x: F.concat(
        F.substr(acc, F.lit(1), x["at"] - 1), x["base"], F.substr(acc, x["at"] + 1)
    )
    rest = F.slice("ms", F.lit(2), F.greatest(F.size("ms") - 1, F.lit(0)))
    return g.select("probe_id", F.aggregate(rest, F.col("ms")[0]["seq"], put).alias("ref_seq"))


def centre_probes(
    sites: DataFrame, genome: DataFrame, length: int = 120, gc_bias: float = 0.15,
    max_n: int = 10, chunk: int = CHUNK,
) -> DataFrame:
    """Centre probe per site, moved by tens when it is rich in N or off in GC.

    A moved probe takes the fewest Ns, then the lowest bias, then the nearest
    shift.  All shifts are cut from one fetched window per site.
    """
    half = length // 2
    shifts = [0] + [s for i in range(10, length // 4, 10) for s in (-i, i)]
    reach = max(abs(s) for s in shifts)
    keys = sites.columns
    at = F.col("pos") - 1
    r = sites.withColumns(
        {"_s": (at - half - reach).cast("bigint"), "_e": (at + half + reach).cast("bigint")}
    )
    f = fetch(r, genome, chunk, "_s", "_e", "_seq").fillna("", ["_seq"])
    # the window may be clipped on the left
    base = at - half - F.greatest(F.col("_s"), F.lit(0))

    def cut(shift: int) -> Column:
        i = base + shift
        seq = F.when(i >= 0, F.substr("_seq", (i + 1).cast("int"), F.lit(length))).otherwise(F.lit(""))
        bias = S.gc_bias(seq)
        return F.struct(
            S.n_count(seq).alias("n"), bias.alias("bias"),
            F.lit(shifts.index(shift)).alias("rank"), F.lit(shift).alias("shift"), seq.alias("sequence"),
        )

    options = F.array_sort(F.array(*[cut(s) for s in shifts[1:]]))
    centre = cut(0)
    good = (centre["n"] <= max_n) & (centre["bias"] <= gc_bias)
    return f.withColumn("_p", F.when(good, centre).otherwise(options[0])).select(
        *keys, F.col("_p.shift").alias("shift"), F.col("_p.sequence").alias("sequence"),
        F.col("_p.n").alias("n_count"), S.gc_fraction(F.col("_p.sequence")).alias("gc"),
    )


def side_probes(sites: DataFrame, genome: DataFrame, length: int = 120, chunk: int = CHUNK) -> DataFrame:
    """Left and right probes of indel sites; empty where the genome has no base on that side."""
    at = F.col("pos") - 1
    sides = F.array(
        F.struct(F.lit("left").alias("kind"), F.greatest(at - length, F.lit(0)).cast("bigint").alias("s"), at.cast("bigint").alias("e")),
        F.struct(F.lit("right").alias("kind"), (at + 1).cast("bigint").alias("s"), (at + 1 + length).cast("bigint").alias("e")),
    )
    r = (
        sites.filter((F.length("ref") > 1) | F.exists(F.split("alt", ","), lambda a: F.length(a) > 1))
        .select("*", F.explode(sides).alias("_x"))
        .select("*", F.col("_x.kind").alias("sequence_type"), F.col("_x.s").alias("_s"), F.col("_x.e").alias("_e"))
        .drop("_x")
    )
    return fetch(r, genome, chunk, "_s", "_e", "sequence").fillna("", ["sequence"]).drop("_s", "_e")


# --- tiles -------------------------------------------------------------------


def _tile_pieces(records: DataFrame, width: int) -> DataFrame:
    """Pieces ``seq_id, no, s, last``: piece ``no`` holds the ``last`` tiles that
    start in it and takes along the bases they reach into the next one.

    ``records`` has whole records (``seq_id, seq``) or pieces of them (``read_fasta_pieces``)."""
    # short pieces: cutting a tile walks the piece from its start
    step = 2 * width
    if "start" in records.columns:
        x = spans(records, SPAN * step, width - 1).select("seq_id", (F.col("no") * SPAN).cast("int").alias("_first"), _pieces("seq", step).alias("_p"))
    else:
        x = records.filter(F.length("seq") >= width).select("seq_id", F.lit(0).alias("_first"), _pieces("seq", step).alias("_p"))
    part = F.explode(
        F.transform(
            "_p",
            lambda p, i: F.struct(
                (i + F.col("_first")).alias("no"), i.alias("i"),
                F.concat(p, F.substring(F.coalesce(F.get("_p", i + 1), F.lit("")), 1, width - 1)).alias("s"),
                F.length(p).alias("own"),
            ),
        )
    )
    x = x.select("seq_id", "_first", part.alias("x")).select("seq_id", "x.*")
    if "start" in records.columns:
        x = x.filter(F.col("i") < SPAN)  # the bases behind a stretch are the next one's
    x = x.drop("i").withColumn("last", F.least(F.col("own"), F.length("s") - width + 1)).drop("own")
    # the pieces, not their many tiles, are spread over the tasks, so that one
    # long sequence does not keep a single task busy
    return x.filter(F.col("last") >= 1).repartition("seq_id", "no")


def tile_sequence(records: DataFrame, width: int = 120) -> DataFrame:
    """Every window of ``width`` bases, step 1; 1-based ``tile``.  Takes records or their pieces."""
    x = _tile_pieces(records, width).select("seq_id", "no", "s", F.explode(F.sequence(F.lit(1), "last")).alias("i"))
    return x.select(
        "seq_id", (F.col("no") * (2 * width) + F.col("i")).alias("tile"),
        F.substr("s", F.col("i"), F.lit(width)).alias("tile_seq"),
    )


def _tile_ends(width: int):
    """The function over pieces, nested so that workers need not import this package."""

    def ends(batches):
        """Least and greatest tile of each piece; texts compare by code point, as their bytes do."""
        import pyarrow as pa

        for b in batches:
            least, greatest = [], []
            for s, n in zip(b.column("s").to_pylist(), b.column("n").to_pylist()):
                tiles = [s[k : k + width] for k in range(n)]
                least.append(min(tiles))
                greatest.append(max(tiles))
            cols = [b.column(c) for c in ("seq_id", "n", "starts")] + [pa.array(t, b.column("s").type) for t in (least, greatest)]
            yield pa.record_batch(cols, ["seq_id", "n", "starts", "least", "greatest"])

    return ends


def tile_summary(records: DataFrame, width: int = 120) -> DataFrame:
    """``seq_id, tiles, least_tile, greatest_tile, starts`` over the rows of :func:`tile_sequence`.

    The tiles of a piece are looked through where they are cut: no row is written for a
    tile, and only one row of a piece is sorted by its record.
    """
    n = F.col("last").cast("bigint")
    x = _tile_pieces(records, width).select("seq_id", n.alias("n"), (n * F.col("no") * (2 * width) + F.expr("last * (last + 1) div 2")).alias("starts"), "s")
    kind = records.schema["seq_id"].dataType.simpleString()
    x = x.mapInArrow(_tile_ends(width), f"seq_id {kind}, n bigint, starts bigint, least string, greatest string")
    return x.groupBy("seq_id").agg(
        F.sum("n").alias("tiles"), F.min("least").alias("least_tile"), F.max("greatest").alias("greatest_tile"), F.sum("starts").alias("starts")
    )


def gc_percent(seq: Column) -> Column:
    return 100 * S.gc_count(seq) / F.length(seq)


def _gc_slider(width: int):
    """The function over pieces, nested so that workers need not import this package."""

    def best(batches):
        """``d``: twice the distance from half the width, ``i``: the first tile of a piece that has the least."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        is_gc, rows = np.zeros(256, np.int64), 2000
        is_gc[list(b"GCSgcs")] = 1
        for whole in batches:
            for b in (whole.slice(k, rows) for k in range(0, whole.num_rows, rows)):
                texts, last = b.column("s").to_pylist(), b.column("last").to_numpy()
                at = np.concatenate([[0], np.cumsum(pc.utf8_length(b.column("s")).to_numpy())])
                text = "".join(texts)
                if text.isascii():
                    own = is_gc[np.frombuffer(text.encode(), np.uint8)]
                else:
                    own = np.fromiter((c.upper() in ("G", "C", "S") for c in text), np.int64, len(text))
                upto = np.concatenate([[0], np.cumsum(own)])
                n = len(text) - width + 1
                far = np.full(len(text), 1 << 20)
                far[:n] = np.abs(2 * (upto[width:] - upto[:n]) - width)
                first = at[:-1]
                place = np.arange(len(text)) - np.repeat(first, np.diff(at))
                far[place >= np.repeat(last, np.diff(at))] = 1 << 20
                key = np.minimum.reduceat((far << 32) + place, first)
                d, i = key >> 32, key & 0xFFFFFFFF
                tiles = [t[k : k + width] for t, k in zip(texts, i.tolist())]
                cols = [b.column("seq_id"), b.column("no"), pa.array(d, pa.int32()), pa.array(i + 1, pa.int32()), pa.array(tiles, b.column("s").type)]
                yield pa.record_batch(cols, ["seq_id", "no", "d", "i", "tile_seq"])

    return best


def best_gc_tile(records: DataFrame, width: int = 120) -> DataFrame:
    """Tile nearest to 50 % GC, the first of equals.

    Each piece slides over its tiles with running GC counts, so tiles are never written
    out as rows; a piece gives its best tile.
    """
    x = _tile_pieces(records, width).select("seq_id", "no", "s", "last")
    kind = records.schema["seq_id"].dataType.simpleString()
    x = x.mapInArrow(_gc_slider(width), f"seq_id {kind}, no int, d int, i int, tile_seq string")
    tile = F.struct((F.col("no") * (2 * width) + F.col("i")).alias("tile"), "tile_seq")
    best = x.groupBy("seq_id").agg(F.min_by(tile, F.struct("d", "no")).alias("b"))
    return best.select("seq_id", "b.*").withColumn("gc", gc_percent(F.col("tile_seq")))


def select_tiles(records: DataFrame, width: int = 120, long: int = 200) -> DataFrame:
    """Short sequences whole, middle ones by best GC, long ones first and last tile."""
    n = F.length("seq")
    short = records.filter(n.between(1, width)).select(
        "seq_id", F.lit(1).alias("tile"), F.col("seq").alias("tile_seq"), gc_percent(F.col("seq")).alias("gc")
    )
    middle = best_gc_tile(records.filter((n > width) & (n <= long)), width)
    ends = F.explode(F.array(F.lit(1), n - width + 1)).alias("tile")
    big = (
        records.filter(n > long).select("seq_id", "seq", ends)
        .select("seq_id", "tile", F.substr("seq", F.col("tile"), F.lit(width)).alias("tile_seq"))
        .withColumn("gc", gc_percent(F.col("tile_seq")))
    )
    return short.unionByName(middle).unionByName(big)


# --- scores ------------------------------------------------------------------


def _allele_terms(alleles: Column) -> tuple[Column, Column]:
    n = F.size(F.split(alleles, ","))
    return F.greatest(n, F.lit(2)) - 2, F.length(alleles) > 3


def _maf_penalty(maf: Column | None) -> Column:
    if maf is None:
        return F.lit(0)
    return F.when(maf < 0.1, -150).when(maf < 0.2, -50).otherwise(0)


def simple_score(
    gc: Column, alleles: Column, score: Column, match_0: Column, maf: Column | None = None
) -> Column:
    """First-generation score: GC band, indel, MAF and match count."""
    extra, indel = _allele_terms(alleles)
    return (
        F.when(gc.between(0.35, 0.65), 100).otherwise(0)
        + F.when(indel, -5).otherwise(0) + _maf_penalty(maf)
        - 10 * (match_0 - 1) + 1000 * (4 - score) - extra * 0.1
    )


def side_score(gc: Column, alleles: Column, score: Column, match_0: Column) -> Column:
    return simple_score(gc, alleles, score, match_0)


def probe_score(
    gc: Column, alleles: Column, score: Column, match_0: Column, match_60: Column,
    match_100: Column, maf: Column | None = None, gc_bias: float = 0.15, gc_score: int = 1000,
    mapping_score: int = 500, extreme: float = 0.1, symmetric: bool = True,
) -> Column:
    """Second-generation score, cut to an integer.

    ``symmetric=False`` keeps the weaker high-GC penalty of the older tables.
    """
    low, high = 0.5 - gc_bias, 0.5 + gc_bias
    off = F.when(gc < 0.5, F.lit(low) - gc).otherwise(gc - high)
    near = off if symmetric else F.when(gc < 0.5, off).otherwise(off * 0.1)
    # near: a falling parabola; beyond the extreme limit: a growing penalty
    far = -F.pow((off - extreme) / 0.1, F.lit(2.0)) * gc_score
    close = (1 - F.pow(near / 0.1, F.lit(2.0))) * gc_score
    gc_term = F.when(gc.between(low, high), F.lit(float(gc_score))).when(off > extreme, far).otherwise(close)
    extra, indel = _allele_terms(alleles)
    mapping = mapping_score * (
        F.abs(match_0 - 1) + F.abs(match_60 - 1) * 1.5 + F.pow(F.abs(match_100 - 1), F.lit(2.0))
    )
    total = 10 * (4 - score) + gc_term + F.when(indel, -50).otherwise(0) + _maf_penalty(maf) - mapping - extra * 5
    return total.cast("bigint")


# --- choice ------------------------------------------------------------------


def pick_per_region(
    df: DataFrame, n: int, high: int = 0, tier: str = "score", score: str = "score2",
    key: str = "id", region: list[str] = ["chrom", "start", "end"],
) -> DataFrame:
    """All rows of the high tier, filled up to ``n`` with the best of the rest."""
    top = F.col(tier) <= high
    count = df.groupBy(*region).agg(count_if(top).alias("_h"))
    w = Window.partitionBy(*region).orderBy(F.desc(score), key)
    rest = df.filter(~top).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n)
    rest = rest.join(count, region).filter(F.col("_r") <= n - F.col("_h")).drop("_r", "_h")
    return df.filter(top).unionByName(rest)


def best_side_probe(df: DataFrame, score: str = "score2", keys: list[str] = ["chrom", "pos"]) -> DataFrame:
    """Best-scored row per site."""
    return drop_dups(df, keys, [F.desc(score), F.asc("id")])


def drop_dups(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per key under a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1).drop("_r")


def auto_fill(selected: DataFrame, candidates: DataFrame, n: int, score: str = "score2", key: str = "id") -> DataFrame:
    """Fill a selection up to ``n`` rows with the best left-out candidates.

    The fill is a top-``n`` (``n`` is the wanted panel size), then cut to the
    number still missing.
    """
    have = selected.agg(F.count("*")).scalar()
    left = candidates.join(selected.select(key), key, "left_anti")
    best = left.orderBy(F.desc(score), key).limit(n)
    # at most n rows from here on
    numbered = best.withColumn("_r", F.row_number().over(Window.orderBy(F.desc(score), key)))
    add = numbered.filter(F.col("_r") <= n - have).drop("_r")
    return selected.unionByName(add.select(*selected.columns))


def sites_per_region(
    regions: DataFrame, sites: DataFrame, n: int = 1, max_bins: int = 100, bin_size: int = 200,
    width: int = RANGE_BIN,
) -> DataFrame:
    """Best ``n`` sites per left-closed bin of each region, labels joined per site.

    A region is cut into bins of ``bin_size``, or into ``max_bins`` if that is
    not enough; positions past the last full bin are dropped.
    """
    span = F.col("end") - F.col("start")
    size = F.when(bin_size * max_bins >= span, F.lit(bin_size)).otherwise(F.floor(span / max_bins))
    r = regions.select("chrom", "start", "end", F.col("id").alias("region"))
    j = points_in_regions(sites, r, width).filter(F.col("pos") > F.col("start"))
    j = j.withColumn("_size", size.cast("bigint")).withColumn("_bin", F.floor((F.col("pos") - F.col("start")) / F.col("_size")))
    j = j.filter(F.col("_bin") < F.floor(span / F.col("_size")))
    w = Window.partitionBy("region", "_bin").orderBy(
        F.desc("sequence_score"), F.desc("region_score"), F.desc("maf"), "id"
    )
    best = j.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n)
    return best.groupBy(*sites.columns).agg(
        F.array_join(F.array_sort(F.collect_set("region")), ",").alias("regions")
    )


def remove_add(df: DataFrame, remove: DataFrame, add: DataFrame, key: str = "id") -> DataFrame:
    """Drop listed ids and append the additions."""
    return df.join(remove.select(key), key, "left_anti").select(*df.columns).unionByName(add.select(*df.columns))


def panel_targets(design: DataFrame, sizes: DataFrame, flank: int = 200) -> DataFrame:
    """Flanked calling interval of each probe."""
    w = A.flank_window(F.col("probe_start"), F.col("probe_end"), flank, F.col("size"))
    return design.join(sizes, "chrom").withColumn("_w", w).select(
        "id", "chrom", F.col("_w.start").alias("start"), F.col("_w.end").alias("end")
    )
