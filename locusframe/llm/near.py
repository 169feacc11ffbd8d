"""Near-duplicates by fast similarity sketching, banding and exact verification.

A sketch has ``coords`` places.  In each of the first ``coords`` rounds every
shingle falls into one place by its hash and the smallest value takes a place
that is still empty; in the next ``coords`` rounds the places are served one by
one.  So each place fills, for any set, and the share of equal places is
concentrated about the similarity as with independent samples.

Four places make a band; at a similarity of 0.85 two texts share none of the 32
bands with a probability of 6e-11.  Texts with equal sets are one class from the
start.  No band emits all its pairs:

1. Members are compared with the band's smallest one, its leader; a second round
   takes as leader the smallest member outside the first one's component.
2. Where members of several components are left, take the difference of each
   member's set to the leader's.  Two linked members of which one is not linked to
   the leader must share some of it: with sets x and y and differences X and Y, at
   least (|X| + |Y| - c(|x| + |y|)) / 2 elements, where c = (1 - t) / (1 + t) for a
   threshold t.  So each member hands out only the first elements of its difference,
   in an order that has common ones last, and two members meet only where an element
   is among the first of both.  Members that merely resemble the leader rarely meet.
   Any order gives all links, so only a leader's ``OFTEN`` most common elements are put
   last, and an element whose members are all in one component is left out.

Pairs whose sketches agree in less than 0.6 of the places expected at the threshold
are no links (over nine standard deviations away); the others are confirmed on full
shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ident, lean, raw, slices, stored
from .graph import components
from .words import U, Words, mix, ranges, spread

COORDS, ROWS = 128, 4
#: Elements of a leader that are put last, at most.
OFTEN = 1024
_EMPTY = U(0xFFFFFFFFFFFFFFFF)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and where each text begins.

    A text of fewer than ``k`` words has one: the whole sequence.
    """
    grams, starts = words.grams(k)
    cut = np.searchsorted(starts, words.first)
    short = np.flatnonzero((words.count > 0) & (words.count < k))
    whole = ranges(words.hash, words.first[short], words.first[short + 1], 0xE7037ED1A0B428DB) ^ mix(words.count[short].astype(U))
    alone = dict(zip(short.tolist(), whole))
    sets = [np.array([alone[i]], U) if i in alone else np.unique(grams[cut[i] : cut[i + 1]]) for i in range(len(words.count))]
    return np.concatenate([*sets, np.zeros(0, U)]), np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64)


def sketch(items: np.ndarray, at: np.ndarray, coords: int = COORDS) -> np.ndarray:
    """Fast similarity sketches of sets; rows of empty sets stay empty."""
    sizes = np.diff(at)
    out = np.full((len(sizes), coords), _EMPTY)
    active = np.flatnonzero(sizes > 0)
    for k in range(2 * coords):
        if not len(active):
            break
        where = spread(at[active], sizes[active])
        owner = np.repeat(np.arange(len(active)), sizes[active])
        values = mix(items[where] + mix(np.array([k + 1], U)))
        fresh = np.full((len(active), coords), _EMPTY)
        place = (values % U(coords)).astype(np.int64) if k < coords else np.full(len(values), k - coords)
        np.minimum.at(fresh.reshape(-1), owner * coords + place, values)
        held = out[active]
        held = np.where(held == _EMPTY, fresh, held)
        out[active] = held
        active = active[(held == _EMPTY).any(axis=1)]
    return out


def sketch_texts(k: int):
    """Per text: size and hash of its shingle set, band names and a byte of each sketch place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            items, at = shingles(Words(*raw(b.column("text")), fold=True), k)
            sums = [np.concatenate([np.zeros(1, U), np.cumsum(mix(items + U(s)), dtype=U)]) for s in (3, 5)]
            low, high = ((x[at[1:]] - x[at[:-1]]).view(np.int64) for x in sums)
            full = sketch(items, at)
            bands = full.reshape(len(full), -1, ROWS)
            names = mix(np.arange(bands.shape[1], dtype=U) + U(1))
            for j in range(ROWS):
                names = mix(names + bands[:, :, j])
            some = np.diff(at) > 0
            width = names.shape[1]
            cuts = np.concatenate([[0], np.cumsum(np.where(some, width, 0))])
            yield pa.record_batch(
                [
                    b.column("id"), b.column("version"), pa.array(np.diff(at)), pa.array(low), pa.array(high),
                    pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(names[some].reshape(-1).view(np.int64))),
                    pa.array([x.tobytes() for x in (full >> U(48)).astype(np.uint8)], pa.binary()),
                ],
                ["id", "version", "n_shingles", "low", "high", "bands", "places"],
            )

    return run


_SKETCHED = "id bigint, version bigint, n_shingles bigint, low bigint, high bigint, bands array<bigint>, places binary"


def agreeing(percent: int):
    """Pairs whose sketches agree often enough."""
    least = int(0.6 * percent / 100 * COORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (raw(b.column(c))[0].reshape(-1, COORDS) for c in ("places_a", "places_b"))
            ok = (x == y).sum(axis=1) >= least
            yield b.select(["a", "b"]).filter(pa.array(ok))

    return run


def confirm(k: int, percent: int):
    """Pairs that are similar by their full shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text_a", 1 << 20):
            (x, fx), (y, fy) = (shingles(Words(*raw(b.column(c)), fold=True), k) for c in ("text_a", "text_b"))
            ok = []
            for i in range(b.num_rows):
                p, q = x[fx[i] : fx[i + 1]], y[fy[i] : fy[i + 1]]
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(100 * both >= percent * (len(p) + len(q) - both) and both > 0)
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _gaps(b: pa.RecordBatch, k: int) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """Of each pair: its row, the sizes of both sets, and what only one of them has."""
    (x, fx), (y, fy) = (shingles(Words(*raw(b.column(t)), fold=True), k) for t in ("text_a", "text_b"))
    for i in range(b.num_rows):
        p, q = x[fx[i] : fx[i + 1]], y[fy[i] : fy[i + 1]]
        yield i, len(p), len(q), np.setxor1d(p, q, assume_unique=True)


def gap_items(k: int):
    """All elements of the differences to the leaders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text_a", 1 << 20):
            found = list(_gaps(b, k))
            row = np.repeat([i for i, *_ in found], [len(g) for *_, g in found])
            item = np.concatenate([g for *_, g in found]).view(np.int64)
            for lo in range(0, len(row), 50_000):
                cut = slice(lo, lo + 50_000)
                yield pa.record_batch([b.column("b").take(pa.array(row[cut])), pa.array(item[cut])], ["leader", "item"])

    return run


def differences(k: int, percent: int):
    """First elements of each set's difference to its leader's: as many as a link with a member not linked to it needs."""
    c = (100 - percent) / (100 + percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text_a", 1 << 20):
            row, item, place, size, gap, tied = ([] for _ in range(6))
            often = b.column("often").to_pylist()
            for i, p, q, other in _gaps(b, k):
                n = len(other)
                both = (p + q - n) // 2
                linked = 100 * both >= percent * (p + q - both)
                least = (c * (q - p) + n) / 2 if linked else (n - c * (p + q)) / (1 + c)
                common = np.isin(other.view(np.int64), np.array(often[i] or [], np.int64))
                first = np.concatenate([other[~common], other[common]])[: n - max(1, int(np.ceil(least - 1e-6))) + 1]
                row.append(np.full(len(first), i))
                item.append(first)
                place.append(np.arange(len(first)))
                size.append(np.full(len(first), p))
                gap.append(np.full(len(first), n))
                tied.append(np.full(len(first), linked))
            row = np.concatenate(row)
            for lo in range(0, len(row), 50_000):
                cut = slice(lo, lo + 50_000)
                at = pa.array(row[cut])
                yield pa.record_batch(
                    [
                        b.column("a").take(at), b.column("b").take(at), b.column("label").take(at), pa.array(np.concatenate(item)[cut].view(np.int64)),
                        *[pa.array(np.concatenate(v)[cut].astype(np.int32)) for v in (place, size, gap)], pa.array(np.concatenate(tied)[cut]),
                    ],
                    ["node", "leader", "label", "item", "place", "size", "gap", "tied"],
                )

    return run


_NODE = "struct<id:bigint,low:bigint>"


def _sizes(a: str, b: str, percent: int) -> Column:
    return F.expr(f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})")


def near_duplicates(
    docs: DataFrame, percent: int = 80, k: int = 5, id_col: str = "doc_id", text_col: str = "text", often: int = OFTEN
) -> DataFrame:
    """Component of every document under links of a similarity of ``percent`` or more.

    The set of a text is its distinct shingles of ``k`` words, A-Z lower-cased; one of
    fewer words is one shingle, and one without words is empty and linked with nothing.
    Returns a row per input row: ``id``, ``version`` (a hash of the text), ``n_shingles``,
    ``component_id`` (the smallest id reachable) and ``first`` (whether the row is the
    component's smallest member).  ``often`` bounds what a leader's rows carry besides
    texts, and changes no result.  A null id counts as the smallest bigint and
    a null text as empty; equal rows get equal results.  Other columns are not read.
    """
    texts = lean(docs).select(
        ident(id_col).alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")
    ).withColumn("version", F.xxhash64("text"))
    sketched = stored(texts.mapInArrow(sketch_texts(k), _SKETCHED), "sketches")
    classes = (
        sketched.filter("n_shingles > 0")
        .groupBy("low", "high")
        .agg(
            F.min(F.struct("id", "version")).alias("m"), F.count("*").alias("n"), F.first("n_shingles").alias("size"),
            F.first("bands").alias("bands"), F.first("places").alias("places"),
        )
        .select(F.struct(F.col("m.id").alias("id"), "low").alias("node"), "low", "high", F.col("m.version").alias("version"), "n", "size", "bands", "places")
    )
    classes = stored(classes, "classes")
    member = classes.select(F.explode("bands").alias("band"), "node")
    shared = stored(
        member.groupBy("band").agg(F.count("*").alias("n"), F.min("node").alias("leader")).filter("n > 1").drop("n"), "bands"
    )
    member = stored(member.join(shared, "band"), "members")
    facts = classes.select("node", "size", "places")

    def weighed(pairs: DataFrame) -> DataFrame:
        """Pairs that size and sketch allow."""
        for end in ("a", "b"):
            side = facts.select(F.col("node").alias(end), F.col("size").alias(f"size_{end}"), F.col("places").alias(f"places_{end}"))
            pairs = pairs.join(side, end)
        pairs = pairs.filter(_sizes("size_a", "size_b", percent)).select("a", "b", "places_a", "places_b")
        return stored(pairs.mapInArrow(agreeing(percent), f"a {_NODE}, b {_NODE}"), "pairs")

    place = member.select("node").distinct().join(classes.select("node", "version"), "node")
    place = place.select("node", F.col("node.id").alias("id"), "version")
    held = stored(texts.join(place, ["id", "version"]).groupBy("node").agg(F.first("text").alias("text")), "texts")

    def with_texts(pairs: DataFrame) -> DataFrame:
        for end in ("a", "b"):
            pairs = pairs.join(held.select(F.col("node").alias(end), F.col("text").alias(f"text_{end}")), end)
        return pairs

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Pairs that their texts confirm."""
        pairs = with_texts(pairs).select("a", "b", "text_a", "text_b")
        return stored(pairs.mapInArrow(confirm(k, percent), f"a {_NODE}, b {_NODE}"), "links")

    def opened(labels: DataFrame) -> DataFrame:
        """Members of the bands that hold several components."""
        placed = member.join(labels, "node", "left").select("band", "node", "leader", F.coalesce("label", "node").alias("label"))
        split = placed.groupBy("band").agg(F.min("label").alias("low_label"), F.max("label").alias("high_label"))
        return stored(placed.join(stored(split.filter("low_label <> high_label").drop("high_label"), "split"), "band"), "open")

    starred = member.filter("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
    links = confirmed(weighed(starred))
    labels = stored(components(links), "labels")
    far = opened(labels).filter("label <> low_label")
    second = stored(far.groupBy("band").agg(F.min(F.struct("node", "label")).alias("s")), "second")
    again = far.join(second, "band").filter("label <> s.label").select(F.col("node").alias("a"), F.col("s.node").alias("b")).distinct()
    links = links.union(confirmed(weighed(again)))
    labels = stored(components(links), "labels")
    apart = opened(labels).filter("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b"), "label").distinct()
    apart = stored(apart, "apart")
    # any order of elements will do, the better the rarer come first: an eighth of the members tells
    some = apart.filter(F.pmod(F.xxhash64("a"), F.lit(8)) == 0)
    counted = with_texts(some).select("b", "text_a", "text_b").mapInArrow(gap_items(k), f"leader {_NODE}, item bigint")
    counted = counted.groupBy("leader", "item").count().filter("count > 1")
    rank = F.row_number().over(Window.partitionBy("leader").orderBy(F.desc("count"), "item"))
    top = counted.withColumn("rank", rank).filter(F.col("rank") <= often)
    top = top.groupBy(F.col("leader").alias("b")).agg(F.collect_list("item").alias("often"))
    apart = with_texts(apart).join(stored(top, "often"), "b", "left")
    apart = apart.select("a", "b", "label", "text_a", "text_b", "often").mapInArrow(
        differences(k, percent), f"node {_NODE}, leader {_NODE}, label {_NODE}, item bigint, place int, size int, gap int, tied boolean"
    )
    apart = stored(apart, "differences")
    ends = apart.groupBy("leader", "item").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    apart = apart.join(stored(ends.filter("low <> high").select("leader", "item"), "several"), ["leader", "item"])
    c = (100 - percent) / (100 + percent)
    need = f"ceil((x.gap + y.gap - {c!r} * (x.size + y.size)) / 2 - 1e-6)"
    meet = F.expr(
        f"x.leader = y.leader and x.item = y.item and x.label < y.label and not (x.tied and y.tied)"
        f" and x.place <= x.gap - {need} and y.place <= y.gap - {need}"
    )
    rest = apart.alias("x").join(apart.alias("y"), meet & _sizes("x.size", "y.size", percent))
    rest = rest.select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b")).distinct()
    labels = stored(components(links.union(confirmed(weighed(rest)))), "labels")

    found = classes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")).select("low", "high", "label", F.col("version").alias("of"))
    found = stored(found, "found")
    rows = sketched.select("id", "version", "n_shingles", "low", "high").join(found, ["low", "high"], "left")
    return rows.select(
        "id", "version", "n_shingles", F.coalesce("label.id", "id").alias("component_id"),
        F.coalesce((F.col("label.id") == F.col("id")) & (F.col("label.low") == F.col("low")) & (F.col("of") == F.col("version")), F.lit(True)).alias("first"),
    )
