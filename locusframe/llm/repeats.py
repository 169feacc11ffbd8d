"""Removal of repeated word windows by recompression.

Rounds name runs and pairs of symbols.  A name is a hash of what it stands for,
so every task gives equal runs and pairs equal names without a dictionary, and a
repeated passage gets the same symbols inside, whatever surrounds it: whether a
symbol of the second round begins at a word follows from the five words on
either side.  Those ten words name the place.  Of the places inside a window,
the one with the smallest name is its mark, so equal windows have equal marks
and about one word in six is one.

1. Spark counts the names of all marks (`mark_texts`), with partial counts before
   the shuffle.
2. Texts with a mark that occurs twice are read again; every window around such
   a mark gets a hash of 96 bits, and Spark keeps the first place of each.  Of equal
   texts only the first takes part, as the others have no first windows.
3. Windows that are not the first of their hash are removed.

No step needs the rows of one name together: both aggregates combine before the
shuffle, and the join of marks with repeated names is a plain one that adaptive
execution splits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ident, lean, raw, slices, stored
from .words import Words, mix, spread

#: Words on either side that decide where a symbol of the second round begins.
SIDE = 5
_RUN, _LEFT, _RIGHT = np.uint64(0x8EBC6AF09C88C6E3), np.uint64(0x589965CC75374CC3), np.uint64(0x1D8E4E27C47D124F)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def symbols(words: Words, rounds: int = 2) -> np.ndarray:
    """The words at which a symbol of the last round begins.

    Words of a run are first named by the run; then, in each round, a symbol of
    the left class joins a following one of the right class.  Two equal symbols
    are of one class, so pairs never overlap.
    """
    name, place = words.hash, np.arange(len(words.hash))
    opens = np.zeros(len(name) + 1, bool)
    opens[words.first] = True
    opens = opens[:-1]
    same = np.zeros(len(name) + 1, bool)
    same[1:-1] = (name[1:] == name[:-1]) & ~opens[1:]
    name = np.where(same[1:] | same[:-1], mix(name ^ _RUN), name)
    for k in range(rounds):
        left = (mix(name + np.uint64(k + 1)) & np.uint64(1)).astype(bool)
        joins = np.zeros(len(name), bool)
        joins[:-1] = left[:-1] & ~left[1:] & ~opens[1:]
        after = np.zeros(len(name), bool)
        after[1:] = joins[:-1]
        paired = name.copy()
        at = np.flatnonzero(joins)
        paired[at] = mix(name[at] * _LEFT + name[at + 1] * _RIGHT + np.uint64(k))
        name, place, opens = paired[~after], place[~after], opens[~after]
    return place


def _sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Smallest (or largest) of every ``width`` consecutive values."""
    pick, done = (np.minimum if least else np.maximum), 1
    out = values
    while done < width:
        step = min(done, width - done)
        out = pick(out[:-step], out[step:]) if step < len(out) else out[:0]
        done += step
    return out


def marks(words: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Names and places of all marks."""
    n, width = len(words.hash), window - 2 * SIDE + 1
    if n < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    names, starts = words.grams(2 * SIDE)
    by_start = np.full(n + 1, _NONE)
    by_start[starts] = names
    rank = np.full(n, _NONE)
    places = symbols(words)
    places = places[places >= SIDE]
    rank[places] = by_start[places - SIDE]
    smallest = np.zeros(n, np.uint64)  # of each window, by its first word; 0 where no window begins
    at = spread(words.first[:-1], np.maximum(words.count - window + 1, 0))
    smallest[at] = _sliding(rank, width, True)[at + SIDE]
    padded = np.concatenate([np.zeros(window - SIDE, np.uint64), smallest])
    found = np.flatnonzero(rank == _sliding(padded, width, False)[:n])
    found = found[rank[found] != _NONE]
    return rank[found], found


def summaries(digest: bool):
    """Per text: number of words and, where asked for, digest of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            parts = [t.split() for t in b.column("text").cast(pa.binary()).to_pylist()]
            shas = [hashlib.sha256(b" ".join(p)).hexdigest() if digest else None for p in parts]
            yield pa.record_batch(
                [b.column("id"), b.column("version"), b.column("same"), pa.array([len(p) for p in parts], pa.int64()), pa.array(shas, pa.string())],
                ["id", "version", "same", "n_words", "sha"],
            )

    return run


def mark_texts(window: int, bits: int):
    """Names, of so many bits, and places of the marks of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            words = Words(*raw(b.column("text")))
            names, found = marks(words, window)
            names = (names >> np.uint64(64 - bits)).view(np.int64)
            cut = np.searchsorted(found, words.first)
            own = (found - np.repeat(words.first[:-1], np.diff(cut))).astype(np.int32)
            cut = pa.array(cut, pa.int32())
            yield pa.record_batch(
                [b.column("id"), pa.ListArray.from_arrays(cut, pa.array(names)), pa.ListArray.from_arrays(cut, pa.array(own))],
                ["id", "names", "places"],
            )

    return run


def _around(places: np.ndarray, n_words: int, window: int) -> np.ndarray:
    """First words of the windows that hold one of the places with its ten words."""
    edge = np.zeros(n_words + 2, np.int64)
    np.add.at(edge, np.clip(places - (window - SIDE), 0, n_words), 1)
    np.add.at(edge, np.clip(places - SIDE + 1, 0, n_words), -1)
    last = max(0, n_words - window + 1)
    return np.flatnonzero(np.cumsum(edge)[:last] > 0)


def window_hashes(window: int):
    """A row per window around a repeated mark; of one text and hash only the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1 << 20):
            words = Words(*raw(b.column("text")))
            low, starts = words.grams(window)
            high, _ = words.grams(window, 1)
            begins = np.searchsorted(starts, words.first)
            held, off = b.column("places").flatten().to_numpy(), b.column("places").offsets.to_numpy()
            off = off - off[0]
            rows, ids = [], []
            for i in range(b.num_rows):
                own = _around(held[off[i] : off[i + 1]], int(words.count[i]), window)
                pick = begins[i] + own
                _, one = np.unique(low[pick], return_index=True)
                rows.append(np.stack([low[pick[one]].view(np.int64), high[pick[one]].view(np.int64), own[one]]))
                ids.append(np.full(len(one), i))
            rows, ids = np.concatenate(rows, axis=1), np.concatenate(ids)
            for lo in range(0, len(ids), 50_000):
                part = slice(lo, lo + 50_000)
                yield pa.record_batch(
                    [
                        pa.array(rows[0, part]), pa.array((rows[1, part] >> 32).astype(np.int32)), b.column("id").take(pa.array(ids[part])),
                        b.column("version").take(pa.array(ids[part])), pa.array(rows[2, part].astype(np.int32)),
                    ],
                    ["low", "high", "id", "version", "start"],
                )

    return run


def strike_out(window: int, digest: bool, text: bool):
    """What stays once every window around a mark, but for the firsts, is taken out: its digest, its words, or both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            data, at = raw(b.column("text"))
            words = Words(data, at)
            whole = data.tobytes()
            kept, removed, shas = [], [], []
            for i, (places, firsts) in enumerate(zip(b.column("places"), b.column("firsts"))):
                n = int(words.count[i])
                own = _around(np.array(places.as_py(), np.int64), n, window)
                own = np.setdiff1d(own, np.array(firsts.as_py() or [], np.int64), assume_unique=True)
                edge = np.zeros(n + 1, np.int64)
                edge[own] += 1
                np.add.at(edge, own + window, -1)
                gone = np.cumsum(edge)[:n] > 0
                stay = words.first[i] + np.flatnonzero(~gone)
                removed.append(int(gone.sum()))
                left = b" ".join(whole[s:e] for s, e in zip(words.start[stay].tolist(), words.end[stay].tolist()))
                kept.append(left if text else None)
                shas.append(hashlib.sha256(left).hexdigest() if digest else None)
            yield pa.record_batch(
                [b.column("id"), b.column("version"), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(shas, pa.string())],
                ["id", "version", "n_removed", "kept_text", "sha"],
            )

    return run


def repeats(
    docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", digest: bool = True, kept: bool = True
) -> DataFrame:
    """Find the words covered by a window of ``window`` words that starts earlier too.

    Returns a row per input row: ``id``, ``version`` (a hash of the text), ``n_words``,
    ``n_removed``, ``kept_text`` (the words that stay, joined by a space; null where
    nothing is removed, or ``kept`` is off) and ``sha`` (SHA-256 of the words that stay;
    null where ``digest`` is off).  Only these and places of words are written on the
    way; the texts themselves are joined to them twice.

    Places are ordered by (id, version, start).  A null id counts as the smallest
    bigint, a null text as empty; rows that repeat id and text are one document and
    get equal results.  Columns of other names are not read.
    """
    if window < 2 * SIDE + 4:
        raise ValueError(f"a window needs {2 * SIDE + 4} words or more")
    texts = lean(docs).select(
        ident(id_col).alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")
    ).withColumn("version", F.xxhash64("text"))
    told = texts.withColumn("same", F.struct(F.crc32("text").alias("crc"), F.octet_length("text").alias("size")))
    told = stored(told.mapInArrow(summaries(digest), "id bigint, version bigint, same struct<crc:bigint,size:int>, n_words bigint, sha string"), "summaries")
    # a shuffled name has as many bits as the number of words asks for; the few that then
    # coincide by chance only add windows to the next step
    bits = min(63, (told.agg(F.sum("n_words")).first()[0] or 0).bit_length() + 12)
    marked = texts.select("id", "text").mapInArrow(mark_texts(window, bits), "id bigint, names array<bigint>, places array<int>")
    twice = marked.select(F.explode("names").alias("name")).groupBy("name").count().filter("count > 1").select("name")
    twice = stored(twice, "twice")
    places = marked.select("id", F.explode(F.arrays_zip("names", "places")).alias("m")).select(
        "id", F.col("m.names").alias("name"), F.col("m.places").alias("place")
    )
    held = places.join(twice, "name", "left_semi").groupBy("id").agg(F.collect_set("place").alias("places"))
    # the version only has to tell rows of one id apart
    rows = told.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")
    # of equal texts only the first has first windows
    one = told.groupBy("version", "same").agg(F.min("id").alias("one"), F.count("*").alias("n")).filter("n > 1")
    later = told.join(stored(one.drop("n"), "copies"), ["version", "same"]).filter("id > one").select("id", F.lit(True).alias("later")).distinct()
    held = held.join(rows, "id", "left").join(later, "id", "left")
    held = held.select("id", "places", F.col("n").isNotNull().alias("many"), (F.col("n").isNull() & F.col("later").isNotNull()).alias("later"))
    held = stored(held, "held")

    def touched(held: DataFrame) -> DataFrame:
        return texts.join(held, "id").withColumn("version", F.when(F.col("many"), F.col("version")).otherwise(0)).select("id", "version", "text", "places")

    first = (
        touched(held.filter("not later")).mapInArrow(window_hashes(window), "low bigint, high int, id bigint, version bigint, start int")
        .groupBy("low", "high")
        .agg(F.min(F.struct("id", "version", "start")).alias("f"))
        .groupBy(F.col("f.id").alias("id"), F.col("f.version").alias("version"))
        .agg(F.collect_list("f.start").alias("firsts"))
    )
    first = stored(first, "firsts")
    struck = stored(
        touched(held).join(first, ["id", "version"], "left")
        .mapInArrow(strike_out(window, digest, kept), "id bigint, version bigint, n_removed bigint, kept_text string, sha string")
        .filter("n_removed > 0"),
        "struck",
    )
    once = struck.select("id", F.col("version").alias("_v"), "n_removed", "kept_text", "sha").dropDuplicates(["id", "_v"])
    same = (F.col("_v") == 0) | (F.col("_v") == F.col("version"))
    return told.select("id", "version", "n_words", F.col("sha").alias("_sha")).join(once, (told["id"] == once["id"]) & same, "left").drop(once["id"]).select(
        "id", "version", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), "kept_text",
        F.coalesce("sha", "_sha").alias("sha"),
    )
