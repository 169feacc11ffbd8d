"""Alignment of two tokenizers' tokens by lockstep merging in numpy.

Both tokenizers cut the same bytes.  All documents of a slice advance at once: a
state vector holds, per lane, the current token of either side and where the open
group began; in each step the side whose token ends first moves on, both where
they end together, which closes a group.  Lanes that have no tokens left are taken
out of the vector.  A long document enters as several lanes, cut where both sides
end, so that the number of steps stays small whatever the longest document is.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ident, lean, slices, stored
from .words import spread

#: Tokens after which a document goes on in another lane, and tokens tried for the cut.
LANE, TRIED = 128, 16
#: Links that are written out at once, and from which a group is counted by distinct ids.
LINKS, WIDE = 2_000_000, 1 << 16
#: Distinct pairs that a task holds before it hands counts on, and most pairs sent to every executor.
HELD_PAIRS, SENT_PAIRS = 1_000_000, 2_000_000
CACHE_UNITS = 300_000


class ByteLevel:
    """Side A: a byte-level BPE file of the tokenizers library; special tokens are plain text."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        # the format's rule: printable bytes stand for themselves, the others for characters from 256 on
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        sign = {chr(b): b for b in plain}
        sign.update({chr(256 + n): b for n, b in enumerate(sorted(set(range(256)).difference(plain)))})
        vocab = told["model"]["vocab"]
        special = {t["content"] for t in told.get("added_tokens", []) if t.get("special")}
        ranks = {bytes(sign[c] for c in t): k for t, k in vocab.items() if t not in special}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in told["model"]["merges"]]
        made = [vocab["".join(p)] for p in pairs]
        if any(x >= y for x, y in zip(made, made[1:])):
            raise ValueError(f"ids of {path} do not follow its merges")
        self.size = max(vocab.values()) + 1
        self.bytes = [b""] * self.size
        for token, k in ranks.items():
            self.bytes[k] = token
        self.encoding = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [self.encoding.encode_to_numpy(" " + t, disallowed_special=()).astype(np.int32) for t in texts]

    def same(self, text: str, ids: np.ndarray, sizes: np.ndarray) -> bool:
        """Whether the ids stand for all bytes of space and text; a pre-token's ids always stand for its bytes."""
        return int(sizes[ids].sum()) == 1 + len(text.encode())


class Pieces:
    """Side B: a sentencepiece model that puts a space before the text.

    No piece of such a model has a space behind another character, so spaces and the
    characters up to the next space are encoded by themselves; a bounded number of
    them is remembered, with whether the pieces stand for their bytes.  Where a model has
    such a piece, texts are encoded whole.
    """

    def __init__(self, path: str):
        import re

        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(k) for k in range(self.size)]
        self.bytes = [
            bytes([int(p[3:5], 16)]) if self.model.is_byte(k) else b"" if self.model.is_control(k) or self.model.is_unknown(k) else p.replace("▁", " ").encode()
            for k, p in enumerate(pieces)
        ]
        self.apart = not any("▁" in p.lstrip("▁") for p in pieces)
        self.split = re.compile("[ ▁]*[^ ▁]+|[ ▁]+").findall
        self.known: dict[str, bytes] = {}
        self.changed: set[str] = set()

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, bool]]:
        """Ids of each text, and whether they stand for the bytes of space and text."""
        if not self.apart:
            return [(np.array(x, np.int32), self._same(" " + t, x)) for t, x in zip(texts, self.model.encode(texts, num_threads=1))]
        parts = [self.split(" " + t) for t in texts]
        fresh = {u for p in parts for u in p}
        if len(self.known) + len(fresh) > CACHE_UNITS:
            self.known, self.changed = {}, set()
        fresh = list(fresh.difference(self.known))
        # the model puts one of the unit's spaces back; it gives nothing for a unit that is only this space
        found = self.model.encode([u[1:] for u in fresh], num_threads=1)
        one = [self.model.piece_to_id("▁")]
        found = [x if len(u) > 1 else one for u, x in zip(fresh, found)]
        self.changed.update(u for u, x in zip(fresh, found) if not self._same(u, x))
        flat = np.fromiter(chain.from_iterable(found), np.int32, sum(map(len, found))).tobytes()
        ends = list(accumulate(map(len, found), initial=0))
        self.known.update((u, flat[4 * lo : 4 * hi]) for u, lo, hi in zip(fresh, ends, ends[1:]))
        look = self.known.__getitem__
        return [(np.frombuffer(b"".join(map(look, p)), np.int32), not self.changed or self.changed.isdisjoint(p)) for p in parts]

    def _same(self, unit: str, ids: list[int]) -> bool:
        return b"".join([self.bytes[k] for k in ids]) == unit.encode()


def lanes(end_a: np.ndarray, end_b: np.ndarray, first_a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last tokens, of either side, of the lanes of documents that begin at ``first_a``.

    Token ends count on through all documents, whose bytes are equal on both sides.
    """
    count = np.diff(first_a)
    cuts = np.maximum(count - 1, 0) // LANE
    at = LANE * (spread(np.zeros(len(cuts), np.int64), cuts) + 1) + np.repeat(first_a[:-1], cuts)
    tried = np.minimum(at[:, None] + np.arange(TRIED), np.repeat(first_a[1:] - 1, cuts)[:, None])
    ends = end_a[tried]
    met = end_b[np.minimum(np.searchsorted(end_b, ends), len(end_b) - 1)] == ends if len(end_b) else ends > ends
    some = met.any(axis=1)
    starts = tried[np.arange(len(at)), met.argmax(axis=1)][some] + 1
    starts = np.unique(np.concatenate([first_a[:-1][count > 0], starts[starts < first_a[-1]]]))
    byte = np.where(starts > 0, end_a[starts - 1], 0)
    b = np.searchsorted(end_b, byte, "right")
    return starts, np.append(starts[1:], first_a[-1]), b, np.append(b[1:], len(end_b))


def lockstep(end_a: np.ndarray, end_b: np.ndarray, a: np.ndarray, a_last: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Groups as rows (first A, end A, first B, end B), in order of the text."""
    state = np.stack([a, b, a, b, a_last])  # current tokens, first tokens of the open group, end of the lane
    cuts = []
    while state.shape[1]:
        x, y = end_a[state[0]], end_b[state[1]]
        state[0] += x <= y
        state[1] += y <= x
        at = np.flatnonzero(x == y)
        if len(at):
            cuts.append(np.stack([state[2, at], state[0, at], state[3, at], state[1, at]]))
            state[2:4, at] = state[:2, at]
            if (state[0, at] == state[4, at]).any():
                state = state[:, state[0] < state[4]]
    found = np.concatenate(cuts, axis=1) if cuts else np.zeros((4, 0), np.int64)
    return found[:, np.argsort(found[0])]


def linked(groups: np.ndarray, a: np.ndarray, b: np.ndarray, doc: np.ndarray, n_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, pair, links) of all id pairs that share a group; ``doc`` is the group's document."""
    size_a, size_b = groups[1] - groups[0], groups[3] - groups[2]
    links = size_a * size_b
    span = np.int64(n_b) * (int(a.max(initial=0)) + 1)
    keys, times = [], []
    narrow = np.flatnonzero(links < WIDE)
    total = np.cumsum(links[narrow])
    lo = 0
    while lo < len(narrow):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + LINKS, "right")))
        some = narrow[lo:hi]
        g = np.repeat(some, links[some])
        k = spread(np.zeros(len(some), np.int64), links[some])
        pair = a[groups[0, g] + k // size_b[g]].astype(np.int64) * n_b + b[groups[2, g] + k % size_b[g]]
        key, n = np.unique(doc[g] * span + pair, return_counts=True)
        keys.append(key)
        times.append(n)
        lo = hi
    for g in np.flatnonzero(links >= WIDE).tolist():
        ids_a, n_a = np.unique(a[groups[0, g] : groups[1, g]], return_counts=True)
        ids_b, n_of_b = np.unique(b[groups[2, g] : groups[3, g]], return_counts=True)
        keys.append((doc[g] * span + ids_a[:, None].astype(np.int64) * n_b + ids_b[None, :]).ravel())
        times.append((n_a[:, None] * n_of_b[None, :]).ravel())
    if not keys:
        return (np.zeros(0, np.int64),) * 3
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    n = np.zeros(len(key), np.int64)
    np.add.at(n, at, np.concatenate(times))
    return key // span, key % span, n


class Aligner:
    """Both tokenizers with their tables by id."""

    def __init__(self, path_a: str, pattern: str, path_b: str):
        self.a, self.b = ByteLevel(path_a, pattern), Pieces(path_b)
        self.size_a, self.size_b = (np.array([len(t) for t in s.bytes], np.int64) for s in (self.a, self.b))
        # digits of every id with what follows them, in the order of the codes of text()
        self.said = [b"%d%c" % (k, s) for n, signs in ((self.a.size, b",|"), (self.b.size, b",;")) for k in range(n) for s in signs]

    def tokens(self, texts: list[str | None]):
        """Ids of either side of each text; no ids where the bytes are not those of space and text."""
        none = np.zeros(0, np.int32)
        ids = [(none, none)] * len(texts)
        rows = [k for k, t in enumerate(texts) if t]
        given = [texts[k] for k in rows]
        for k, t, x, (y, same) in zip(rows, given, self.a.ids(given), self.b.encode(given)):
            if same and self.a.same(t, x, self.size_a):
                ids[k] = x, y
        return ids

    def text(self, groups: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[bytes]:
        """Ids with their signs, in the order of the groups."""
        size_a, size_b = groups[1] - groups[0], groups[3] - groups[2]
        out = np.zeros(len(a) + len(b), np.int64)
        code = a.astype(np.int64) * 2
        code[groups[1] - 1] += 1
        out[np.arange(len(a)) + np.repeat(groups[2], size_a)] = code
        code = b.astype(np.int64) * 2 + 2 * self.a.size
        code[groups[3] - 1] += 1
        out[np.arange(len(b)) + np.repeat(groups[1], size_b)] = code
        return list(map(self.said.__getitem__, out.tolist()))


_ALIGNERS: dict[tuple, Aligner] = {}


def aligned(path_a: str, pattern: str, path_b: str):
    """Per text: sizes, digest of its groups, and its linked id pairs with how often each is linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _ALIGNERS.get((path_a, pattern, path_b))
        if both is None:
            both = _ALIGNERS[path_a, pattern, path_b] = Aligner(path_a, pattern, path_b)
        n_b = both.b.size
        for batch in slices(batches, "text"):
            ids = both.tokens(batch.column("text").to_pylist())
            a, b = (np.concatenate([x[s] for x in ids]) for s in (0, 1))
            n_a, n_of_b = (np.array([len(x[s]) for x in ids], np.int64) for s in (0, 1))
            first_a, first_b = (np.concatenate([[0], np.cumsum(n)]) for n in (n_a, n_of_b))
            end_a, end_b = np.cumsum(both.size_a[a]), np.cumsum(both.size_b[b])
            lo_a, hi_a, lo_b, _ = lanes(end_a, end_b, first_a)
            groups = lockstep(end_a, end_b, lo_a, hi_a, lo_b)
            first = np.searchsorted(groups[0], first_a)
            links = np.concatenate([[0], np.cumsum((groups[1] - groups[0]) * (groups[3] - groups[2]))])
            said = both.text(groups, a, b)
            ends = (first_a + first_b).tolist()
            shas = [hashlib.sha256(b"".join(said[x:y])[:-1]).hexdigest() if y > x else "" for x, y in zip(ends, ends[1:])]
            doc, pair, times = linked(groups, a, b, np.repeat(np.arange(len(ids)), np.diff(first)), n_b)
            cut = pa.array(np.searchsorted(doc, np.arange(len(ids) + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(cut, pa.array(x.astype(np.int32))) for x in (pair // n_b, pair % n_b, times)]
            sizes = [pa.array(x, pa.int64()) for x in (n_a, n_of_b, np.diff(first), links[first[1:]] - links[first[:-1]])]
            yield pa.record_batch(
                [*[batch.column(c) for c in ("row", "id", "version")], *sizes, pa.array(shas, pa.string()), *lists],
                ["row", "id", "version", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "a", "b", "times"],
            )

    return run


def _pairs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    a, b = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("a", "b"))
    return a << 32 | b, np.diff(batch.column("a").offsets.to_numpy())


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many of a task's documents each pair is linked; counts go on before too many are held."""

    def merged(parts):
        key, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        n = np.zeros(len(key), np.int64)
        np.add.at(n, at, np.concatenate([p[1] for p in parts]))
        return key, n

    def packed(key, n):
        for lo in range(0, len(key), 100_000):
            k = key[lo : lo + 100_000]
            yield pa.record_batch([pa.array((k >> 32).astype(np.int32)), pa.array((k & 0xFFFFFFFF).astype(np.int32)), pa.array(n[lo : lo + 100_000])], ["a", "b", "n"])

    parts, held = [], 0
    for batch in batches:
        parts.append(np.unique(_pairs(batch)[0], return_counts=True))
        held += len(parts[-1][0])
        if held > HELD_PAIRS:
            parts = [merged(parts)]
            held = len(parts[0][0])
            if held > HELD_PAIRS // 2:
                yield from packed(*parts[0])
                parts, held = [], 0
    if parts:
        yield from packed(*merged(parts))


def looked_up(sent):
    """Best links and sum of counts of each document, by a sorted table of all pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = sent.value
        for batch in batches:
            key, size = _pairs(batch)
            times = batch.column("times").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.searchsorted(keys, key)
            ends = np.concatenate([[0], np.cumsum(size)])
            sums = [np.concatenate([[0], np.cumsum(x)])[ends] for x in (times * best[at], times * n[at])] if len(keys) else [ends * 0] * 2
            names = ["id", "version", "n_a", "n_b", "n_groups", "n_links"]
            yield pa.record_batch(
                [*[batch.column(c) for c in names], *[pa.array(np.diff(s)) for s in sums], batch.column("groups_sha256")],
                [*names, "n_best", "count_sum", "groups_sha256"],
            )

    return run


def align(
    docs: DataFrame, path_a: str, pattern: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", sent_pairs: int = SENT_PAIRS
) -> DataFrame:
    """Groups of tokens of two tokenizers that cover the same bytes, and how usual their links are.

    ``path_a`` is a byte-level BPE file (pre-tokens by ``pattern``), ``path_b`` a sentencepiece
    model; each executor has both.  A group ends where tokens of both sides end; all its A-B
    token pairs are links.  The count of an id pair is the number of documents with such a link.

    Returns a row per input row: ``id``, ``version`` (a hash of the text), ``n_a``, ``n_b``,
    ``n_groups``, ``n_links``, ``n_best`` (links whose count is the highest of their A id),
    ``count_sum`` (over links) and ``groups_sha256``.  Texts that are null or empty, or that a
    tokenizer changes, have no tokens: zeros and ''.  A null id counts as the smallest
    bigint; repeated rows are documents each.  Other columns are not read.

    Pair counts are combined within tasks, then by Spark.  Up to ``sent_pairs`` distinct pairs
    are sent to every executor; beyond that, documents' pairs are joined with the counts.
    """
    spark = docs.sparkSession
    texts = lean(docs).select(
        ident(id_col).alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")
    ).withColumns({"version": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    told = stored(
        texts.mapInArrow(
            aligned(path_a, pattern, path_b),
            "row bigint, id bigint, version bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
            "a array<int>, b array<int>, times array<int>",
        ),
        "aligned",
    )
    counts = told.select("a", "b").mapInArrow(counted, "a int, b int, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))
    # an A id has as many rows as side B has ids, at most
    counts = stored(counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("a"))), "pair-counts")
    if counts.count() <= sent_pairs:
        got = counts.toArrow()
        a, b, n, best = (got.column(c).to_numpy() for c in ("a", "b", "n", "best"))
        key = a.astype(np.int64) << 32 | b
        order = np.argsort(key)
        sent = spark.sparkContext.broadcast((key[order], n[order], best[order].astype(np.int64)))
        return told.mapInArrow(
            looked_up(sent),
            "id bigint, version bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string",
        )
    links = told.select("row", F.explode(F.arrays_zip("a", "b", "times")).alias("l")).select("row", "l.a", "l.b", "l.times")
    sums = links.join(counts, ["a", "b"]).groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times").cast("bigint")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")
    )
    zero = {c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("n_best", "count_sum")}
    return told.drop("a", "b", "times").join(sums, "row", "left").withColumns(zero).select(
        "id", "version", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )
