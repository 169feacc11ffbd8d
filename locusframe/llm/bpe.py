"""Byte-level BPE in whole numpy matrices.

New pre-tokens of a slice are put in matrices by length.  In each round every row
looks up the rank of its pairs in a hash table, merges the leftmost pair of the
smallest rank and closes the gap; rows without a known pair leave the matrix.
Pre-tokens beyond the widest matrix merge by a heap with the same order.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ident, lean, slices
from .words import U

CACHE_WORDS = 200_000
WIDEST = 256
_NONE = np.int64(1) << 40


class Vocabulary:
    """Tokens by rank, and a hash table with open addressing from pairs of tokens to ranks."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) }
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.pairs = {
            (ranks[t[:k]], ranks[t[k:]]): r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks
        }
        self._build()

    def _build(self) -> None:
        keys = np.array([a << 32 | b for a, b in self.pairs], U)
        self.bits = max(4, (2 * len(keys)).bit_length())
        self.mask = (1 << self.bits) - 1
        self.key, self.rank = np.full(1 << self.bits, ~U(0)), np.full(1 << self.bits, _NONE)
        values, slot, self.probes = np.fromiter(self.pairs.values(), np.int64, len(keys)), self._slot(keys), 0
        while len(keys):
            free = np.flatnonzero(self.key[slot] == ~U(0))
            _, one = np.unique(slot[free], return_index=True)
            won = free[one]
            self.key[slot[won]], self.rank[slot[won]] = keys[won], values[won]
            left = np.setdiff1d(np.arange(len(keys)), won, assume_unique=True)
            keys, values, slot = keys[left], values[left], (slot[left] + 1) & self.mask
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U(0x9E3779B97F4A7C15)) >> U(64 - self.bits)).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; a large number where there is none."""
        keys = (left.astype(U) << U(32)) | right.astype(U)
        slot = self._slot(keys)
        out = np.full(len(keys), _NONE)
        todo = np.arange(len(keys))
        for _ in range(self.probes):
            found = self.key[slot[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.rank[slot[todo[hit]]]
            todo = todo[~hit & (found != ~U(0))]
            if not len(todo):
                break
            slot[todo] = (slot[todo] + 1) & self.mask
        return out

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as little-endian 32-bit numbers."""
        out: list[bytes] = [b""] * len(words)
        sizes = np.array([len(w) for w in words])
        for k in np.flatnonzero(sizes > WIDEST).tolist():
            out[k] = self._heap(words[k])
        low, width = 0, 4
        while low < WIDEST:
            for at in np.array_split(rows := np.flatnonzero((sizes > low) & (sizes <= width)), len(rows) * width // 4_000_000 + 1):
                if len(at):
                    self._matrix([words[k] for k in at.tolist()], at.tolist(), width, out)
            low, width = width, 2 * width
        return out

    def _matrix(self, words: list[bytes], names: list[int], width: int, out: list[bytes]) -> None:
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)
        size = np.array([len(w) for w in words])
        name = np.array(names)
        ids = self.bytes[raw]
        ranks = np.full((len(words), width), _NONE)
        y, x = np.nonzero(np.arange(1, width)[None, :] < size[:, None])
        ranks[y, x] = self.look_up(ids[y, x], ids[y, x + 1])
        columns = np.arange(width)
        while len(ids):
            at = ranks.argmin(axis=1)
            least = ranks[np.arange(len(ids)), at]
            done = least == _NONE
            for k in np.flatnonzero(done).tolist():
                out[name[k]] = ids[k, : size[k]].astype("<u4").tobytes()
            stay = np.flatnonzero(~done)
            ids, ranks, size, name, at, least = ids[stay], ranks[stay], size[stay], name[stay], at[stay], least[stay]
            row = np.arange(len(ids))
            ids[row, at] = least
            source = np.minimum(columns[None, :] + (columns[None, :] > at[:, None]), width - 1)
            ids = np.take_along_axis(ids, source, axis=1)
            ranks = np.take_along_axis(ranks, source, axis=1)
            size = size - 1
            ranks[row, size - 1] = _NONE
            before = np.flatnonzero(at > 0)
            ranks[before, at[before] - 1] = self.look_up(ids[before, at[before] - 1], ids[before, at[before]])
            after = np.flatnonzero(at + 1 < size)
            ranks[after, at[after]] = self.look_up(ids[after, at[after]], ids[after, at[after] + 1])

    def _heap(self, word: bytes) -> bytes:
        ids = [int(self.bytes[b]) for b in word]
        last, next_ = list(range(-1, len(ids) - 1)), list(range(1, len(ids) + 1))
        heap = [(r, k, ids[k], ids[k + 1]) for k in range(len(ids) - 1) if (r := self.pairs.get((ids[k], ids[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, k, a, b = heapq.heappop(heap)
            j = next_[k] if ids[k] >= 0 else len(ids)
            if j >= len(ids) or ids[k] != a or ids[j] != b:
                continue
            ids[k], ids[j], next_[k] = rank, -1, next_[j]
            if next_[k] < len(ids):
                last[next_[k]] = k
            for x, y in ((last[k], k), (k, next_[k])):
                if x >= 0 and y < len(ids) and (r := self.pairs.get((ids[x], ids[y]))) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()


class Encoder:
    """Splits texts by a pattern and remembers the ids of a bounded number of pre-tokens."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.vocabulary, self.split, self.known = Vocabulary(path), regex.compile(pattern).findall, {}

    def encode(self, texts: list[str]) -> list[bytes]:
        parts = [self.split(t) for t in texts]
        fresh = {w for p in parts for w in p}
        if len(self.known) + len(fresh) > CACHE_WORDS:
            self.known = {}
        fresh = list(fresh.difference(self.known))
        self.known.update(zip(fresh, self.vocabulary.merge([w.encode() for w in fresh])))
        look = self.known.__getitem__
        return [b"".join(map(look, p)) for p in parts]


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encode(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False
) -> DataFrame:
    """Token ids of every whole text, each match of ``pattern`` merged by itself, without special tokens.

    ``path`` is a file of ranks (base64 token, rank) that each executor has.  Returns a
    row per input row: ``id``, ``version`` (a hash of the text), ``ids`` and, where
    ``decoded``, the bytes that the ids stand for.  A null or empty text has no ids; a
    null id counts as the smallest bigint.  Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _ENCODERS.get((path, pattern))
        if coder is None:
            coder = _ENCODERS[path, pattern] = Encoder(path, pattern)
        tokens = coder.vocabulary.tokens
        for b in slices(batches, "text", 1 << 20):
            ids = coder.encode(b.column("text").to_pylist())
            cuts = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])])
            values = np.frombuffer(b"".join(ids), "<i4")
            cols = [b.column("id"), b.column("version"), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values))]
            names = ["id", "version", "ids"]
            if decoded:
                flat = values.tolist()
                cols.append(pa.array([b"".join([tokens[k] for k in flat[lo:hi]]) for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist())], pa.binary()))
                names.append("decoded")
            yield pa.record_batch(cols, names)

    texts = lean(docs).select(
        ident(id_col).alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")
    ).withColumn("version", F.xxhash64("text")).select("id", "version", "text")
    return texts.mapInArrow(run, "id bigint, version bigint, ids array<int>" + ", decoded binary" * decoded)
