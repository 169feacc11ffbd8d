"""Best-fit packing of tokenised documents, planned on the histogram of lengths."""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ident, lean, slices, stored

CACHE_CHUNKS, CACHE_WORDS = 600_000, 400_000
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Rows that one part of a length has at least, in the ranking.
RANK_ROWS = 1000


class Chunks:
    """Token ids, as little-endian bytes, of texts by way of their white-space chunks.

    The tokenizer drops white space before it merges, so a text's ids are those of
    its chunks, and a letter ends its pre-token before a following ASCII mark, so a
    word's ids do not depend on the marks behind it.  Such words go to the tokenizer's
    model at once; any other chunk, and one that holds the text of a special token, takes
    the tokenizer's whole way.  Chunks and words
    are remembered, up to a number of each.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        # a chunk with a special token's text goes to the tokenizer, which gives the token for it
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if any(t.split() != [t] for t in self.special):
            raise ValueError("special tokens with white space are not handled")
        self.model = self.tokenizer.model.tokenize
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.signs = {  # of the bytes that letters in UTF-8 have
            b: level.pre_tokenize_str(c)[0][0][k]
            for c in (*map(chr, range(97, 123)), *map(chr, range(0xC0, 0x100)), *map(chr, range(0x400, 0x480)))
            for k, b in enumerate(c.encode())
        }
        self.known: dict[bytes, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _word(self, word: str) -> bytes | None:
        """Ids of a word of letters; None if it needs the tokenizer's whole way."""
        low = word.lower()
        found = self.words.get(low)
        if found is None and word.isalpha():
            if word.isascii():
                signs = low
            elif unicodedata.is_normalized("NFC", word) and "\u03a3" not in word and "\u0130" not in word:
                signs = "".join([self.signs.get(b, "") or "\0" for b in low.encode()])
            else:
                return None
            if "\0" in signs:
                return None
            found = self.words[low] = np.array([t.id for t in self.model(signs)], "<u4").tobytes()
        return found

    def ids(self, texts: list[bytes]) -> list[bytes]:
        parts = [t.split() for t in texts]
        # mostly none, so that no chunk is searched for one
        special = [t for t in self.special if any(t.encode() in x for x in texts)]
        fresh = {c for p in parts for c in p}
        if len(self.known) + len(fresh) > CACHE_CHUNKS:
            self.known = {}
        if len(self.words) > CACHE_WORDS:
            self.words = {}
        slow = []
        for c in fresh.difference(self.known):
            text = c.decode()
            word = text.rstrip(_MARKS)
            # a special token ends in a mark, so it may lie across the word's end
            ids = self._word(word) if word and not (special and any(t in text for t in special)) else None
            if ids is None:
                slow.append(c)
                continue
            tail = text[len(word) :]
            if tail not in self.marks:
                if len(self.marks) > CACHE_WORDS:
                    self.marks = {"": b""}
                self.marks[tail] = self._whole([tail])[0]
            self.known[c] = ids + self.marks[tail]
        for lo in range(0, len(slow), 4096):
            some = slow[lo : lo + 4096]
            self.known.update(zip(some, self._whole([c.decode() for c in some])))
        look = self.known.__getitem__
        return [b"".join(map(look, p)) for p in parts]


_CHUNKS: dict[str, Chunks] = {}


def tokenise(path: str, capacity: int, with_ids: bool):
    """Pieces of at most ``capacity`` tokens, the closing 0 included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _CHUNKS:
            _CHUNKS[path] = Chunks(path)
        for b in slices(batches, "text"):
            id, row, piece, length, crc, body = ([] for _ in range(6))
            all_ids = _CHUNKS[path].ids(b.column("text").cast(pa.binary()).to_pylist())
            for key, version, ids in zip(b.column("id").to_pylist(), b.column("version").to_pylist(), all_ids):
                ids += b"\0\0\0\0"
                for k in range(0, len(ids), 4 * capacity):
                    part = ids[k : k + 4 * capacity]
                    id.append(key)
                    row.append(version)
                    piece.append(k // (4 * capacity))
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    body.append(part if with_ids else None)
            yield pa.record_batch(
                [
                    pa.array(id, pa.int64()), pa.array(row, pa.int64()), pa.array(piece, pa.int32()),
                    pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(body, pa.binary()),
                ],
                ["id", "version", "piece", "length", "ids_crc32", "ids"],
            )

    return run


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Best-fit decreasing over counts: rows of (length, rank, sequences, each, sequence, offset).

    ``sequences`` sequences from ``sequence`` on take ``each`` pieces of ``length`` at
    ``offset``; their ranks within the length begin at ``rank``.  Sequences with equal
    room are handled together, so the work grows with the number of lengths.
    """
    room: dict[int, list[tuple[int, int]]] = {}
    rows, used = [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]

        def fill(first: int, n: int, free: int) -> int:
            """Place pieces in up to ``n`` sequences with ``free`` tokens; returns how many were used."""
            nonlocal rank, left
            most, taken = free // length, 0
            for each in (most, left % most):
                m = min(n - taken, left // each) if each else 0
                if m:
                    rows.append((length, rank, m, each, first + taken, capacity - free))
                    rest = free - each * length
                    if rest:
                        room.setdefault(rest, []).append((first + taken, m))
                    rank, left, taken = rank + m * each, left - m * each, taken + m
                if left >= most:
                    break
            return taken

        for free in sorted(r for r in room if r >= length):
            groups = room.pop(free)
            while groups and left:
                first, n = groups.pop()
                taken = fill(first, n, free)
                if taken < n:
                    groups.append((first + taken, n - taken))
            if groups:
                room.setdefault(free, []).extend(groups)
            if not left:
                break
        if left:
            used += fill(used, left, capacity)
    return np.array(rows, np.int64).reshape(-1, 6)


def place(slots):
    """Sequence and offset of each piece from its length and rank; ``slots`` broadcasts the plan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = slots.value
        order = np.lexsort((table[:, 1], table[:, 0]))
        table = table[order]
        span = int(table[:, 1].max()) + int(table[:, 2].max() * table[:, 3].max()) + 1 if len(table) else 1
        keys = [int(x) * span + int(y) for x, y in zip(table[:, 0], table[:, 1])]
        wide = np.array(keys, object if keys and keys[-1] >= 1 << 62 else np.int64)
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            row = table[np.searchsorted(wide, length.astype(wide.dtype) * span + rank, "right") - 1]
            at = rank - row[:, 1]
            yield pa.record_batch(
                [*[b.column(c) for c in b.schema.names if c != "rank"], pa.array(row[:, 4] + at // row[:, 3]), pa.array(row[:, 5] + at % row[:, 3] * length)],
                [*[c for c in b.schema.names if c != "rank"], "sequence_id", "offset"],
            )

    return run


def pack(
    docs: DataFrame, path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """Pack every document's tokens, closed by id 0, into sequences of ``capacity``.

    ``path`` is a tokenizer file that each executor has.  Only documents longer than a
    sequence are cut.  The driver sees one count per length (``capacity`` at most) and
    plans sequences over counts; a piece takes the slot of its rank within its length.
    Ranks are counted in hashed parts of a length, so a common length is no task of its
    own.  Returns a row per piece: ``id``, ``version`` (a hash of the text), ``piece``,
    ``start``, ``length``, ``ids_crc32``, ``ids`` (bytes, where ``with_ids``), ``sequence_id``
    and ``offset``.  A null id counts as the smallest bigint, a null or empty text is the
    one token 0; repeated rows are packed each.  Other columns are not read.
    """
    texts = lean(docs).select(
        ident(id_col).alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")
    ).withColumn("version", F.xxhash64("text"))
    schema = "id bigint, version bigint, piece int, length bigint, ids_crc32 bigint, ids binary"
    pieces = stored(texts.mapInArrow(tokenise(path, capacity, with_ids), schema), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    slots = docs.sparkSession.sparkContext.broadcast(plan(counts, capacity))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(counts.values(), default=0) // max(RANK_ROWS, sum(counts.values()) // (4 * tasks)) + 1
    keyed = pieces.withColumn("part", F.pmod(F.xxhash64("id", "piece", "version"), F.lit(parts)))
    inner = Window.partitionBy("length", "part").orderBy("id", "version", "piece")
    ranked = keyed.withColumn("rank", F.row_number().over(inner).cast("bigint") - 1)
    if parts > 1:
        before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        sizes = keyed.groupBy("length", "part").count()
        sizes = sizes.select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
        ranked = ranked.join(sizes, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("before"))
    ranked = ranked.select("id", "version", "piece", (F.col("piece") * F.lit(capacity)).cast("bigint").alias("start"), "length", "ids_crc32", "ids", "rank")
    return ranked.mapInArrow(
        place(slots),
        "id bigint, version bigint, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary, sequence_id bigint, offset bigint",
    )
