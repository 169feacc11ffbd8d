"""Exact duplicates by Patricia tries that own the texts of a hash partition."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_ROWS, ident, lean, slices, stored

_SPACE = b" \t\n\x0b\x0c\r"
TRIE_BYTES = 48 << 20
#: Bytes of distinct texts that a task holds before they go to the partition of their hash.
COMBINED_BYTES = 24 << 20


class Owner:
    """What a terminal node holds: the row that stays, and how many rows share the text."""

    __slots__ = ("chars", "id", "version", "n", "digest")

    def __init__(self, chars: int, id: int, version: int, n: int, digest: str):
        self.chars, self.id, self.version, self.n, self.digest = chars, id, version, n, digest

    def absorb(self, chars: int, id: int, version: int, n: int) -> None:
        if (-chars, id, version) < (-self.chars, self.id, self.version):
            self.chars, self.id, self.version = chars, id, version
        self.n += n


class Node:
    __slots__ = ("label", "below", "owner")

    def __init__(self, label: bytes, owner: Owner | None = None):
        self.label, self.below, self.owner = label, {}, owner


def _agree(text: bytes, at: int, label: bytes) -> int:
    """Length of the common start of text[at:] and label, by halving."""
    lo, hi = 0, min(len(label), len(text) - at)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if text[at + lo : at + mid] == label[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


class Trie:
    """Compressed radix trie over whole byte strings.

    When the labels exceed ``most`` bytes, the largest subtree below the root is
    handed out and dropped; a text that comes again gets a second owner, and
    owners of one digest are merged later.
    """

    def __init__(self, most: int = TRIE_BYTES):
        self.root, self.most, self.held, self.weight = Node(b""), most, 0, {}

    def add(self, text: bytes, chars: int, id: int, version: int, n: int, digest: str) -> Iterator[Owner]:
        node, at = self.root, 0
        while at < len(text):
            child = node.below.get(text[at])
            if child is None:
                child = node.below[text[at]] = Node(text[at:])
                self.held += len(child.label)
                self.weight[text[0]] = self.weight.get(text[0], 0) + len(child.label)
            k = len(child.label) if text.startswith(child.label, at) else _agree(text, at, child.label)
            if k < len(child.label):
                upper = node.below[text[at]] = Node(child.label[:k])
                child.label = child.label[k:]
                upper.below[child.label[0]] = child
                child = upper
            node, at = child, at + k
        if node.owner is None:
            node.owner = Owner(chars, id, version, n, digest)
        else:
            node.owner.absorb(chars, id, version, n)
        if self.held > self.most:
            largest = max(self.weight, key=self.weight.get)
            self.held -= self.weight.pop(largest)
            yield from self.owners(self.root.below.pop(largest))

    def owners(self, node: Node | None = None) -> Iterator[Owner]:
        todo = [node or self.root]
        while todo:
            node = todo.pop()
            if node.owner is not None:
                yield node.owner
            todo.extend(node.below.values())


def _bodies(batch: pa.RecordBatch) -> list[bytes]:
    return [x.translate(None, _SPACE) for x in batch.column("text").cast(pa.binary()).to_pylist()]


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each row's text without white space."""
    for b in slices(batches, "text", 8 << 20):
        shas = [hashlib.sha256(x).hexdigest() for x in _bodies(b)]
        yield pa.record_batch([b.column("id"), b.column("version"), pa.array(shas, pa.string())], ["id", "version", "digest"])


_ROW = ("chars", "id", "version", "n")


def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct texts of a task, with the row that would stay and how many rows have them.

    When the texts exceed ``COMBINED_BYTES``, those met once are handed on, and the
    others too if they still fill half of it; so a very common text is handed on once or
    a few times by a task, not once per batch.
    """
    best: dict[bytes, list] = {}
    size = 0

    def packed(texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(texts), BATCH_ROWS):
            some = texts[lo : lo + BATCH_ROWS]
            rows = [best.pop(x) for x in some]
            hashes = [int.from_bytes(hashlib.sha256(x).digest()[:8], "little", signed=True) for x in some]
            yield pa.record_batch(
                [pa.array([len(x) for x in some], pa.int64()), pa.array(hashes, pa.int64()), pa.array(some, pa.binary()), *[pa.array([r[k] for r in rows], pa.int64()) for k in range(4)]],
                ["size", "hash", "body", *_ROW],
            )

    for b in slices(batches, "text", 8 << 20):
        for x, chars, id, version in zip(_bodies(b), *(b.column(c).to_pylist() for c in ("chars", "id", "version"))):
            old = best.get(x)
            if old is None:
                best[x] = [chars, id, version, 1]
                size += len(x)
            else:
                old[3] += 1
                if (-chars, id, version) < (-old[0], old[1], old[2]):
                    old[:3] = chars, id, version
        if size > COMBINED_BYTES:
            yield from packed([x for x, r in best.items() if r[3] == 1])
            size = sum(map(len, best))
            if size > COMBINED_BYTES // 2:
                yield from packed(list(best))
                size = 0
    yield from packed(list(best))


def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Insert a partition's texts into one trie and hand out its owners."""

    def packed(owners: list[Owner]) -> pa.RecordBatch:
        return pa.record_batch(
            [pa.array([o.digest for o in owners], pa.string()), *[pa.array([getattr(o, k) for o in owners], pa.int64()) for k in _ROW]],
            ["digest", *_ROW],
        )

    trie = Trie()
    for b in slices(batches, "body", 8 << 20):
        cols = [b.column(c).to_pylist() for c in ("body", *_ROW)]
        spilled = [o for x, *row in zip(*cols) for o in trie.add(x, *row, hashlib.sha256(x).hexdigest())]
        if spilled:
            yield packed(spilled)
    yield packed(list(trie.owners()))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of texts that are identical without space and \\x09-\\x0D.

    Texts go to partitions by length and content hash; copies are
    combined before that within each task, so a text that fills a third of the table
    reaches its trie once or a few times per task of the scan.  A trie compares whole byte strings, keeps in each
    terminal node the row with the most code points, then the smallest id, and
    spills subtrees.

    Returns a row per input row: ``id``, ``version`` (a hash of the text), ``keep_id``,
    ``group_size``, ``kept`` and ``digest`` (SHA-256 of the compared bytes).  A null text
    counts as empty and a null id as the smallest bigint.  Of equal texts under one id, as
    where ids are null, the one with the smaller version stays; rows that repeat id and
    text all count in ``group_size`` and get equal results.  Other columns are not read.
    """
    texts = lean(docs).select(
        ident(id_col).alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")
    ).withColumns({"version": F.xxhash64("text"), "chars": F.length("text").cast("bigint")})
    row = "chars bigint, id bigint, version bigint, n bigint"
    parts = texts.select("id", "version", "chars", "text").mapInArrow(combined, "size bigint, hash bigint, body binary, " + row)
    owners = parts.repartition("size", "hash").select("body", *_ROW).mapInArrow(own, "digest string, " + row)
    owners = stored(
        owners.groupBy("digest").agg(
            F.min(F.struct(-F.col("chars"), "id", "version")).alias("o"), F.sum("n").alias("group_size")
        ).select("digest", F.col("o.id").alias("keep_id"), F.col("o.version").alias("keep_version"), "group_size"),
        "owners",
    )
    rows = texts.select("id", "version", "text").mapInArrow(digests, "id bigint, version bigint, digest string")
    return rows.join(owners, "digest").select(
        "id", "version", "keep_id", "group_size", ((F.col("id") == F.col("keep_id")) & (F.col("version") == F.col("keep_version"))).alias("kept"), "digest"
    )
