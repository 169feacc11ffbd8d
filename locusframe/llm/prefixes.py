"""Trie of conversation prefixes in slot tables of a minimal perfect hash.

A conversation lies in one shard, and a shard holds at most a set number of turns (a
longer conversation is a shard of its own), so a beginning that very many share is
spread like any other.  Each shard enumerates the digests of its prefixes, gives each a
slot by a minimal perfect hash that is checked against the digests themselves, and
counts in flat arrays; Spark adds the shards' counts up by digest.  With the totals
written back to the slots, every shard sums its nodes up through the array of parent
slots, deepest first, and Spark adds the sums.  A node that several shards know is
counted where its smallest member is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_ID, ident, lean, stored
from .words import U, mix

#: Turns that one shard holds, rows handed on at once, and characters of a joined list of members.
SHARD_TURNS, ROWS, LIST_CHARS = 200_000, 50_000, 1 << 16
_WORD = r"[^\x20\x09-\x0D]+"
_TURN, _ROOT = b"turn", hashlib.blake2b(b"", digest_size=16).digest()
_EMPTY = hashlib.sha256(b"").hexdigest()


class Slots:
    """Minimal perfect hash of distinct 128-bit digests.

    On each level, the digests that are alone in their cell of a bit array get the next
    slots; the others go on to the next level.  ``find`` compares what lies in a slot.
    """

    def __init__(self, keys: np.ndarray):
        self.levels, self.keys = [], np.zeros_like(keys)
        slot = np.zeros(len(keys), np.int64)
        left, base = np.arange(len(keys)), 0
        while len(left):
            cell = self._cell(keys[left], len(self.levels), 2 * len(left))
            alone = np.bincount(cell, minlength=2 * len(left)) == 1
            rank = np.cumsum(alone) - 1 + base
            won = alone[cell]
            slot[left[won]] = rank[cell[won]]
            self.levels.append((alone, rank))
            base, left = base + int(alone.sum()), left[~won]
        self.keys[slot] = keys

    @staticmethod
    def _cell(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys[:, 0] ^ mix(keys[:, 1] + U(level))) % U(size)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each digest; raises for one that has none."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (alone, rank) in enumerate(self.levels):
            cell = self._cell(keys[left], level, len(alone))
            hit = alone[cell]
            out[left[hit]] = rank[cell[hit]]
            left = left[~hit]
            if not len(left):
                break
        if len(left) or (self.keys[out] != keys).any():
            raise ValueError("a digest that the table does not hold")
        return out


def _digests(values: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(values), U).reshape(-1, 2)


def _binary(keys: np.ndarray) -> pa.Array:
    """The digests as a column of 16 bytes each."""
    data = np.ascontiguousarray(keys)
    return pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(np.arange(len(keys) + 1, dtype=np.int32) * 16), pa.py_buffer(data)])


_NODES = "shard string, slot int, parent int, depth int, words int, n bigint, n_ends bigint, conv bigint, node binary, turn binary"
_NAMES = [f.split()[0] for f in _NODES.split(", ")]


class Shard:
    """Conversations of a shard, in order: what each of their prefixes ends with."""

    def __init__(self, name: str):
        self.name, self.nodes, self.turns, self.convs, self.depths, self.words = name, [], [], [], [], []
        self.ends: list[tuple[int, bytes]] = []

    def table(self) -> Iterator[pa.RecordBatch]:
        """The shard's nodes by slot; then a row without slot per conversation, with the node it ends at."""
        all_keys = _digests(self.nodes)
        keys, first = np.unique(np.ascontiguousarray(all_keys).view("V16").ravel(), return_index=True)
        keys = all_keys[first]
        slots = Slots(keys)
        at = slots.find(all_keys)
        n = len(keys)
        count = np.bincount(at, minlength=n)
        conv = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(conv, at, np.array(self.convs))
        ends = np.bincount(slots.find(_digests([e[1] for e in self.ends])), minlength=n)
        depth, words, parent = np.zeros(n, np.int32), np.zeros(n, np.int32), np.full(n, -1, np.int64)
        depth[at], words[at] = np.array(self.depths, np.int32), np.array(self.words, np.int32)
        below = np.flatnonzero(np.array(self.depths) > 0)  # the row before is the prefix that is one turn shorter
        parent[at[below]] = at[below - 1]
        turn = np.zeros((n, 2), U)
        turn[at] = _digests(self.turns)
        for lo in range(0, n, ROWS):
            p = slice(lo, lo + ROWS)
            m = len(count[p])
            cols = [
                pa.array([self.name] * m), pa.array(np.arange(n, dtype=np.int32)[p]), pa.array(parent[p].astype(np.int32)), pa.array(depth[p]),
                pa.array(words[p]), pa.array(count[p]), pa.array(ends[p]), pa.array(conv[p]), _binary(slots.keys[p]), _binary(turn[p]),
            ]
            yield pa.record_batch(cols, _NAMES)
        for lo in range(0, len(self.ends), ROWS):
            some = self.ends[lo : lo + ROWS]
            none = pa.nulls(len(some), pa.int32())
            long = pa.nulls(len(some), pa.int64())
            cols = [
                pa.array([self.name] * len(some)), none, none, none, none, long, long, pa.array([e[0] for e in some], pa.int64()),
                pa.array([e[1] for e in some], pa.binary()), pa.nulls(len(some), pa.binary()),
            ]
            yield pa.record_batch(cols, _NAMES)


def shards(most: int):
    """Cut a partition, sorted by conversation and place, into shards of at most ``most`` turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k = TaskContext.get().partitionId(), 0
        shard, conv, digest, depth = Shard(f"{part}-0"), None, _ROOT, 0
        for b in batches:
            for c, turn, words in zip(*(b.column(x).to_pylist() for x in ("conv", "turn", "words"))):
                if turn is None:  # the root, of every conversation first
                    if conv is not None:
                        shard.ends.append((conv, digest))
                    if len(shard.nodes) >= most:
                        yield from shard.table()
                        k += 1
                        shard = Shard(f"{part}-{k}")
                    conv, digest, depth, turn = c, _ROOT, 0, _ROOT
                else:
                    digest, depth = hashlib.blake2b(digest + turn, digest_size=16, person=_TURN).digest(), depth + 1
                shard.nodes.append(digest)
                shard.turns.append(turn)
                shard.convs.append(c)
                shard.depths.append(depth)
                shard.words.append(words)
        if conv is not None:
            shard.ends.append((conv, digest))
            yield from shard.table()

    return run


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of each node of a shard over its subtree, through parent slots; rows come by shard."""

    def close(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        get = lambda c: t.column(c).to_numpy()
        n = t.num_rows
        slot = get("slot")
        parent, depth, conv, own = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
        children, leaves, tokens = (np.zeros(n, np.int64) for _ in range(3))
        parent[slot], depth[slot], conv[slot], own[slot] = get("parent"), get("depth"), get("owner"), get("own")
        leaves[slot] = get("own") & (get("all") == get("all_ends"))
        tokens[slot] = np.where(get("own"), (get("all") - 1) * get("words"), 0)
        up = np.flatnonzero(own & (parent >= 0))
        np.add.at(children, parent[up], 1)
        order = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[order], np.arange(depth.max() + 2))
        for d in range(int(depth.max()), 0, -1):
            at = order[cuts[d] : cuts[d + 1]]
            np.add.at(leaves, parent[at], leaves[at])
            np.add.at(tokens, parent[at], tokens[at])
        above = np.where(parent >= 0, conv[np.maximum(parent, 0)], 0)
        cols = [
            *[t.column(c).combine_chunks() for c in ("node", "depth", "owner", "all", "own")],
            *[pa.array(x[slot]) for x in (children, leaves, tokens)], pa.array(above[slot], mask=(parent < 0)[slot]),
        ]
        out = pa.table(cols, ["node", "depth", "conv", "n_convs", "own", "children", "leaves", "tokens", "above"])
        yield from out.to_batches(max_chunksize=ROWS)

    held: list[pa.RecordBatch] = []
    for b in batches:
        lo = 0
        names = b.column("shard").to_pylist()
        while lo < b.num_rows:
            hi = lo + 1
            while hi < b.num_rows and names[hi] == names[lo]:
                hi += 1
            if held and held[0].column("shard")[0].as_py() != names[lo]:
                yield from close(held)
                held = []
            held.append(b.slice(lo, hi - lo))
            lo = hi
    if held:
        yield from close(held)


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members that end at one node, in order, joined to texts of bounded length."""
    node, first, parts, size = None, None, [], 0

    def packed():
        return pa.record_batch(
            [pa.array([node], pa.binary()), pa.array([first], pa.int64()), pa.array([",".join(parts)])], ["node", "first", "members"]
        )

    for b in batches:
        for x, c in zip(b.column("node").to_pylist(), b.column("conv").to_pylist()):
            if parts and (x != node or size > LIST_CHARS):
                yield packed()
                parts, size = [], 0
            if not parts:
                node, first = x, c
            parts.append("" if c == NO_ID else str(c))
            size += len(parts[-1]) + 1
    if parts:
        yield packed()


def list_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's joined texts, which come in order."""
    node, sha = None, None
    for b in batches:
        nodes, shas = [], []
        for x, text in zip(b.column("node").to_pylist(), b.column("members").to_pylist()):
            if x == node:
                sha.update(b"," + text.encode())
                continue
            if node is not None:
                nodes.append(node)
                shas.append(sha.hexdigest())
            node, sha = x, hashlib.sha256(text.encode())
        yield pa.record_batch([pa.array(nodes, pa.binary()), pa.array(shas, pa.string())], ["node", "sha"])
    if node is not None:
        yield pa.record_batch([pa.array([node], pa.binary()), pa.array([sha.hexdigest()])], ["node", "sha"])


def rebuilt(turns: DataFrame, block: int, borrowed: int) -> DataFrame:
    """Turns of every rebuilt conversation: (conv, place, turn, words); place 0, without a turn, is the root.

    ``turns`` has (conv, nth, turn, words).  A conversation takes the place of its first h
    turns from the first of its block, h being crc32 of its decimal number modulo
    ``borrowed`` + 1; the first of a block gives a bounded number of rows to each of a
    bounded number of conversations.
    """
    text = F.when(F.col("conv") == NO_ID, F.lit("")).otherwise(F.col("conv").cast("string"))
    h = (F.crc32(text.cast("binary")) % (borrowed + 1)).cast("int")
    head = F.when(F.col("conv") == NO_ID, F.col("conv")).otherwise(F.col("conv") - F.col("conv") % block)
    convs = turns.filter("nth = 1").select("conv", h.alias("h"), head.alias("head"))
    own = turns.filter(F.col("nth") > h).select("conv", (F.col("nth") + F.lit(borrowed)).alias("place"), "turn", "words")
    given = turns.filter((F.col("nth") <= borrowed) & (F.col("conv") == head)).select(F.col("conv").alias("head"), "nth", "turn", "words")
    lent = convs.filter("h > 0").join(given, "head").filter("nth <= h").select("conv", F.col("nth").alias("place"), "turn", "words")
    root = convs.select("conv", F.lit(0).alias("place"), F.lit(None).cast("binary").alias("turn"), F.lit(0).alias("words"))
    return own.unionByName(lent).unionByName(root)


def prefix_trie(
    convs: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    block: int = 20, borrowed: int = 3, shard_turns: int = SHARD_TURNS,
) -> DataFrame:
    """Nodes of the trie of all conversations, after ``rebuilt``.

    Turns are taken by ``turn_col``, null first; rows of one turn by role, then digest.  A null
    role or text is empty; a null conversation counts as the smallest bigint, with the empty
    text as its number, and keeps its own turns.  Rows that repeat are turns each.  Other
    columns are not read.

    Returns a row per distinct prefix, the empty one included: ``node`` (digest), ``depth``,
    ``conv`` (smallest member), ``above`` (that of the parent; null for the root), ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256``.  An empty table has no rows.

    A shard's arrays take some 200 bytes a turn; beyond ``shard_turns`` only a single
    conversation makes a shard longer.  Lists of members are joined in range partitions, so
    the many copies of one conversation reach their digest as a few long texts.
    """
    role, text = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (role_col, text_col))
    # the length keeps role and text apart
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    turns = lean(convs).select(
        ident(conv_col).alias("conv"), F.col(f"`{turn_col}`").alias("at"), role.alias("role"), digest.alias("turn"),
        F.regexp_count(text, F.lit(_WORD)).alias("words"),
    )
    order = Window.partitionBy("conv").orderBy(F.col("at").asc_nulls_first(), "role", "turn")
    turns = stored(turns.withColumn("nth", F.row_number().over(order)).select("conv", "nth", "turn", "words"), "turns")
    rows = rebuilt(turns, block, borrowed).repartition("conv").sortWithinPartitions("conv", "place")
    local = stored(rows.select("conv", "turn", "words").mapInArrow(shards(shard_turns), _NODES), "nodes")
    nodes = local.filter("slot is not null")
    # equal digests must mean equal turns at equal depth
    same = (F.min("turn") == F.max("turn")) & (F.min("depth") == F.max("depth"))
    total = nodes.groupBy("node").agg(
        F.when(same, F.sum("n")).otherwise(F.raise_error("two prefixes share a digest").cast("bigint")).alias("all"),
        F.sum("n_ends").alias("all_ends"), F.min("conv").alias("owner"),
    )
    placed = nodes.join(total, "node").select(
        "shard", "slot", "parent", "depth", "words", "node", "all", "all_ends", "owner", (F.col("conv") == F.col("owner")).alias("own")
    )
    sums = placed.repartition("shard").sortWithinPartitions("shard").mapInArrow(
        summed,
        "node binary, depth int, conv bigint, n_convs bigint, own boolean, children bigint, leaves bigint, tokens bigint, above bigint",
    )
    found = sums.groupBy("node").agg(
        F.max("depth").alias("depth"), F.min("conv").alias("conv"), F.max("above").alias("above"), F.max("n_convs").alias("n_convs"),
        F.sum("children").alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("tokens").alias("saved_tokens"),
    )
    ends = local.filter("slot is null").select("node", "conv").repartitionByRange("node", "conv").sortWithinPartitions("node", "conv")
    lists = ends.mapInArrow(joined, "node binary, first bigint, members string").repartition("node").sortWithinPartitions("node", "first")
    shas = lists.select("node", "members").mapInArrow(list_digests, "node binary, sha string")
    return found.join(shas, "node", "left").withColumn("ends_sha256", F.coalesce("sha", F.lit(_EMPTY))).drop("sha")
