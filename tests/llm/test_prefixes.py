"""The trie against nested dictionaries, and the slot table by itself."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from locusframe.llm import prefixes
from locusframe.llm.prefixes import Slots, prefix_trie

LOW = -(1 << 63)
NAMES = "conv_id bigint, turn bigint, role string, text string, conv string, node int, slot int, shard string, nth int, own int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, "s", 3, 4) for r in rows], NAMES)


def brute(rows, block=20, borrowed=3):
    """Rows of one turn come in any order here, so tests have none of different text."""
    own = {}
    for c, n, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        own.setdefault(c, []).append((role or "", text or ""))
    nodes = {}
    for c, turns in own.items():
        h = zlib.crc32(b"" if c is None else str(c).encode()) % (borrowed + 1)
        head = own.get(None if c is None else c - c % block, [])[:h]
        path = tuple(head + turns[h:])
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append((LOW if c is None else c, d == len(path)))
    out = []
    for path, members in nodes.items():
        sub = [p for p in nodes if p[: len(path)] == path]
        kids = [p for p in nodes if len(p) == len(path) + 1 and p[:-1] == path]
        leaves = [p for p in sub if not any(len(q) == len(p) + 1 and q[:-1] == p for q in nodes)]
        words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        ends = ",".join("" if c == LOW else str(c) for c, e in sorted(members) if e)
        out.append((
            min(c for c, _ in members), len(path), min(c for c, _ in nodes[path[:-1]]) if path else None, len(members), len(kids), len(leaves),
            sum((len(nodes[p]) - 1) * words(p) for p in sub), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


COLS = ["conv", "depth", "above", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("most", [1, 7, 100_000])
def test_against_dictionaries(spark, monkeypatch, most):
    rng = random.Random(most)
    monkeypatch.setattr(prefixes, "LIST_CHARS", 5)
    rows = []
    for c in [*range(60), 1000, 1003, -5, -40]:
        for n in range(rng.randrange(1, 7)):
            rows.append((c, n, rng.choice(["user", "assistant", None]), rng.choice(["a b", "c", "", None, " \t"])))
    rows += [(200 + k, n, "user", "same start" if n < 3 else f"then {k % 3}") for k in range(30) for n in range(4)]
    rows += [(300 + k, n, "user", "all the same") for k in range(25) for n in range(5)]
    rows += [(500, n, "user", f"long {n} " * 3) for n in range(150)]
    rows += [(None, 0, "user", "a b"), (None, 1, None, None), (600, None, "user", "first"), (600, 0, "user", "second"), (601, None, None, None)]
    rows += [(602, 1, "user", "twice"), (602, 1, "user", "twice")]
    rows += [(603, 0, "ab", "c"), (604, 0, "a", "bc"), (605, 0, "", "abc")]
    # Spark's and DuckDB's remainder has the sign of the number, so negative heads are 0
    got = prefix_trie(table(spark, rows).repartition(5), shard_turns=most).select(*COLS).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_with(rows, {-5: 0, -40: -40})


def brute_with(rows, heads):
    """``brute`` with the first of the block given for some conversations."""

    class Number(int):
        def __mod__(self, other):
            return int(self) - heads[int(self)]

    return brute([(Number(c) if c in heads else c, *r) for c, *r in rows])


def test_empty(spark):
    assert prefix_trie(table(spark, [(1, 1, "a", "b")]).limit(0)).count() == 0


def test_slots():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 20000):
        keys = np.unique(rng.integers(0, 1 << 63, (n, 2), dtype=np.uint64), axis=0)
        keys[: n // 3, 1] = 7
        keys = np.unique(keys, axis=0)
        table = Slots(keys)
        assert sorted(table.find(keys).tolist()) == list(range(len(keys)))
        if n:
            with pytest.raises(ValueError):
                table.find(np.array([[1, 2]], np.uint64))
