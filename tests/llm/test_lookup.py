"""Sketch fingerprints against set arithmetic."""

import base64
import hashlib
import random
import struct

import regex
from odd import LOW, TEXTS, docs

from locusframe.llm.lookup import _inline, differing, fingerprints, paragraphs

WORD = r"\S++[^\S\n]*+"
PARAGRAPH = regex.compile(rf"(?:{WORD}){{8,24}}?(?:(?<=[.!?] )|(?=\n)|\Z)|(?:{WORD}){{1,24}}", regex.ASCII)


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_texts(spark):
    rng = random.Random(3)
    line = lambda: " ".join("abcdefg"[rng.randrange(7)] * rng.randrange(1, 4) for _ in range(rng.randrange(1, 40))) + rng.choice([". ", "\n", "!\n", " "])
    rows = [(3 * k, "".join(line() for _ in range(rng.randrange(0, 12)))) for k in range(50)] + [(k, t) for k, t in TEXTS if k not in (6, 9, None)]
    rows = list({k: t for k, t in rows}.items()) + [(None, "the smallest")]
    got = {r["id"]: r for r in fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()}
    order = sorted(((LOW if i is None else i, t or "") for i, t in rows), reverse=True)
    cut = lambda t: set(PARAGRAPH.findall(t))
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        edited = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        r = got[i]
        assert (r["n_chars"], r["edited"]) == (len(t), edited)
        assert abs(r["near_edited"] - likeness(cut(t), cut(edited))) < 1e-9
        assert abs(r["near_next"] - likeness(cut(t), cut(after))) < 1e-9
        assert len(r["differing"]) == len(cut(t) ^ cut(edited))


def test_edges(spark):
    got = fingerprints(docs(spark)).collect()
    assert len(got) == len(TEXTS)
    prints = {}
    for r in got:
        prints.setdefault(r["id"], set()).add(r["fingerprint"])
    assert prints[1] == prints[9] and prints[2] == prints[3] and prints[1] != prints[12] and len(prints[6]) == 1
    assert fingerprints(docs(spark).limit(0)).count() == 0
    one = fingerprints(docs(spark, [(1, "only one")])).first()
    assert (one["near_next"], one["edited"]) == (1.0, "only oon")


def test_stuck_parts_are_tried_again(spark, monkeypatch):
    """With one part for everything, first attempts fail and larger ones, or plain difference, finish."""
    monkeypatch.setattr("locusframe.llm.lookup.PART_DIGESTS", 400)
    rows = spark.createDataFrame([(k, list(range(0, 40 * k)), list(range(20 * k, 60 * k))) for k in range(8)], "k int, a array<int>, b array<int>")
    rows = _inline(rows, {"x": "transform(a, v -> xxhash64(v))", "y": "transform(b, v -> xxhash64(v))"}).drop("a", "b")
    for r in differing(rows, "x", {"out": "y"}).collect():
        assert {(f["k"], f["c"]) for f in r["out"]} == {(k, 1) for k in set(r["x"]) - set(r["y"])} | {(k, -1) for k in set(r["y"]) - set(r["x"])}
        assert len(r["out"]) == 40 * r["k"]


def test_equal_texts_equal_prints(spark):
    digest = hashlib.sha256
    frame = spark.createDataFrame([(1, "same text. twice"), (2, "same text. twice")], "doc_id int, text string")
    a, b = fingerprints(frame).collect()
    assert a["fingerprint"] == b["fingerprint"] and digest(a["edited"].encode()).digest() == digest(b["edited"].encode()).digest()
    assert paragraphs("x")


def test_returned_prints_peel(spark):
    """Subtracting the two returned fingerprints gives away the digests that an edit changed, on long texts too."""
    rng = random.Random(5)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" + "." * (rng.randrange(9) == 0) for _ in range(n))
    rows = [(k, words(n)) for k, n in enumerate((2500, 2400, 2600, 30, 2500, 2450))]
    whole = 0
    for r in fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        raw = [base64.b64decode(r[c]) for c in ("fingerprint", "edited_fingerprint")]
        assert len(raw[0]) % 480 == 0
        sides = [list(struct.iter_unpack(">iQQ", x)) for x in raw]
        n = min(map(len, sides)) // 24
        sides = [[fold(s, n, j) for j in range(24 * n)] for s in sides]
        left = [[a - b, p ^ q, x ^ y] for (a, p, x), (b, q, y) in zip(*sides)]
        want = {f["k"] % 2**64: f["c"] for f in r["differing"]}
        check = {f["k"] % 2**64: f["x"] % 2**64 for f in spark.createDataFrame(r["differing"], "c int, k bigint").selectExpr("k", "xxhash64(k) as x").collect()}
        found = {}
        while pure := [z for z in left if abs(z[0]) == 1 and check.get(z[1]) == z[2]]:
            c, k, x = pure[0]
            found[k] = c
            for t in range(3):
                z = left[(k >> 27) % n * 24 + 8 * t + (k >> 3 * t) % 8]
                z[0], z[1], z[2] = z[0] - c, z[1] ^ k, z[2] ^ x
        assert found.items() <= want.items()
        whole += found == want and not any(map(any, left))
        assert r["n_chars"] < 1000 or len(want) > 18
    assert whole >= 4


def fold(cells, n, j):
    """Cell ``j`` of a sketch brought to ``n`` parts."""
    c = k = x = 0
    for a, p, q in cells[j :: 24 * n]:
        c, k, x = c + a, k ^ p, x ^ q
    return c, k, x
