"""Packing: the plan by itself, and ids against the tokenizer."""

import random
import zlib

import numpy as np
import public_tokenizers as P
from odd import TEXTS, docs
from tokenizers import Tokenizer

from locusframe.llm.packing import Chunks, pack, plan

PATH = P.path("word_bpe_49k.json")


def gapless(places, capacity):
    """Sequences filled from 0 without a gap; returns how many."""
    held = {}
    for sequence, offset, length in places:
        held.setdefault(sequence, []).append((offset, length))
    for some in held.values():
        at = 0
        for offset, length in sorted(some):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def test_plan():
    rng = random.Random(1)
    for _ in range(200):
        capacity = rng.choice([8, 16, 64])
        counts = {rng.randrange(1, capacity + 1): rng.randrange(1, 40) for _ in range(rng.randrange(1, 9))}
        ranks, places = {}, []
        for length, rank, m, each, sequence, offset in plan(counts, capacity).tolist():
            for k in range(m * each):
                ranks.setdefault(length, []).append(rank + k)
                places.append((sequence + k // each, offset + k % each * length, length))
        assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in counts.items()}
        # one document after another, each to the fullest sequence that takes it
        room = []
        for length in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
            best = min((r for r in room if r >= length), default=None)
            if best is None:
                room.append(capacity - length)
            else:
                room[room.index(best)] = best - length
        assert gapless(places, capacity) == len(room)
    assert len(plan({}, 8)) == 0


def test_ids():
    own, rng, library = Chunks(PATH), random.Random(7), Tokenizer.from_file(PATH)
    texts = ["it's we'll, 'tis don't!' a's,'s", "É ß ẞ ΣΑΣ İi ŉ ﬁ", "a≮ ≠ x", "日本語 ТЕКСТ. ½ 1,234.5 <|endoftext|>,", "—, é, ñ!?'re", "\x1c a\x85b"]
    texts += ["hello <|endoftext|> world", "<|startoftext|> q", "a<|endoftext|>b.<|ENDOFTEXT|>", "x<|startoftext|>", "<|endoftext|", "|endoftext|> <|endof text|>"]
    texts += ["".join(rng.choice(["<|endoftext|>", "<|startoftext|>", "<|", "|>", " ", "a", "é", ".", "endoftext"]) for _ in range(8)) for _ in range(200)]
    texts += ["".join(rng.choice("abÉñ'.,! \n1–sSΣ́İ") for _ in range(50)) for _ in range(300)]
    for text, ids in zip(texts, own.ids([t.encode() for t in texts])):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_edges(spark):
    tokenizer, capacity = Tokenizer.from_file(PATH), 64
    rows = [*TEXTS, (40, "hello <|endoftext|> world"), (41, "<|startoftext|> q")]
    got = pack(docs(spark, rows).repartition(3), PATH, capacity, with_ids=True).collect()
    exp = []
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), capacity):
            part = np.array(ids[k : k + capacity], "<u4").tobytes()
            exp.append((-(1 << 63) if i is None else i, k // capacity, k, len(part) // 4, zlib.crc32(part), part))
    assert sorted((r["id"], r["piece"], r["start"], r["length"], r["ids_crc32"], bytes(r["ids"])) for r in got) == sorted(exp)
    used = gapless([(r["sequence_id"], r["offset"], r["length"]) for r in got], capacity)
    assert used <= -(-sum(e[3] for e in exp) // capacity) + 1
    assert pack(docs(spark).limit(0), PATH, capacity).count() == 0


def test_ranks_over_parts(spark, monkeypatch):
    monkeypatch.setattr("locusframe.llm.packing.RANK_ROWS", 3)
    rows = [(k, "a") for k in range(200)] + [(500 + k, "a b") for k in range(100)]
    got = pack(docs(spark, rows), PATH, 16).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == 300
    assert gapless([(r["sequence_id"], r["offset"], r["length"]) for r in got], 16) == 20 + 25
