"""Alignment against plain loops over both libraries' tokens."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
from odd import TEXTS, docs
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from locusframe.llm import align as module
from locusframe.llm.align import Aligner, align, lanes, linked, lockstep

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
MORE = [
    (20, "<|endoftext|> and </s> <s> <unk> are text"), (21, "  two  spaces   and a tail  "), (22, " "), (23, "a▁b"), (24, "  　 é ﬁ Å"),
    (25, "line\nline\r\n\ttab" + "\n" * 30), (26, "🙂🙃👩‍👩‍👧 한국어 العربية"), (27, "the the the cat the"), (28, "x y " * 2000), (29, "\0\x01\x7f"), (30, "of the cat"),
]


def brute(rows):
    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    back = {c: k for k, c in enumerate_signs().items()}
    names = {k: t for t, k in a.get_vocab(with_added_tokens=False).items()}
    known, seen = [], {}
    for i, t in rows:
        groups = []
        if t:
            x = a.encode(" " + t, add_special_tokens=False).ids
            y = b.encode(t)
            bx = [bytes(back[c] for c in names[k]) for k in x]
            by = [bytes([int(p[3:5], 16)]) if b.is_byte(k) else p.replace("▁", " ").encode() for k, p in ((k, b.id_to_piece(k)) for k in y)]
            if b"".join(bx) == b"".join(by) == b" " + t.encode():
                ends = lambda s: np.cumsum([len(z) for z in s]).tolist()
                cuts = sorted(set(ends(bx)) & set(ends(by)))
                ex, ey, lo = ends(bx), ends(by), 0
                for c in cuts:
                    groups.append(([k for k, e in zip(x, ex) if lo < e <= c], [k for k, e in zip(y, ey) if lo < e <= c])) if len(x) < 3000 else None
                    lo = c
                if len(x) >= 3000:
                    groups = fast(x, y, ex, ey, set(cuts))
        pairs = {(p, q) for g in groups for p in g[0] for q in g[1]}
        for p in pairs:
            seen[p] = seen.get(p, 0) + 1
        known.append((i, groups))
    top = {}
    for (p, _), n in seen.items():
        top[p] = max(top.get(p, 0), n)
    out = []
    for i, groups in known:
        links = [(p, q) for g in groups for p in g[0] for q in g[1]]
        said = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        out.append((
            -(1 << 63) if i is None else i, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links),
            sum(seen[p] == top[p[0]] for p in links), sum(seen[p] for p in links), hashlib.sha256(said.encode()).hexdigest() if groups else "",
        ))
    return sorted(out)


def fast(x, y, ex, ey, cuts):
    groups, j = [], 0
    now = []
    for k, e in zip(x, ex):
        now.append(k)
        if e in cuts:
            other = []
            while ey[j] < e:
                other.append(y[j])
                j += 1
            groups.append((now, [*other, y[j]]))
            j, now = j + 1, []
    return groups


def enumerate_signs():
    """Byte to sign: printable bytes stand for themselves, the others for characters from 256 on."""
    out, n = {}, 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + n)
            n += 1
    return out


COLS = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("sent", [1 << 20, 0])
def test_against_loops(spark, sent):
    rng = random.Random(3)
    rows = [*TEXTS, *MORE]
    rows += [(100 + k, "".join(rng.choice("abÉñ'., \n1–日🙂 the cat") for _ in range(rng.randrange(1, 80)))) for k in range(60)]
    got = align(docs(spark, rows).repartition(3), A, P.PATTERN, B, sent_pairs=sent).select(*COLS).collect()
    assert sorted(tuple(r) for r in got) == brute(rows)
    assert align(docs(spark).limit(0), A, P.PATTERN, B, sent_pairs=sent).count() == 0


def test_sides_give_the_libraries_ids():
    both, rng = Aligner(A, P.PATTERN, B), random.Random(5)
    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    texts = [t for _, t in [*TEXTS, *MORE] if t] + ["".join(rng.choice("ab c▁\n\t  é<s>|") for _ in range(40)) for _ in range(300)]
    for t, x, (y, _) in zip(texts, both.a.ids(texts), both.b.encode(texts)):
        assert x.tolist() == a.encode(" " + t, add_special_tokens=False).ids, t
        assert y.tolist() == b.encode(t), t


def test_lanes_and_links_do_not_change_groups(monkeypatch):
    rng = np.random.default_rng(2)
    for _ in range(100):
        docs_n = rng.integers(1, 5)
        size = rng.integers(1, 60, docs_n)
        total = np.cumsum(size)
        cut = lambda: np.unique(np.concatenate([total, rng.integers(1, total[-1] + 1, rng.integers(0, total[-1]))]))
        end_a, end_b = cut(), cut()
        first = np.concatenate([[0], np.searchsorted(end_a, total) + 1])
        monkeypatch.setattr(module, "LANE", int(rng.integers(2, 8)))
        monkeypatch.setattr(module, "TRIED", int(rng.integers(1, 3)))
        lo_a, hi_a, lo_b, _ = lanes(end_a, end_b, first)
        g = lockstep(end_a, end_b, lo_a, hi_a, lo_b)
        assert (end_a[g[1] - 1] == np.intersect1d(end_a, end_b)).all() and (end_b[g[3] - 1] == end_a[g[1] - 1]).all()
        assert (g[0] == np.concatenate([[0], g[1][:-1]])).all() and (g[2] == np.concatenate([[0], g[3][:-1]])).all()
        a, b = rng.integers(0, 5, len(end_a)), rng.integers(0, 4, len(end_b))
        doc = np.searchsorted(total, end_a[g[1] - 1])
        exp = {}
        for k in range(g.shape[1]):
            for x in a[g[0, k] : g[1, k]]:
                for y in b[g[2, k] : g[3, k]]:
                    exp[doc[k], x * 4 + y] = exp.get((doc[k], x * 4 + y), 0) + 1
        for wide, most in ((1, 10), (4, 3), (1 << 20, 1 << 20)):
            monkeypatch.setattr(module, "WIDE", wide)
            monkeypatch.setattr(module, "LINKS", most)
            got = linked(g, a, b, doc, 4)
            assert {(d, p): n for d, p, n in zip(*got)} == exp


def test_counts_handed_on_early(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(module, "HELD_PAIRS", 4)
    batches = [pa.record_batch([pa.array([[k, k + 1], [k]], pa.list_(pa.int32())), pa.array([[1, 2], [1]], pa.list_(pa.int32()))], ["a", "b"]) for k in range(6)]
    got = {}
    for out in module.counted(iter(batches)):
        for a, b, n in zip(*(out.column(c).to_pylist() for c in ("a", "b", "n"))):
            got[a, b] = got.get((a, b), 0) + n
    exp = {}
    for k in range(6):
        exp[k, 1] = exp.get((k, 1), 0) + 2
        exp[k + 1, 2] = exp.get((k + 1, 2), 0) + 1
    assert got == exp
