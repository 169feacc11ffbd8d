"""Near-duplicates against all pairs."""

import random
import re

import pytest

from locusframe.llm.near import near_duplicates

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, percent):
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def family(rng, size, words, most):
    """Variants of one text with up to ``most`` words replaced, some of them variants of variants."""
    texts = [[f"w{rng.randrange(10**6)}" for _ in range(words)]]
    for _ in range(size - 1):
        t = list(rng.choice(texts) if rng.random() < 0.3 else texts[0])
        for _ in range(rng.randrange(most + 1)):
            t[rng.randrange(len(t))] = f"e{rng.randrange(10**6)}"
        if rng.random() < 0.2:
            t = t[rng.randrange(12) :]
        texts.append(t)
    return [" ".join(t) for t in texts]


@pytest.mark.parametrize("percent", [80, 85])
def test_families(spark, percent):
    rng = random.Random(percent)
    texts = [*family(rng, 120, 150, 6), *family(rng, 60, 60, 3), *family(rng, 30, 12, 2), *family(rng, 40, 400, 12)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), percent=percent)
    assert {r["id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == brute(rows, percent)


def test_common_elements(spark):
    """Members just over the threshold from the leader share more elements that it lacks than are put last."""
    rng = random.Random(8)
    base = [f"w{k}" for k in range(100)]
    texts = [base]
    for branch in range(3):
        trunk = [f"b{branch}" if k in (branch * 20, branch * 20 + 7, branch * 8 + 70) else w for k, w in enumerate(base)]
        texts += [trunk, *[[f"e{rng.randrange(10**6)}" if rng.random() < 0.02 else w for w in trunk] for _ in range(25)]]
    rng.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), percent=85, often=8)
    assert {r["id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == brute(rows, 85)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \t"), (4, "One two"), (5, "one  TWO"), (6, "one"), (None, "one two"), (8, "é É x y z q"), (8, "é É x y z q")]
    frame = spark.createDataFrame([(*r, r[0], 7) for r in rows], "doc_id bigint, text string, id bigint, node int")
    got = {(r["id"], r["n_shingles"], r["component_id"]) for r in near_duplicates(frame).collect()}
    low = -(1 << 63)
    assert got == {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, low), (5, 1, low), (6, 1, 6), (low, 1, low), (8, 2, 8)}
    assert near_duplicates(frame.limit(0)).count() == 0
