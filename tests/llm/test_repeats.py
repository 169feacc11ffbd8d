"""Substring removal against a scan in order."""

import hashlib
import random
import re

from odd import LOW, TEXTS, docs

from locusframe.llm.repeats import repeats


def brute(rows, window):
    """Rows of one id and text are one document; places go by (id, start)."""
    seen, out = {}, {}
    for i, t in sorted(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen.setdefault(tuple(w[k : k + window]), (i, k)) != (i, k):
                gone[k : k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    return out


def check(spark, rows, window=20):
    got = repeats(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), window).collect()
    exp = brute(rows, window)
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_words"], r["n_removed"], r["sha"]) == exp[r["id"]][:3], r["id"]
        assert r["kept_text"] == (exp[r["id"]][3] if r["n_removed"] else None)


def test_random_passages(spark):
    rng = random.Random(11)
    word = lambda: rng.choice("abcdefgh") * rng.randrange(1, 3)
    shared = [[word() for _ in range(rng.randrange(15, 45))] for _ in range(12)]
    rows = []
    for i in range(80):
        t = []
        for _ in range(rng.randrange(1, 5)):
            t += [word() for _ in range(rng.randrange(0, 25))]
            p = rng.choice(shared)
            lo = rng.randrange(0, 10)
            t += p[lo : lo + rng.randrange(10, 40)]
        if rng.random() < 0.2:
            t += ["run"] * rng.randrange(1, 70)
        if rng.random() < 0.1:
            t = ["ab", "cd", "ab"] * 30
        rows.append((i, " ".join(t)))
    rows += [(100 + i, t) for i, (_, t) in enumerate(rows[:15])]
    check(spark, rows)
    check(spark, rows[:40], window=14)


def test_edges(spark):
    got = repeats(docs(spark)).collect()
    assert len(got) == len(TEXTS)
    by = {r["id"]: r for r in got}
    assert by[2]["n_words"] == by[3]["n_words"] == by[4]["n_words"] == 0
    assert by[7]["n_removed"] == 2999 and by[13]["kept_text"] == "tail" and by[12]["n_removed"] == 0
    assert sum(r["id"] == LOW for r in got) == 2
    assert repeats(docs(spark).limit(0)).count() == 0


def test_repeated_rows_are_one_document(spark):
    text = " ".join(f"q{k}" for k in range(30))
    got = repeats(docs(spark, [(5, text), (5, text), (6, text), (6, "other " + text)])).collect()
    assert sorted((r["id"], r["n_removed"]) for r in got) == [(5, 0), (5, 0), (6, 30), (6, 30)]
