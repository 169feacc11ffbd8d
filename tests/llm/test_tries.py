"""Exact duplicates against a dictionary, and the trie by itself."""

import random

from odd import LOW, TEXTS, docs

from locusframe.llm import tries
from locusframe.llm.tries import Trie, exact_duplicates

DROP = {ord(c): None for c in " \t\n\x0b\x0c\r"}


def test_trie_with_spills():
    rng = random.Random(2)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 12))) for _ in range(4000)]
    trie, found, best = Trie(most=300), [], {}
    for k, t in enumerate(texts):
        chars = rng.randrange(3)
        found += trie.add(t, chars, k, 0, 1, t.decode())
        best.setdefault(t.decode(), []).append((-chars, k))
    spilled = len(found)
    found += trie.owners()
    assert spilled > 0
    merged = {}
    for o in found:
        merged.setdefault(o.digest, []).append((-o.chars, o.id, o.n))
    assert {d: (min(v)[:2], sum(x[2] for x in v)) for d, v in merged.items()} == {d: (min(v), len(v)) for d, v in best.items()}


def test_groups(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("ab c\n") for _ in range(rng.randrange(8))) for _ in range(300)]
    rows = list(enumerate(base)) + [(1000 + k, "hot one") for k in range(300)] + [(2000, "h ot one")]
    groups = {}
    for i, t in rows:
        groups.setdefault(t.translate(DROP), []).append((-len(t), i))
    got = exact_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    for r in got:
        group = groups[text[r["id"]].translate(DROP)]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (min(group)[1], len(group), min(group)[1] == r["id"])


def test_edges(spark):
    got = exact_duplicates(docs(spark)).collect()
    assert len(got) == len(TEXTS)
    by = {r["id"]: r for r in got}
    assert by[2]["keep_id"] == by[3]["keep_id"] == by[4]["keep_id"] == 4 and by[2]["group_size"] == 3
    assert by[6]["group_size"] == 2 and by[6]["kept"] and by[9]["keep_id"] == 1 and by[LOW]["kept"]
    assert exact_duplicates(docs(spark).limit(0)).count() == 0


def test_one_row_of_a_group_stays(spark):
    rows = [(None, "a b"), (None, "ab"), (5, "ab "), (7, "x"), (7, " x"), (7, "x "), (8, None), (8, "")]
    got = exact_duplicates(docs(spark, rows)).collect()
    kept = {}
    for r in got:
        kept.setdefault(r["digest"], []).append((r["id"], r["version"], r["kept"]))
    # rows 8 are one document twice
    assert sorted(len({x[:2] for x in v if x[2]}) for v in kept.values()) == [1, 1, 1]
    assert {r["group_size"] for r in got} == {2, 3}
    assert {x[0] for v in kept.values() for x in v if x[2]} == {LOW, 7, 8}


def test_combined_in_bounded_memory(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(tries, "COMBINED_BYTES", 200)
    rng = random.Random(1)
    texts = [rng.choice(["hot text", f"single {k}", "warm"]) for k in range(500)]
    batches = [
        pa.record_batch([pa.array(texts[lo : lo + 20]), *[pa.array(range(lo, lo + 20), pa.int64())] * 3], ["text", "chars", "id", "version"]) for lo in range(0, 500, 20)
    ]
    out = [r for b in tries.combined(iter(batches)) for r in b.to_pylist()]
    assert sum(r["body"] == b"hottext" for r in out) == 1
    total = {}
    for r in out:
        total[r["body"]] = total.get(r["body"], 0) + r["n"]
    exp = {}
    for t in texts:
        exp[t.translate(DROP).encode()] = exp.get(t.translate(DROP).encode(), 0) + 1
    assert total == exp
