"""Language models against a plain one, and held-out accuracy."""

import math
from collections import Counter, defaultdict

import numpy as np
from odd import TEXTS, docs
from pyspark.sql import functions as F

from locusframe.llm.common import held_out
from locusframe.llm.language import Model, learn

SF = "/root/testdata/sf0.001"


def plain(counts, order, text, signs):
    """Interpolated Kneser-Ney, n-gram by n-gram."""
    levels = [dict(counts)]
    for _ in range(order - 1):
        below = Counter()
        for g in levels[0]:
            below[g[1:]] += 1
        levels.insert(0, below)

    def prob(gram):
        if not gram:
            return 1 / signs
        level = levels[len(gram) - 1]
        once, twice = (sum(c == m for c in level.values()) for m in (1, 2))
        d = once / (once + 2 * twice) if once and twice else 0.5
        same = {g: c for g, c in level.items() if g[:-1] == gram[:-1]}
        if not same:
            return prob(gram[1:])
        return max(level.get(gram, 0) - d, 0) / sum(same.values()) + d * len(same) / sum(same.values()) * prob(gram[1:])

    chars = " " * (order - 1) + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    while "  " in chars[order - 1 :]:
        chars = chars[: order - 1] + chars[order - 1 :].replace("  ", " ")
    grams = [chars[k - order + 1 : k + 1] for k in range(order - 1, len(chars))]
    return -sum(math.log(prob(g)) for g in grams) / len(grams)


def test_probabilities():
    order, texts = 3, {"x": ["banana band", "an ant ran"], "y": ["lullaby", "all well ill"]}
    counts = {}
    for lang, some in texts.items():
        c = Counter()
        for t in some:
            s = "  " + t + " "
            c.update(s[k : k + 3] for k in range(len(s) - 2))
        counts[lang] = dict(c)
    signs = len({ch for c in counts.values() for g in c for ch in g}) + 1
    model = Model(counts, order)
    tests = ["banana", "all ill", "zebra", "a", "lull ant well"]
    h, _ = model.cross_entropy(tests)
    for k, lang in enumerate(model.languages):
        np.testing.assert_allclose(h[:, k], [plain(counts[lang], order, t, signs) for t in tests], rtol=1e-4)


def test_held_out_accuracy(spark):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    test = held_out("doc_id", 3, 1)
    model = learn(frame, train=~test)
    got = model.predict(frame).join(frame.filter(test).select(F.col("doc_id").alias("id"), "lang"), "id")
    right = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.avg(F.col("rejected").cast("int"))).first()
    assert right[0] > 0.97 and right[1] == 0
    odd = {r["version"]: r for r in model.predict(docs(spark)).collect()}
    by = defaultdict(list)
    for r in model.predict(docs(spark)).collect():
        by[r["id"]].append(r)
    for i in (2, 3, 4, 5):
        assert (by[i][0]["lang_pred"], by[i][0]["score"], by[i][0]["rejected"]) == ("und", 0.0, True)
    assert all(0 <= r["score"] <= 1 for r in odd.values()) and sum(map(len, by.values())) == len(TEXTS)
    assert by[1][0]["lang_pred"] != "und"
    foreign = spark.createDataFrame([(1, "Все счастливые семьи похожи друг на друга"), (2, frame.first()["text"])], "doc_id int, text string")
    assert [r["doc_id"] for r in model.accepted(foreign).collect()] == [2]
    assert model.accepted(docs(spark)).columns == docs(spark).columns


def test_nothing_learned(spark):
    model = learn(docs(spark).limit(0))
    assert {(r["lang_pred"], r["rejected"]) for r in model.predict(docs(spark)).collect()} == {("und", True)}
