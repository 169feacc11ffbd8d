"""Quality ranking by held-out accuracy, plain features and Newton steps."""

import math
import re
import zlib

import numpy as np
from odd import TEXTS, docs
from pyspark.sql import functions as F

from locusframe.llm import quality as module
from locusframe.llm.common import held_out
from locusframe.llm.quality import featured, rank

SF = "/root/testdata/sf0.01"


def test_held_out(spark):
    frame, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = rank(frame, labels, train=~held_out("id", 5, 0)).join(labels.withColumnRenamed("doc_id", "id"), "id")
    rows = got.filter(held_out("id", 5, 0)).select("quality", "score", "good").collect()
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    wins = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert wins > 0.97
    assert sum(r["good"] == (r["quality"] == 1) for r in rows) > 0.93 * len(rows)


def test_edges(spark):
    labels = spark.createDataFrame([(1, 1, 5), (7, 0, 5), (7, 0, 5), (12, 1, 5), (2, None, 5), (None, 0, 5), (99, 1, 5)], "doc_id bigint, quality int, x int")
    got = rank(docs(spark), labels, train=F.lit(True)).collect()
    assert len(got) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in got)
    none = rank(docs(spark), labels.filter("quality = 1"), train=F.lit(True)).collect()
    assert {(r["score"], r["good"]) for r in none} == {(0.5, True)}
    assert rank(docs(spark).limit(0), labels, train=F.lit(True)).count() == 0


def plain_features(text):
    """The features of one text, letter by letter and word by word."""
    data = text.encode()
    groups = [range(65, 91), range(97, 123), range(48, 58), b" \t\r\x0b\x0c", b"\n", b".,;:", b"!?", b"|", b"#$%&*@^~+=", b"\"'()[]{}<>-_/\\`"]
    kind = lambda b: 11 if b > 127 else next((k for k, g in enumerate(groups) if b in g), 10)
    share = [sum(kind(b) == k for b in data) / max(len(data), 1) for k in range(12)]
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", data) if w]
    low = [bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in words]
    n, sizes = max(len(words), 1), [len(w) for w in words]
    mean = sum(sizes) / n
    spread = math.sqrt(sum((s - mean) ** 2 for s in sizes) / n)
    pairs = list(zip(low, low[1:]))
    return [math.sqrt(s) for s in share] + [
        mean, spread, sum(kind(w[-1]) in (6, 7, 8) for w in words) / n, sum(s == 1 for s in sizes) / n, sum(a == b for a, b in pairs) / n,
        len(set(low)) / math.sqrt(len(low)) if low else 1, max(map(low.count, low)) / len(low) if low else 0,
        len(set(pairs)) / len(pairs) if pairs else 1, math.log1p(len(data)), math.log1p(len(words) / (1 + sum(b in b".!?" for b in data))),
    ]


def test_features_against_plain_code(spark):
    got = {r["id"]: r["x"] for r in featured(docs(spark)).filter("id not in (6, -9223372036854775808)").collect()}
    for i, t in TEXTS:
        if i in got:
            assert np.allclose(got[i], plain_features(t or ""), atol=1e-9), i


def test_weights_against_newton_steps(spark, monkeypatch):
    frame, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    told = {}
    keep = module.stored
    monkeypatch.setattr(module, "stored", lambda df, name: told.setdefault(name, keep(df, name)))
    train = ~held_out("id", 5, 0)
    scores = {(r["id"], r["version"]): (r["raw"], r["score"], r["good"]) for r in rank(frame, labels, train=train).collect()}
    known = told["known"].collect()
    allowed = {r["doc_id"]: r["quality"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 and r["quality"] in (0, 1)}
    assert {r["id"]: r["y"] for r in known} == allowed
    x, y = np.array([r["x"] for r in known]), np.array([r["y"] for r in known])
    scale = x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, np.inf)
    pairs = told["preferences"].collect()
    d, won = np.array([p["features"].toArray() for p in pairs]), np.array([p["label"] for p in pairs])
    assert len(pairs) == 4 * max((y == 0).sum(), (y == 1).sum())
    # every pair is a difference of a good and a bad text, the good one first where it won
    z = x / scale
    better = {tuple(np.round(p - q, 9)) for p in z[y == 1] for q in z[y == 0]}
    assert all(tuple(np.round(v if w else -v, 9) + 0.0) in better for v, w in list(zip(d, won))[:200])
    w = np.zeros(d.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-d @ w))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + 1e-3 * np.eye(len(w)), d.T @ (p - won) / len(d) + 1e-3 * w)
        w -= step
    raw = (x - x.mean(axis=0)) / scale @ w
    got = np.array([scores[r["id"], r["version"]][0] for r in known])
    assert np.abs(got - raw).max() < 1e-3 * max(1, np.abs(raw).max())
    # the threshold is the quantile of these scores at the share of bad texts
    good = np.array([scores[r["id"], r["version"]][2] for r in known])
    assert abs((~good).mean() - (y == 0).mean()) < 0.01
    assert all((s >= 0.3) == g for _, s, g in scores.values())


def test_every_labelled_text_is_learned_from(spark, monkeypatch):
    told = {}
    keep = module.stored
    monkeypatch.setattr(module, "stored", lambda df, name: told.setdefault(name, keep(df, name)))
    n = 45_000
    frame = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("a "), F.repeat(F.lit("b, "), (F.col("id") % 7).cast("int"))).alias("text"))
    labels = spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") % 3 > 0).cast("int").alias("quality"))
    got = rank(frame, labels, train=F.lit(True))
    assert told["known"].count() == n and told["preferences"].count() == 4 * (n - n // 3)
    # the exact quantile: no more than the ties at the threshold differ from the share
    scores = sorted(r["raw"] for r in got.collect())
    assert abs(min(r["raw"] for r in got.filter("good").select("raw").collect()) - scores[round(n / 3)]) < 1e-9


def test_numbers_of_a_label_have_no_gaps(spark):
    known = spark.range(5000).select("id", F.lit(1).alias("version"), (F.col("id") % 3 > 0).cast("int").alias("y"))
    rows = module.numbered(known).collect()
    for y in (0, 1):
        assert sorted(r["k"] for r in rows if r["y"] == y) == list(range(sum(r["y"] == y for r in rows)))
