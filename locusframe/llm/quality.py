"""Quality by Bradley-Terry ranking: scores learned from pairs of a better and a worse text.

A text's score is linear in features of its form; that one text beats another has the
logistic of the difference of their scores as its probability, so the weights are
those of a logistic regression without intercept on feature differences.  The exact quantile
of the scores of the labelled texts, at the share of bad ones, is the threshold.
Every labelled text that may be learned from takes part in all of this.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.operators.tracks import quantile_nearest

from .common import ident, lean, raw, slices, stored
from .words import Words

#: Pairs for each labelled row, and bits of a hash that tell the groups in which rows are numbered.
PAIRS, GROUP_BITS = 4, 12
#: Score that the threshold gets.
CUT = 0.3
_MARKS = (b".,;:", b"!?", b"|", b"#$%&*@^~+=", b"\"'()[]{}<>-_/\\`")


def _classes() -> np.ndarray:
    """Class of each byte: capital, small, digit, space, line end, the groups of marks, other control, beyond ASCII."""
    out = np.full(256, 10)
    for k, some in enumerate((range(65, 91), range(97, 123), range(48, 58), b" \t\r\x0b\x0c", b"\n", *_MARKS)):
        out[list(some)] = k
    out[128:] = 11
    return out


_CLASS = _classes()
KINDS = 12


def features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Features of the form of each text: shares of byte classes, word and line statistics."""
    n = len(at) - 1
    size = np.diff(at)
    owner = np.repeat(np.arange(n), size)
    shares = np.bincount(owner * KINDS + _CLASS[data], minlength=n * KINDS).reshape(n, KINDS) / np.maximum(size, 1)[:, None]
    words = Words(data, at, fold=True)
    count = np.maximum(words.count, 1)
    whose = np.repeat(np.arange(n), words.count)
    length = (words.end - words.start).astype(float)
    mean = np.bincount(whose, length, minlength=n) / count
    spread = np.sqrt(np.bincount(whose, (length - mean[whose]) ** 2, minlength=n) / count)
    marked = np.bincount(whose, np.isin(_CLASS[data[words.end - 1]] if len(words.end) else np.zeros(0), (6, 7, 8)), minlength=n) / count
    lone = np.bincount(whose, length == 1, minlength=n) / count
    again = np.zeros(len(words.hash), bool)
    again[1:] = (words.hash[1:] == words.hash[:-1]) & (whose[1:] == whose[:-1])
    again = np.bincount(whose, again, minlength=n) / count
    pairs, starts = words.grams(2)
    cut = np.searchsorted(starts, words.first)
    kinds, top, fresh = np.ones(n), np.zeros(n), np.ones(n)
    for k in range(n):
        own = words.hash[words.first[k] : words.first[k + 1]]
        if len(own):
            seen = np.unique(own, return_counts=True)[1]
            kinds[k], top[k] = len(seen) / math.sqrt(len(own)), seen.max() / len(own)
        if cut[k + 1] > cut[k]:
            fresh[k] = len(np.unique(pairs[cut[k] : cut[k + 1]])) / (cut[k + 1] - cut[k])
    sentences = words.count / (1 + np.bincount(owner, (data == 46) | (data == 33) | (data == 63), minlength=n))
    extra = [mean, spread, marked, lone, again, kinds, top, fresh, np.log1p(size), np.log1p(sentences)]
    return np.column_stack([np.sqrt(shares), *extra])


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text"):
        x = features(*raw(b.column("text")))
        cuts = pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32())
        yield pa.record_batch([b.column("id"), b.column("version"), pa.ListArray.from_arrays(cuts, pa.array(x.reshape(-1)))], ["id", "version", "x"])


def featured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``version`` (a hash of the text) and features ``x`` of every whole text; a null text is empty."""
    texts = lean(docs).select(ident(id_col).alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    texts = texts.withColumn("version", F.xxhash64("text"))
    return texts.mapInArrow(_featured, "id bigint, version bigint, x array<double>")


def _dot(weights: list[float]) -> Column:
    w = F.array(*[F.lit(float(v)) for v in weights])
    return F.aggregate(F.zip_with("x", w, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def numbered(known: DataFrame) -> DataFrame:
    """``k``: numbers from 0 within each label, in the order of a hash.

    Rows are numbered within groups of hashes, and one row a group says how many are ahead.
    """
    x = known.withColumn("h", F.xxhash64("id", "version", F.lit("order"))).withColumn("group", F.shiftright("h", 64 - GROUP_BITS))
    ahead = Window.partitionBy("y").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    sizes = x.groupBy("y", "group").count().select("y", "group", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("ahead"))
    place = F.row_number().over(Window.partitionBy("y", "group").orderBy("h", "id", "version")) - 1
    return x.withColumn("place", place).join(F.broadcast(sizes), ["y", "group"]).withColumn("k", F.col("ahead") + F.col("place")).drop("h", "group", "place", "ahead")


def rank(
    docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
) -> DataFrame:
    """Score every whole text by a Bradley-Terry model of the labelled ones.

    ``labels`` has ``id_col`` and ``label_col`` (1 beats 0; other values and nulls are not
    used, repeated rows count once); ``train``, over ``id``, says which may be learned from.
    Every one of them is paired with four of the other label.  Returns a row per input row: ``id``, ``version``, ``raw`` (log
    odds), ``score`` (0 to 1; the threshold is at 0.3) and ``good``.  Without labels of both
    kinds every score is 0.5.  A null text is empty and is scored; a null id counts as the
    smallest bigint, in both tables; repeated rows get equal scores.  Other columns are not read.
    """
    x = stored(featured(docs, id_col, text_col), "features")
    marks = labels.select(ident(id_col).alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).filter("y in (0, 1)").filter(train).distinct()
    known = stored(x.join(marks, "id").select("id", "version", "y", "x"), "known")
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if len(sizes) < 2:
        return x.select("id", "version", F.lit(0.0).alias("raw"), F.lit(0.5).alias("score"), F.lit(True).alias("good"))
    width = KINDS + 10
    stats = known.agg(*[f(F.col("x")[k]).alias(f"{n}{k}") for k in range(width) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean, spread = np.array([stats[f"m{k}"] for k in range(width)]), np.array([stats[f"s{k}"] for k in range(width)])
    spread = np.where(spread > 1e-9, spread, np.inf)
    placed = numbered(known)
    few, many = sorted(sizes, key=sizes.get)
    turns = F.explode(F.sequence(F.lit(0), F.lit(PAIRS - 1)))
    left = placed.filter(F.col("y") == many).select(F.col("x").alias("a"), "k", turns.alias("t"))
    left = left.withColumn("j", (F.col("k") * PAIRS + F.col("t")) % sizes[few])
    right = placed.filter(F.col("y") == few).select(F.col("x").alias("b"), F.col("k").alias("j"))
    scale = F.array(*[F.lit(float(1 / s)) for s in spread])
    sign = F.when((F.col("k") + F.col("t")) % 2 == 0, 1.0).otherwise(-1.0)  # half of the pairs the other way round
    diff = F.zip_with(F.zip_with("a", "b", lambda p, q: p - q), scale, lambda d, s: d * s)
    pairs = left.join(right, "j").withColumn("sign", sign).withColumn("d", diff).select(
        array_to_vector(F.transform("d", lambda d: d * F.col("sign"))).alias("features"),
        F.when(F.col("sign") * (1 if many == 1 else -1) > 0, 1.0).otherwise(0.0).alias("label"),
    )
    fitted = LogisticRegression(fitIntercept=False, regParam=1e-3, standardization=False, maxIter=60).fit(stored(pairs, "preferences"))
    weights = np.asarray(fitted.coefficients.toArray()) / spread
    scored = x.select("id", "version", (_dot(weights.tolist()) - float(weights @ mean)).alias("raw"))
    share = sizes[0] / (sizes[0] + sizes[1])
    seen = known.select((_dot(weights.tolist()) - float(weights @ mean)).alias("raw"))
    cut = seen.sparkSession.range(1).select(quantile_nearest(seen, "raw", share)).first()[0]
    odds = F.col("raw") - cut + math.log(CUT / (1 - CUT))
    return scored.withColumn("score", 1 / (1 + F.exp(-odds))).withColumn("good", F.col("score") >= CUT)
