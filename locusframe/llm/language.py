"""Language identification by interpolated Kneser-Ney models of characters.

Each language has a model of the last ``order`` characters.  The tables of all
languages share sorted arrays of 64-bit n-gram hashes; a row holds the log
probability in every language, already interpolated with the lower orders, so a
character costs one search unless no language knows its n-gram.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.operators.joins import lookup_join

from .common import ident, lean, slices, stored
from .words import U, mix

ORDER = 4
#: Characters of text that the model of a language is fitted on, about.
CHARS_PER_LANGUAGE = 1_500_000
UNKNOWN = "und"
#: Nats per character above a language's mean that are no reason to reject a text, such as a short one with a key or number in it.
MARGIN = 2.0
_STEP = U(0x9E6C63D0876A9A47)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def characters(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points, text of each, and where a text's own begin.

    Letters are lower-cased, everything else between them is one space, and a text
    begins with ``order`` - 1 spaces and ends with one.
    """
    pad = " " * (order - 1)
    whole = "".join(f"{pad}{t.lower()} " for t in texts)
    code = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t.lower()) + order for t in texts])
    begin = np.cumsum(sizes) - sizes
    is_letter = _letters()[code]
    stay = is_letter.copy()
    stay[1:] |= is_letter[:-1]
    own = np.zeros(len(code), bool)
    for j in range(order - 1):
        stay[begin + j] = True
        own[begin + j] = True
    code = np.where(is_letter, code, np.uint32(32))[stay]
    return code, np.repeat(np.arange(len(texts)), sizes)[stay], ~own[stay]


def _hashes(code: np.ndarray, order: int) -> list[np.ndarray]:
    """hashes[n][i] names the n characters that end at i."""
    one = mix(code.astype(U) + U(1))
    out = [np.zeros(len(code), U), one]
    for _ in range(2, order + 1):
        last = np.zeros(len(code), U)
        last[1:] = out[-1][:-1]
        out.append(mix(last * _STEP + one))
    return out


class Model:
    """Tables of all languages: by length of n-gram, sorted hashes and a row of logs each."""

    def __init__(self, counts: dict[str, dict[str, int]], order: int):
        self.order, self.languages = order, sorted(counts)
        signs = len({c for grams in counts.values() for g in grams for c in g}) + 1
        self.least = math.log(1 / signs)
        probs = [defaultdict(dict) for _ in range(order + 1)]  # probs[n][gram][language]
        backs = [defaultdict(dict) for _ in range(order)]  # of a context of n characters
        for k, lang in enumerate(self.languages):
            self._fit(k, counts[lang], signs, probs, backs)
        full = len(self.languages)
        self.grams, self.contexts = [], []
        for n in range(order + 1):
            rows = np.full((len(probs[n]), full), np.nan)
            for i, row in enumerate(probs[n].values()):
                rows[i, list(row)] = list(row.values())
            self.grams.append(self._sorted(list(probs[n]), rows))
        for n in range(order):
            rows = np.zeros((len(backs[n]), full))
            for i, row in enumerate(backs[n].values()):
                rows[i, list(row)] = list(row.values())
            self.contexts.append(self._sorted(list(backs[n]), rows))
        # a language that has not seen an n-gram of another one backs off by its own weights
        for n in range(1, order + 1):
            keys, rows = self.grams[n]
            names = sorted(probs[n], key=lambda g: self._name(g))
            lower = np.stack([self._lower(g) for g in names]) if names else rows
            self.grams[n] = (keys, np.where(np.isnan(rows), lower, rows).astype(np.float32))

    @staticmethod
    def _name(gram: str) -> int:
        code = np.frombuffer(gram.encode("utf-32-le"), np.uint32)
        return int(_hashes(code, max(1, len(gram)))[len(gram)][-1]) if gram else 0

    def _sorted(self, grams: list[str], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = np.array([self._name(g) for g in grams], U)
        at = np.argsort(keys)
        return keys[at], rows[at].astype(np.float32)

    def _fit(self, k: int, top: dict[str, int], signs: int, probs, backs) -> None:
        """One language: discounted counts of the highest order, continuation counts below."""
        levels = [top]
        for _ in range(self.order - 1):
            below: dict[str, int] = defaultdict(int)
            for g in levels[0]:
                below[g[1:]] += 1
            levels.insert(0, below)
        lower: dict[str, float] = {}
        for n, level in enumerate(levels, 1):
            once, twice = (sum(1 for c in level.values() if c == m) for m in (1, 2))
            discount = once / (once + 2 * twice) if once and twice else 0.5
            total: dict[str, int] = defaultdict(int)
            kinds: dict[str, int] = defaultdict(int)
            for g, c in level.items():
                total[g[:-1]] += c
                kinds[g[:-1]] += 1
            weight = {h: discount * kinds[h] / total[h] for h in total}
            here = {
                g: (c - discount) / total[g[:-1]] + weight[g[:-1]] * (lower[g[1:]] if n > 1 else 1 / signs)
                for g, c in level.items()
            }
            for g, p in here.items():
                probs[n][g][k] = math.log(p)
            for h, w in weight.items():
                backs[n - 1][h][k] = math.log(w)
            lower = here

    def _find(self, table: tuple[np.ndarray, np.ndarray], name: int) -> np.ndarray | None:
        at = int(np.searchsorted(table[0], U(name)))
        return table[1][at] if at < len(table[0]) and int(table[0][at]) == name else None

    def _lower(self, gram: str) -> np.ndarray:
        """Log probabilities of the last character as if the n-gram were unseen in all languages."""
        back = self._find(self.contexts[len(gram) - 1], self._name(gram[:-1]))
        back = np.zeros(len(self.languages), np.float32) if back is None else back
        if len(gram) == 1:
            return back + self.least
        known = self._find(self.grams[len(gram) - 1], self._name(gram[1:]))
        return back + (self._lower(gram[1:]) if known is None else known)

    def cross_entropy(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Nats per character of each text in each language, and the number of characters."""
        code, owner, own = characters(texts, self.order)
        names = _hashes(code, self.order)
        at = np.flatnonzero(own)
        logs = np.zeros((len(at), len(self.languages)), np.float32)
        todo, back = np.arange(len(at)), None
        for n in range(self.order, 0, -1):
            keys, rows = self.grams[n]
            want = names[n][at[todo]]
            spot = np.minimum(np.searchsorted(keys, want), max(len(keys) - 1, 0))
            hit = keys[spot] == want if len(keys) else np.zeros(len(want), bool)
            if n == self.order and hit.all():
                logs = rows[spot]
                todo = todo[:0]
                break
            logs[todo[hit]] += rows[spot[hit]]
            todo = todo[~hit]
            if not len(todo):
                break
            # names[n - 1] of the character before is the context
            keys, rows = self.contexts[n - 1]
            want = names[n - 1][at[todo] - 1] if n > 1 else np.zeros(len(todo), U)
            spot = np.minimum(np.searchsorted(keys, want), max(len(keys) - 1, 0))
            seen = keys[spot] == want if len(keys) else np.zeros(len(want), bool)
            logs[todo[seen]] += rows[spot[seen]]
        logs[todo] += self.least
        first = np.searchsorted(owner[at], np.arange(len(texts) + 1))
        n = np.diff(first)
        total = np.zeros((len(texts), len(self.languages)))
        some = np.flatnonzero(n)
        if len(some):
            total[some] = np.add.reduceat(logs, first[some], axis=0, dtype=np.float64)
        return -total / np.maximum(n, 1)[:, None], n


def count_grams(order: int):
    """Counts of n-grams by language in each slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            langs, texts = b.column("lang").to_pylist(), b.column("text").to_pylist()
            for lang in sorted(set(langs)):
                code, _, own = characters([t for t, x in zip(texts, langs) if x == lang], order)
                at = np.flatnonzero(own)
                windows = np.stack([code[at - order + 1 + j] for j in range(order)], axis=1)
                grams, n = np.unique(windows, axis=0, return_counts=True)
                flat = grams.astype("<u4").tobytes().decode("utf-32-le")
                names = [flat[i : i + order] for i in range(0, len(flat), order)]
                yield pa.record_batch(
                    [pa.array([lang] * len(names), pa.string()), pa.array(names, pa.string()), pa.array(n)], ["lang", "gram", "n"]
                )

    return run


def _entropies(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in slices(batches, "text", 1 << 20):
            h, n = m.cross_entropy(b.column("text").to_pylist())
            k = [m.languages.index(x) for x in b.column("lang").to_pylist()]
            yield pa.record_batch([b.column("lang"), pa.array(h[np.arange(len(k)), k]), pa.array(n)], ["lang", "h", "n"])

    return run


class Identifier:
    """Models with a limit on the cross-entropy per language."""

    def __init__(self, model, limits: dict[str, tuple[float, float]]):
        self.model, self.limits = model, limits

    def predict(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Language of every whole text.

        Returns a row per input row: ``id``, ``version`` (a hash of the text), ``lang_pred``,
        ``score`` (0 to 1, the share of the best language), ``cross_entropy`` (nats per
        character in it) and ``rejected``.  A text that is null or has no letter is `und`
        with a score of 0 and rejected; ties go to the first language by name.  A null id
        counts as the smallest bigint.  Without any learned language all texts are `und`.
        """
        decide = self._decide()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, "text", 1 << 20):
                names, share, low, over = decide(b.column("text").to_pylist())
                yield pa.record_batch(
                    [b.column("id"), b.column("version"), pa.array(names, pa.string()), pa.array(share), pa.array(low, from_pandas=True), pa.array(over)],
                    ["id", "version", "lang_pred", "score", "cross_entropy", "rejected"],
                )

        texts = lean(docs).select(ident(id_col).alias("id"), F.col(f"`{text_col}`").alias("text"))
        texts = texts.withColumn("version", F.xxhash64(F.coalesce("text", F.lit(""))))
        return texts.mapInArrow(
            run, "id bigint, version bigint, lang_pred string, score double, cross_entropy double, rejected boolean"
        )


    def accepted(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """The rows, with all their columns, whose text is not rejected."""
        decide = self._decide()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, text_col, 1 << 20):
                yield b.filter(pa.array(~decide(b.column(text_col).to_pylist())[3]))

        return lean(docs).mapInArrow(run, docs.schema)

    def _decide(self):
        """Language, share, cross-entropy and rejection of a list of texts."""
        model, limits = self.model, self.limits

        def decide(texts: list[str | None]):
            m, texts = model.value, [t or "" for t in texts]
            if not m.languages:
                none = np.zeros(len(texts))
                return [UNKNOWN] * len(texts), none, none + np.nan, none == 0
            mean, far = (np.array([limits[x][j] for x in m.languages]) for j in (0, 1))
            h, n = m.cross_entropy(texts)
            best = h.argmin(axis=1)
            low = h[np.arange(len(best)), best]
            share = 1 / np.exp(-(h - low[:, None]) * np.minimum(n, 60)[:, None]).sum(axis=1)
            over = low - mean[best] > np.maximum(MARGIN, far[best] / np.sqrt(np.maximum(n, 1)))
            names = [m.languages[k] if c else UNKNOWN for k, c in zip(best, letters(texts))]
            some = np.array([x != UNKNOWN for x in names], bool)
            return names, np.where(some, share, 0.0), np.where(some, low, np.nan), over | ~some

        return decide


def letters(texts: list[str]) -> np.ndarray:
    """Whether each text has a letter."""
    code = np.frombuffer("".join(f"{t} " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts])
    seen = np.concatenate([[0], np.cumsum(_letters()[code])])
    return np.diff(seen[np.concatenate([[0], ends])]) > 0 if len(texts) else np.zeros(0, bool)


def learn(
    docs: DataFrame, train: Column | None = None, order: int = ORDER, chars: int = CHARS_PER_LANGUAGE,
    text_col: str = "text", lang_col: str = "lang",
) -> Identifier:
    """Fit a model per value of ``lang_col`` on the rows where ``train`` holds.

    Whole texts with a language are taken by a hash of the text until each language has
    about ``chars`` characters, which bounds what the driver gets: at most that many
    n-grams a language.  A tenth of them is kept back to calibrate the rejection: a
    language's limit is its mean cross-entropy there plus two nats, or, for short texts,
    plus five times the deviation that three of four stay within, scaled by the root of
    the length.  A language without such texts takes the largest mean of the others.
    """
    rows = lean(docs).filter(train if train is not None else F.lit(True)).select(
        F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang")
    ).filter("text is not null and lang is not null")
    totals = stored(rows.groupBy("lang").agg(F.sum(F.length("text")).alias("total")), "languages")
    draw = F.pmod(F.xxhash64("text", F.lit("draw")), F.lit(1 << 30)) / float(1 << 30)
    part = lookup_join(rows, totals, "lang", spread=["text"]).filter(draw * F.col("total") < 1.1 * chars).select("lang", "text")
    kept_back = F.pmod(F.xxhash64("text", F.lit("part")), F.lit(10)) == 0
    grams = part.filter(~kept_back).mapInArrow(count_grams(order), "lang string, gram string, n bigint")
    counts: dict[str, dict[str, int]] = defaultdict(dict)
    for r in grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")).collect():
        counts[r["lang"]][r["gram"]] = r["n"]
    model = docs.sparkSession.sparkContext.broadcast(Model(counts, order))
    known = part.filter(kept_back).filter(F.col("lang").isin(list(counts))).filter(F.col("text").rlike(r"\p{L}"))
    seen = known.mapInArrow(_entropies(model), "lang string, h double, n bigint").filter("n > 0")
    mean = {r["lang"]: r["m"] for r in seen.groupBy("lang").agg((F.sum(F.col("h") * F.col("n")) / F.sum("n")).alias("m")).collect()}
    level = F.create_map(*[F.lit(x) for pair in mean.items() for x in pair])[F.col("lang")] if mean else F.lit(0.0)
    far = {r["lang"]: r["d"] for r in seen.groupBy("lang").agg(F.percentile((F.col("h") - level) * F.sqrt("n"), 0.75).alias("d")).collect()}
    most = max(mean.values(), default=math.inf)
    limits = {x: (mean.get(x, most), 5 * max(far.get(x, 0.0), 1.0)) for x in counts}
    return Identifier(model, limits)
