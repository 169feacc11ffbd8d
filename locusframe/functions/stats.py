"""Statistical column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_factorial(n: Column) -> Column:
    """ln(n!) by the Stirling series ten places up, exact to about 1e-13."""
    x = n.cast("double") + 1
    y = x + 10
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    high = (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + series
    product = x
    for j in range(1, 10):
        product = product * (x + j)
    return high - F.ln(product)


def log_choose(n: Column, k: Column) -> Column:
    return log_factorial(n) - log_factorial(k) - log_factorial(n - k)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def hypergeom_log_sf(k: Column, total: Column, marked: Column, drawn: Column) -> Column:
    """ln P(X >= k) for ``drawn`` of ``total`` with ``marked`` marked ones.

    Beyond the mode the terms are summed from ``k`` upward, each relative to the first,
    so a tail far below the smallest double keeps all its digits; up to the mode the
    terms below ``k`` are summed downward and taken from one.  Terms fall at least as
    fast as from the mode, so ten standard deviations and forty places hold all that a
    double can see.  Minus infinity where X cannot reach ``k``, null where an input is.
    """
    given = {n: x.cast("double") for n, x in {"k": k, "total": total, "marked": marked, "drawn": drawn}.items()}

    def bounds(v: Column) -> Column:
        share = v["marked"] / F.greatest(v["total"], F.lit(1.0))
        spread = v["drawn"] * share * (1 - share) * (v["total"] - v["drawn"]) / F.greatest(v["total"] - 1, F.lit(1.0))
        return F.struct(
            *[v[n].alias(n) for n in given],
            F.greatest(F.lit(0.0), v["drawn"] + v["marked"] - v["total"]).alias("least"),
            F.least(v["marked"], v["drawn"]).alias("most"),
            (v["k"] > F.floor((v["drawn"] + 1) * (v["marked"] + 1) / (v["total"] + 2))).alias("up"),
            (F.ceil(10 * F.sqrt(F.greatest(spread, F.lit(0.0)))) + 40).alias("width"),
        )

    inside = lambda v, x: F.greatest(v["least"], F.least(v["most"], x)).cast("bigint")

    def tail(v: Column) -> Column:
        return F.when(F.greatest(v["k"], v["least"]) > v["most"], F.lit(float("-inf"))).when(v["k"] <= v["least"], F.lit(0.0)).otherwise(
            _let(F.struct(v.alias("v"), inside(v, F.when(v["up"], v["k"]).otherwise(v["k"] - 1)).alias("start")), lambda w: summed(w["v"], w["start"]))
        )

    def summed(v: Column, start: Column) -> Column:
        total, marked, drawn = v["total"], v["marked"], v["drawn"]
        ratio = lambda i: F.when(v["up"], (marked - i) * (drawn - i) / ((i + 1) * (total - marked - drawn + i + 1))).otherwise(
            i * (total - marked - drawn + i) / ((marked - i + 1) * (drawn - i + 1))
        )
        terms = F.aggregate(
            F.sequence(start, inside(v, F.when(v["up"], start + v["width"]).otherwise(start - v["width"]))),
            F.struct(F.lit(0.0).alias("s"), F.lit(1.0).alias("t")),
            lambda acc, i: F.struct((acc["s"] + acc["t"]).alias("s"), (acc["t"] * ratio(i.cast("double"))).alias("t")),
            lambda acc: acc["s"],
        )
        side = log_choose(marked, start) + log_choose(total - marked, drawn - start) - log_choose(total, drawn) + F.ln(terms)
        return _let(F.struct(v["up"].alias("up"), side.alias("side")), lambda w: F.when(w["up"], w["side"]).otherwise(F.log1p(-F.exp(w["side"]))))

    known = given["k"].isNotNull() & given["total"].isNotNull() & given["marked"].isNotNull() & given["drawn"].isNotNull()
    start = F.struct(*[x.alias(n) for n, x in given.items()])
    return F.when(known, _let(start, lambda v: _let(bounds(v), tail)))


def hypergeom_sf(k: Column, total: Column, marked: Column, drawn: Column) -> Column:
    """P(X >= k) for ``drawn`` of ``total`` with ``marked`` marked ones."""
    return F.exp(hypergeom_log_sf(k, total, marked, drawn))


def log2p1(x: Column) -> Column:
    return F.log2(x + 1)


def neglog10(p: Column) -> Column:
    return -F.log10(p)


def magnitude_bin(x: Column, per_octave: int = 256) -> Column:
    """Order-preserving bin of a number: equal widths inside each power of two.

    Depends on the value alone, so a retried task bins as before, and small
    p-values are spread as well as large ones.
    """
    a = F.abs(x)
    e = F.floor(F.log2(a))
    size = F.floor((e + a / F.pow(F.lit(2.0), e) - 1 + 1100) * per_octave)
    return F.when(x == 0, F.lit(0)).otherwise(F.signum(x) * size).cast("bigint")
