"""Joins with a side that is small as a rule, on a key that may be hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most rows of a side that is sent to every executor, and parts of a key beyond that.
SMALL_ROWS, PARTS = 100_000, 64


def lookup_join(
    big: DataFrame, small: DataFrame, on: str, how: str = "inner", spread: list[str] | None = None,
    most: int = SMALL_ROWS,
) -> DataFrame:
    """Join ``small`` to ``big`` without an exchange keyed by ``on`` alone.

    ``small`` is counted up to ``most`` rows and broadcast if it has no more.
    Beyond that, each of its rows is repeated for every part, and the rows of a key
    in ``big`` are dealt to parts by a hash of ``spread`` (all columns by default).
    ``how`` is inner or left.  ``small`` is worked out twice, so it should be cheap or stored.
    """
    if small.limit(most + 1).count() <= most:
        return big.join(F.broadcast(small), on, how)
    part = F.pmod(F.xxhash64(*(spread or big.columns)), F.lit(PARTS))
    copies = small.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(PARTS - 1).cast("bigint"))))
    return big.withColumn("_part", part).join(copies, [on, "_part"], how).drop("_part")
