"""Ordered operations that stay parallel inside one long chromosome.

A plain ``Window.partitionBy(chrom)`` puts a whole chromosome into one task.
Here each key is cut into position bins: the window runs per (key, bin), a
one-row-per-bin summary carries the state over the bin borders, and only that
summary is ordered per key.  The summary has at most (chromosome length / bin
width) rows per key, whatever the number of input rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN_WIDTH = 100_000
BIN = "_bin"
Values = Callable[[str], Column]


def with_bin(df: DataFrame, pos: str, width: int = BIN_WIDTH) -> DataFrame:
    """Add the position bin; rows without a position have no place in the order."""
    binned = df.withColumn(BIN, F.floor(F.col(pos) / width).cast("bigint"))
    return binned.filter(F.col(BIN).isNotNull())


def _keyed(df: DataFrame, keys: list[str]) -> DataFrame:
    """Drop null keys up front, as the join with the summary would on one side.

    Both sides then have the same plan below the shuffle and share its output.
    """
    for k in keys:
        df = df.filter(F.col(k).isNotNull())
    return df


def carry_neighbour(
    df: DataFrame, keys: list[str], order: str, cols: list[str], following: bool = False
) -> DataFrame:
    """Add ``prev_<col>`` (or ``next_<col>``) of a binned frame."""
    df = _keyed(df, keys)
    tag = "next" if following else "prev"
    direction = F.desc if following else F.asc
    inner = Window.partitionBy(*keys, BIN).orderBy(direction(order))
    outer = Window.partitionBy(*keys).orderBy(direction(BIN))
    pick = F.min_by if following else F.max_by
    edge = df.groupBy(*keys, BIN).agg(pick(F.struct(*cols), F.col(order)).alias("_edge"))
    edge = edge.select(*keys, BIN, F.lag("_edge").over(outer).alias("_edge"))
    out = df.withColumns(
        {"_row": F.row_number().over(inner)} | {f"{tag}_{c}": F.lag(c).over(inner) for c in cols}
    ).join(edge, [*keys, BIN], "left")
    return out.withColumns(
        {
            f"{tag}_{c}": F.when(F.col("_row") == 1, F.col(f"_edge.{c}")).otherwise(
                F.col(f"{tag}_{c}")
            )
            for c in cols
        }
    ).drop("_row", "_edge")


def running(
    df: DataFrame, keys: list[str], order: str, values: dict[str, tuple[str, Column]],
    exclusive: bool = False, descending: bool = False,
) -> DataFrame:
    """Running ``sum`` / ``max`` / ``min`` over a binned frame.

    ``values`` maps an output name to (how, column); all share one summary.
    """
    df = _keyed(df, keys)
    direction = F.desc if descending else F.asc
    aggs = {"sum": F.sum, "max": F.max, "min": F.min}
    upto = Window.unboundedPreceding
    inner = Window.partitionBy(*keys, BIN).orderBy(direction(order)).rowsBetween(
        upto, -1 if exclusive else 0
    )
    outer = Window.partitionBy(*keys).orderBy(direction(BIN)).rowsBetween(upto, -1)
    totals = df.groupBy(*keys, BIN).agg(
        *[aggs[how](v).alias(f"_t_{n}") for n, (how, v) in values.items()]
    )
    totals = totals.select(
        *keys, BIN,
        *[aggs[how](f"_t_{n}").over(outer).alias(f"_b_{n}") for n, (how, _) in values.items()],
    )
    out = df.withColumns({f"_h_{n}": aggs[how](v).over(inner) for n, (how, v) in values.items()})
    out = out.join(totals, [*keys, BIN], "left")
    merged = {}
    for n, (how, _) in values.items():
        here, before = F.col(f"_h_{n}"), F.col(f"_b_{n}")
        if how == "sum":
            merged[n] = F.coalesce(here, F.lit(0)) + F.coalesce(before, F.lit(0))
        else:
            merged[n] = (F.greatest if how == "max" else F.least)(here, before)
    return out.withColumns(merged).drop(*[f"_{p}_{n}" for n in values for p in "hb"])


def assign_runs(
    df: DataFrame, keys: list[str], order: str, opens: Callable[[Values, Values], Column],
    cols: list[str], width: int = BIN_WIDTH, name: str = "run_start",
) -> DataFrame:
    """Gaps and islands: ``name`` is the ``order`` value at which the run began.

    ``opens(cur, prev)`` tells whether a row opens a run, given its own values
    and those of the row before it (null for the first); ``cols`` are the
    columns it reads.  Rows before the first run get null.
    """
    cols = list(dict.fromkeys([order, *cols]))
    inner = Window.partitionBy(*keys, BIN).orderBy(order)
    outer = Window.partitionBy(*keys).orderBy(BIN)
    local = _keyed(with_bin(df, order, width), keys).withColumns(
        {"_row": F.row_number().over(inner)} | {f"_p_{c}": F.lag(c).over(inner) for c in cols}
    )
    opened = (F.col("_row") > 1) & opens(F.col, lambda c: F.col(f"_p_{c}"))
    local = local.withColumn("_open", F.when(opened, F.col(order)))
    edge = local.groupBy(*keys, BIN).agg(
        F.min_by(F.struct(*cols), F.struct(order, "_row")).alias("_first"),
        F.max_by(F.struct(*cols), F.struct(order, "_row")).alias("_last"),
        F.max("_open").alias("_open"),
    )
    edge = edge.withColumn("_before", F.lag("_last").over(outer))
    head = opens(lambda c: F.col(f"_first.{c}"), lambda c: F.col(f"_before.{c}"))
    edge = edge.withColumn("_head", F.when(head, F.col(f"_first.{order}")))
    edge = edge.withColumn(
        "_carry",
        F.max(F.greatest("_head", "_open")).over(outer.rowsBetween(Window.unboundedPreceding, -1)),
    ).select(*keys, BIN, F.coalesce("_head", "_carry").alias("_carry"))
    here = F.max("_open").over(inner.rowsBetween(Window.unboundedPreceding, 0))
    return (
        local.withColumn("_here", here)
        .join(edge, [*keys, BIN], "left")
        .withColumn(name, F.coalesce("_here", "_carry"))
        .drop(BIN, "_row", "_open", "_here", "_carry", *[f"_p_{c}" for c in cols])
    )


def numbered(
    df: DataFrame, keys: list[str], order: str, name: str, pos: str | None = None,
    width: int = BIN_WIDTH,
) -> DataFrame:
    """1-based row number per key without one task per key.

    A row without a key, order or position has no place in the order: it stays,
    with a null number.
    """
    placed = F.lit(True)
    for c in dict.fromkeys([*keys, order, pos or order]):
        placed = placed & F.col(c).isNotNull()
    binned = with_bin(df.filter(placed), pos or order, width)
    done = running(binned, keys, order, {name: ("sum", F.lit(1).cast("bigint"))}).drop(BIN)
    rest = df.filter(~placed).withColumn(name, F.lit(None).cast("bigint"))
    return done.unionByName(rest)


def apply_per_bin(
    df: DataFrame, fn: Callable, schema: str, width: int = BIN_WIDTH, keys: list[str] = ["chrom"],
    pos: str = "pos",
) -> DataFrame:
    """A user's own pandas function on each (key, position bin).

    Bins, not whole chromosomes, so that no task holds a chromosome; the
    function must not look across a bin border.
    """
    cols = df.columns
    parts = with_bin(df, pos, width).groupBy(*keys, BIN)
    # ``fn`` sees the frame without the bin column
    return parts.applyInPandas(lambda pdf: fn(pdf[cols]), schema)
