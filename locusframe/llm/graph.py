"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _fingerprint(edges: DataFrame):
    return edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 1_000_003)).first()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node with a link; ``label`` is the smallest node reachable.

    ``edges`` has ``a`` and ``b`` of one orderable type.  Each round hangs the larger
    neighbours of a node, then its smaller ones, under the smallest; rounds grow with
    the logarithm of the longest chain.  Every step is an aggregate with partial
    minima and a plain join, so a node with very many links is no task of its own.
    """
    links = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while (now := _fingerprint(links)) != before:
        before = now
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stored(large, "large-star")
        least = stored(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").union(
            least.select("a", F.col("m").alias("b"))
        )
        links = stored(small.distinct(), "small-star")
    return links.select(F.col("a").alias("node"), F.col("b").alias("label"))
