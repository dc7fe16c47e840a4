"""Connected components by alternating large and small stars, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valora.llm.common import drop_staged, staged


def _fetch_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Each edge with the least neighbour of its first node; both sides are dealt anew, so
    that Spark can split the rows of a node with very many edges."""
    return edges.join(least.hint("merge"), "a")


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = staged(
        both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")),
        "components-least",
    )
    out = (
        _fetch_least(both, least)
        .where(F.col("b") > F.col("a"))
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
        .distinct()
    )
    return out, least


def _small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = staged(down.groupBy("a").agg(F.min("b").alias("m")), "components-least")
    moved = _fetch_least(down, least).where(F.col("b") != F.col("m"))
    out = (
        moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
        .union(least.select("a", F.col("m").alias("b")))
        .distinct()
    )
    return out, least


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (least node reachable) for every node of the edges (a, b).

    Loops, repeated and null edges do no harm: a node that only has loops is left out. Large
    and small stars alternate until nothing changes; each round is written to the shared
    folder, so no plan grows and a lost executor costs at most one round. The number of rounds
    grows with the logarithm of the longest chain.
    """
    now = staged(edges.where("a IS NOT NULL AND b IS NOT NULL AND a != b").select("a", "b"), "components")

    def mark(df: DataFrame):
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % (1 << 31))).first())

    before = mark(now)
    while before[0]:
        large, of_large = _large_star(now)
        small, of_small = _small_star(large)
        following = staged(small, "components")
        drop_staged(now, of_large, of_small)
        now = following
        after = mark(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
