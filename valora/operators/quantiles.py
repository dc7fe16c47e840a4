"""Exact linear-interpolated quantiles without holding a group in one task.

``percentile`` keeps every distinct value of a group in one hash map, which fails when one
group holds a large part of the data. Here values are counted per (group, value), a
logarithmic histogram locates the bucket of each wanted rank, and only the distinct values of
those buckets (a band 0.025 % wide) are ranked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_PER_E_FOLD = 4096


def _log_bucket(value: Column) -> Column:
    size = F.floor(F.log1p(F.abs(value)) * _PER_E_FOLD)
    return F.when(value < 0, -size - 1).otherwise(size).cast("int")


def _ranks_inside(ranks: Column, below: Column, count: Column) -> Column:
    return F.filter(ranks, lambda r: (r >= below) & (r < below + count))


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    wanted: Sequence[tuple[str, float]],
    weight: str | None = None,
) -> DataFrame:
    """One row per key with a column per ``(name, q)``, equal to sorting and interpolating.

    ``weight`` says how often each row's value occurs (default once).
    """
    keys = list(keys)
    occurs = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_v"))
        .agg(occurs.alias("_c"))
        .withColumn("_b", _log_bucket(F.col("_v")))
    )
    group = Window.partitionBy(*keys)
    before = group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    positions = [(F.col("_n") - 1) * F.lit(float(q)) for _, q in wanted]
    neighbours = [f(p).cast("bigint") for p in positions for f in (F.floor, F.ceil)]
    bands = (
        counts.groupBy(*keys, "_b")
        .agg(F.sum("_c").alias("_bc"))
        .withColumn("_below", F.coalesce(F.sum("_bc").over(before), F.lit(0)))
        .withColumn("_n", F.sum("_bc").over(group))
        .withColumn(
            "_ranks",
            _ranks_inside(F.array_distinct(F.array(*neighbours)), F.col("_below"), F.col("_bc")),
        )
        .filter(F.size("_ranks") > 0)
    )
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, "_b"]]
    banded = counts.alias("l").join(bands.alias("r"), on).select(
        "l.*", "r._below", "r._n", "r._ranks"
    )
    inside = Window.partitionBy(*keys, "_b").orderBy("_v")
    so_far = F.sum("_c").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    ranked = (
        banded.withColumn("_first", F.col("_below") + F.coalesce(so_far, F.lit(0)))
        .withColumn("_hits", _ranks_inside(F.col("_ranks"), F.col("_first"), F.col("_c")))
        .filter(F.size("_hits") > 0)
    )

    def at(rank: Column) -> Column:
        return F.max(F.when(F.array_contains("_hits", rank), F.col("_v")))

    picks = []
    for (name, _), position in zip(wanted, positions):
        low = at(F.floor(position).cast("bigint")).alias(f"_lo_{name}")
        high = at(F.ceil(position).cast("bigint")).alias(f"_hi_{name}")
        picks += [low, high]
    solved = ranked.groupBy(*keys).agg(F.max("_n").alias("_n"), *picks)

    def interpolated(name: str, position: Column) -> Column:
        weight = position - F.floor(position)
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        return F.when(low == high, low).otherwise(low * (1 - weight) + high * weight).alias(name)

    return solved.select(
        *keys, *[interpolated(name, p) for (name, _), p in zip(wanted, positions)]
    )
