"""Readouts of award, order and run tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from valora.operators.quantiles import exact_quantiles

UNKNOWN = "UNKNOWN"


def amount_distribution(df: DataFrame, amount: str = "amount") -> DataFrame:
    """Count of rows, and sum, median, min, max, zero and negative counts of numeric amounts."""
    value = F.col(amount)
    base = df.agg(
        F.count(F.lit(1)).alias("total_awards"),
        F.sum(value).alias("total_amount"),
        F.min(value).alias("min_amount"),
        F.max(value).alias("max_amount"),
        F.count_if(value == 0).alias("zero_awards"),
        F.count_if(value < 0).alias("negative_awards"),
    )
    # Both sides are one row.
    median = exact_quantiles(df, [], amount, (("median_amount", 0.5),))
    return base.join(median, F.lit(True), "left")


def group_label(code: Column, description: Column, text: Column) -> Column:
    """``code - description``, else the code, else the plain text."""
    code, description = (F.nullif(c, F.lit("")) for c in (code, description))
    return F.coalesce(
        F.when(description.isNotNull(), F.concat(F.coalesce(code, F.lit("None")), F.lit(" - "), description)),
        code,
        text,
    )


def top_groups(
    df: DataFrame, labels: Mapping[str, Column], amount: Column, k: int, by_amount: bool
) -> DataFrame:
    """Top k labels of several dimensions from one scan; a missing amount counts as zero.

    The rank filter is pushed below the shuffle as a per-task group limit.
    """
    cells = F.array(
        *[
            F.struct(F.lit(name).alias("dimension"), label.cast("string").alias("label"))
            for name, label in labels.items()
        ]
    )
    grouped = (
        df.select(F.coalesce(amount, F.lit(0.0)).alias("_amount"), F.inline(cells))
        .groupBy("dimension", "label")
        .agg(
            F.count(F.lit(1)).alias("award_count"),
            F.sum("_amount").alias("observed_amount"),
        )
    )
    metric = "observed_amount" if by_amount else "award_count"
    order = Window.partitionBy("dimension").orderBy(F.desc(metric), F.asc("label"))
    return grouped.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def awards_by_month(df: DataFrame, start: Column) -> DataFrame:
    """Rows per ``YYYY-MM`` of a date text, UNKNOWN when it is too short."""
    month = F.when(F.length(start) >= 7, F.substring(start, 1, 7)).otherwise(UNKNOWN)
    return df.groupBy(month.alias("month")).agg(F.count(F.lit(1)).alias("award_count")).orderBy("month")


def awards_by_place(df: DataFrame, country: Column, state: Column, k: int) -> DataFrame:
    place = F.concat(
        F.coalesce(country, F.lit(UNKNOWN)), F.lit(":"), F.coalesce(state, F.lit(UNKNOWN))
    )
    grouped = df.groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("award_count"))
    return grouped.orderBy(F.desc("award_count"), "place").limit(k)


def extreme_awards(
    df: DataFrame, amount: str, k: int, tie: Sequence[str], largest: bool = True
) -> DataFrame:
    """The k largest, or the k smallest positive, rows."""
    value = F.col(amount)
    rows = df.filter(value.isNotNull() if largest else value > 0)
    return rows.orderBy(F.desc(amount) if largest else F.asc(amount), *tie).limit(k)


def description_quality(df: DataFrame, text: Column) -> DataFrame:
    size = F.length(F.when(text == UNKNOWN, "").otherwise(F.coalesce(text, F.lit(""))))
    return df.agg(
        F.count_if(size == 0).alias("empty"),
        F.count_if((size > 0) & (size < 20)).alias("short_lt_20"),
        F.count_if(size >= 20).alias("normal_gte_20"),
    )


def is_present(value: Column) -> Column:
    """UNKNOWN, '', [] and {} are absent."""
    return F.coalesce(~value.cast("string").isin("", UNKNOWN, "[]", "{}"), F.lit(False))


def field_coverage(df: DataFrame, fields: Mapping[str, Column]) -> DataFrame:
    """present / total per field, long form, one scan."""
    counted = df.agg(
        F.count(F.lit(1)).alias("_total"),
        *[F.count_if(is_present(column)).alias(name) for name, column in fields.items()],
    )
    return counted.unpivot("_total", list(fields), "field", "present").select(
        "field", "present", F.col("_total").alias("total")
    )


def value_coverage(df: DataFrame, value: Column, currency: Column) -> DataFrame:
    return df.agg(
        F.count_if(is_present(value)).alias("with_any_value"),
        F.count_if(is_present(currency)).alias("with_currency"),
        F.count_if(~is_present(value)).alias("without_value"),
    )


def histogram(df: DataFrame, label: Column, name: str = "label") -> DataFrame:
    return df.groupBy(label.alias(name)).agg(F.count(F.lit(1)).alias("n"))


def review_audit(corpus: DataFrame, review: DataFrame, on: str, status: str) -> DataFrame:
    """Ids missing from the review, ids only in it, and counts per review status."""
    missing = corpus.select(on).distinct().join(review.select(on), on, "left_anti")
    extra = review.select(on).distinct().join(corpus.select(on), on, "left_anti")
    parts = [
        missing.agg(F.count(F.lit(1)).alias("n")).select(F.lit("missing").alias("label"), "n"),
        extra.agg(F.count(F.lit(1)).alias("n")).select(F.lit("extra").alias("label"), "n"),
        histogram(review, F.concat(F.lit("status="), F.col(status).cast("string"))),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def review_differences(corpus: DataFrame, review: DataFrame, on: str) -> DataFrame:
    """The differing ids themselves, one row each."""
    missing = corpus.select(on).distinct().join(review.select(on), on, "left_anti")
    extra = review.select(on).distinct().join(corpus.select(on), on, "left_anti")
    return missing.withColumn("side", F.lit("missing")).unionByName(
        extra.withColumn("side", F.lit("extra"))
    )


def run_metrics(runs: DataFrame, name: str = "source", status: str = "status") -> DataFrame:
    """Runs and distinct names per status; the names stay rows (see ``run_names``)."""
    return runs.groupBy(status).agg(
        F.count(F.lit(1)).alias("runs"), F.count_distinct(name).alias("names")
    )


def run_names(runs: DataFrame, name: str = "source", status: str = "status") -> DataFrame:
    return runs.select(status, name).distinct().orderBy(status, name)


def registry_coverage(registry: DataFrame, eligible: Column, by: str = "province") -> DataFrame:
    return registry.groupBy(by).agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if(eligible).alias("eligible")
    )


def yield_ratios(df: DataFrame, counts: Mapping[str, Column]) -> DataFrame:
    """Acquisition, density, usefulness and technology ratios; NULL over zero.

    ``counts``: operations, acquired, accepted, useful_semantics, comparable, sources, technology.
    """
    row = df.agg(*[F.sum(c.cast("bigint")).alias(name) for name, c in counts.items()])
    ratios = {
        "acquisition_yield": ("accepted", "operations"),
        "economic_density": ("useful_semantics", "acquired"),
        "useful_observation_yield": ("comparable", "sources"),
        "technology_yield": ("technology", "acquired"),
    }
    return row.select(
        *[F.round(F.try_divide(F.col(a), F.col(b)), 6).alias(n) for n, (a, b) in ratios.items()]
    )


# Acquisition stages in order.
FUNNEL_STAGES = (
    "DISCOVERED",
    "VERIFIED",
    "ACQUISITION_ATTEMPTED",
    "RAW_ACQUIRED",
    "PRICE_DETECTED",
    "ECONOMIC_OBSERVATION",
    "QUALITY_ACCEPTED",
    "COMPARABLE",
)


def funnel(df: DataFrame, reached: Column, stages: Sequence[str] = FUNNEL_STAGES) -> DataFrame:
    """Rows that got at least to each stage (``reached`` = last stage index, 0-based)."""
    counted = df.agg(
        *[F.count_if(reached >= i).alias(stage) for i, stage in enumerate(stages)]
    )
    cells = F.array(
        *[
            F.struct(
                F.lit(i + 1).alias("stage_order"),
                F.lit(stage).alias("stage"),
                F.col(stage).alias("n"),
                F.round(
                    F.try_divide(F.col(stage), F.col(stages[i - 1])) if i else F.lit(1.0), 6
                ).alias("conversion"),
            )
            for i, stage in enumerate(stages)
        ]
    )
    return counted.select(F.inline(cells))


def line_distribution(lines: DataFrame, order: Sequence[str]) -> DataFrame:
    """Lines per order: single, multiple, min, max and exact median."""
    sizes = lines.groupBy(*order).agg(F.count(F.lit(1)).alias("lines_n"))
    base = sizes.agg(
        F.count_if(F.col("lines_n") == 1).alias("single_item_orders"),
        F.count_if(F.col("lines_n") > 1).alias("multi_item_orders"),
        F.coalesce(F.min("lines_n"), F.lit(0)).alias("min_lines_per_order"),
        F.coalesce(F.max("lines_n"), F.lit(0)).alias("max_lines_per_order"),
    )
    median = exact_quantiles(sizes, [], "lines_n", (("median_lines_per_order", 0.5),))
    return base.join(median, F.lit(True), "left").fillna(0.0, ["median_lines_per_order"])
