"""Price cohorts: range, quartiles, provider diversity and confidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valora.functions.price import commercial_context, offer_cadence
from valora.functions.text import fold
from valora.operators.quantiles import exact_quantiles
from valora.session import new_shared_folder

LOCAL, REMOTE = "LOCAL_SERVICE", "REMOTE_NATIONAL_SERVICE"
COHORT_KEYS = ("market", "canonical_service", "price_scope", "commercial_context")
COHORT_COLUMNS = (
    *COHORT_KEYS,
    "observations_n",
    "providers_n",
    "min_ars",
    "q1_ars",
    "median_ars",
    "q3_ars",
    "max_ars",
    "spread_ratio",
    "evidence_confidence",
    "decision_ready",
    "range_ready",
)
# Evidence thresholds (observations, providers, spread), strongest first.
CONFIDENCE = (("MEDIUM", 5, 3, 2.5), ("LOW", 3, 2, 2.0))


def confidence(n: Column, providers: Column, spread: Column) -> Column:
    """MEDIUM, LOW or INSUFFICIENT on the unrounded spread."""
    cases = [
        F.when((n >= least) & (providers >= sources) & (spread <= widest), F.lit(label))
        for label, least, sources, widest in CONFIDENCE
    ]
    return F.coalesce(*cases, F.lit("INSUFFICIENT"))


def price_cohorts(
    prices: DataFrame, keys: Sequence[str], price: str = "price", provider: str = "source"
) -> DataFrame:
    """Cohort statistics of any priced table: counts, range and exact quartiles."""
    keys = list(keys)
    # One shuffle feeds both branches, so the input (and its text rules) is evaluated once.
    cells = prices.groupBy(*keys, F.col(provider).alias("_p"), F.col(price).alias("_v")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    base = cells.groupBy(*keys).agg(
        F.sum("_n").alias("observations_n"),
        F.count_distinct("_p").alias("providers_n"),
        F.min("_v").alias("min_ars"),
        F.max("_v").alias("max_ars"),
    )
    quartiles = exact_quantiles(
        cells,
        keys,
        "_v",
        (("q1_ars", 0.25), ("median_ars", 0.5), ("q3_ars", 0.75)),
        weight="_n",
    )
    # Null-safe on both sides: a cohort with a null key stays, and no filter sets the branches apart.
    renamed = quartiles.withColumnsRenamed({k: f"_q_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_q_{k}")) for k in keys]
    spread = F.when(F.col("min_ars") > 0, F.col("max_ars") / F.col("min_ars")).otherwise(
        F.lit(float("inf"))
    )
    return (
        base.join(renamed, same, "left")
        .drop(*renamed.columns[: len(keys)])
        .withColumn("_spread", spread)
        .withColumn(
            "evidence_confidence",
            confidence(F.col("observations_n"), F.col("providers_n"), F.col("_spread")),
        )
        .withColumn("spread_ratio", F.round("_spread", 3))
        .withColumn("decision_ready", F.col("evidence_confidence") == "MEDIUM")
        .withColumn("range_ready", F.col("evidence_confidence").isin("LOW", "MEDIUM"))
        .drop("_spread")
    )


def _rules(folded: Column) -> dict[str, Column]:
    """Cadence and context that a folded text states."""
    return {"price_scope": offer_cadence(folded), "commercial_context": commercial_context(folded)}


def with_text_rules(rows: DataFrame, text: str = "economic_object_raw") -> DataFrame:
    """Add ``price_scope`` and ``commercial_context``, worked out once per distinct text.

    The distinct texts are written out first, so that their size is known when the join is
    planned: few of them go to all tasks, and the rows are not shuffled; many are shuffled.
    """
    spark = rows.sparkSession
    path = new_shared_folder(spark, "cohort-texts")
    texts = rows.select(F.col(text).alias("_text")).distinct()
    texts = texts.withColumns(_rules(fold(F.col("_text"), collapse=False)))
    texts.write.parquet(path)
    read = spark.read.schema(texts.schema).parquet(path)
    names = ("price_scope", "commercial_context")
    return rows.drop(*names).join(read, F.col(text).eqNullSafe(F.col("_text")), "left").drop("_text")


def _with_each_text(rows: DataFrame) -> DataFrame:
    folded = rows.withColumn("_folded", fold(F.col("economic_object_raw"), collapse=False))
    return folded.withColumns(_rules(F.col("_folded")))


def cohort_input(rows: DataFrame, texts_repeat: bool = False) -> DataFrame:
    """Semantic rows that may enter a cohort, with their cohort key and numeric price.

    ``texts_repeat``: objects repeat in very many rows, which are cheap to read twice.
    """
    market = F.when(F.col("market_scope") == LOCAL, F.col("province")).otherwise("AR")
    kept = rows.filter(
        (F.col("semantic_role") == "SINGLE_SERVICE")
        & F.col("market_scope").isin(LOCAL, REMOTE)
        & (F.col("currency") == "ARS")
    )
    kept = with_text_rules(kept) if texts_repeat else _with_each_text(kept)
    return (
        kept.withColumns(
            {
                "canonical_service": F.trim("canonical_service"),
                "price": F.col("price_value").cast("string").try_cast("double"),
                "market": market,
            }
        )
        .filter((F.col("canonical_service") != "") & F.col("price").isNotNull())
        .select("market_scope", *COHORT_KEYS, "price", "source")
    )


def cohort_statistics(rows: DataFrame, texts_repeat: bool = False) -> DataFrame:
    """Local and national cohorts of a semantic table; see ``cohort_input``."""
    return price_cohorts(cohort_input(rows, texts_repeat), ["market_scope", *COHORT_KEYS]).select(
        "market_scope", *COHORT_COLUMNS
    )


def ordered_cohorts(cohorts: DataFrame) -> DataFrame:
    """Largest and most diverse first; ties broken by key so the order is total."""
    return cohorts.orderBy(F.desc("observations_n"), F.desc("providers_n"), *COHORT_KEYS)


def first_cohort(cohorts: DataFrame, order: str) -> DataFrame:
    """First cohort per key in file order."""
    firsts = cohorts.groupBy(*COHORT_KEYS).agg(F.min(order).alias(order))
    return cohorts.join(firsts, [*COHORT_KEYS, order], "left_semi")
