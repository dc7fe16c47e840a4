"""Whole jobs: acquisition log to cohorts, and offer sources to summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valora.operators.cohorts import cohort_statistics
from valora.operators.offers import build_offers
from valora.operators.pages import page_prices
from valora.operators.semantic import extend_baseline
from valora.session import cut_lineage
from valora.sources.evidence import (
    acquisition_failure,
    append_price_observations,
    append_raw_documents,
)


#: What an observation of a page does not say; part of its economic identity all the same.
_UNSAID = (
    "device_type_raw",
    "operating_system_raw",
    "backup_raw",
    "drivers_raw",
    "programs_raw",
    "license_raw",
    "modality_raw",
)


def live_pricing(
    fetched: DataFrame,
    baseline: DataFrame,
    stored: DataFrame | None = None,
    baseline_order: str = "row_number",
    stored_observations: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Fetched pages to observations of the evidence store to semantic rows to cohorts.

    fetched: arrival, source, source_record_id, province, city, raw_content, error. Every result
    raises at run time when no source succeeded: the guard is a scalar subquery of the rows that
    all results but ``run`` begin with.

    An observation is new unless the store, or an earlier one of this run, has its document
    identity or its economic identity; prices of a page that was fetched again with other
    contents are mostly known. ``stored_observations``, with the columns of ``observations``,
    are those of earlier runs; they stay part of the rows, and their documents, with
    ``raw_document_id``, ``province`` and ``city``, are in ``stored``. The observations of this
    run are read and settled when the job is made; what follows is lazy.
    """
    succeeded = F.count_if(F.col("error").isNull()).alias("ok")
    guard = fetched.agg(succeeded).select(
        F.when(F.col("ok") == 0, F.raise_error(F.lit("no source succeeded")).cast("bigint"))
        .otherwise(F.col("ok"))
        .alias("sources_succeeded")
    )
    some = guard.scalar() > 0
    good = append_raw_documents(fetched.filter(F.col("error").isNull()), stored, "arrival").filter(
        F.col("outcome") == "ACQUIRED"
    )
    pages = good.select(F.col("arrival").alias("page_id"), F.col("raw_content").alias("html"))
    found = page_prices(pages).join(good.select(F.col("arrival").alias("page_id"), "source"), "page_id")
    found = found.select(
        F.struct("page_id", "ordinal").alias("place"),
        F.concat_ws(":", "page_id", "ordinal").alias("observation_id"),
        F.col("page_id").alias("raw_document_id"),
        "source",
        "source_record_id",
        "economic_object_raw",
        F.col("economic_object_raw").alias("scope_raw"),
        F.col("price_value").cast("string").alias("price_value"),
        "currency_raw",
        *[F.lit("UNKNOWN").alias(name) for name in _UNSAID],
        "comparable_status",
        F.lit("page_prices_v1").alias("extractor_version"),
    )
    # pages are read once: the two-key rule takes rounds over what was found on them
    new = append_price_observations(cut_lineage(found), stored_observations, "place").drop("place")
    documents = good.filter(some)
    places = documents.select(F.col("arrival").alias("raw_document_id"), "province", "city")
    observations = new
    if stored_observations is not None:
        observations = new.unionByName(stored_observations.select(*new.columns))
        places = places.unionByName(stored.select(*places.columns))
    rows = extend_baseline(
        observations.filter(some).withColumnRenamed("currency_raw", "currency"),
        places,
        baseline,
        baseline_order,
    )
    return {
        "run": guard,
        "documents": documents,
        "observations": new.filter(some),
        "rows": rows,
        "cohorts": cohort_statistics(rows),
    }


def run_offer_sources(staged: DataFrame) -> dict[str, DataFrame]:
    """Offers of all sources. A source with a load error does not stop the others.

    staged: offer columns plus ``load_error`` (NULL when the row was read).
    """
    built = build_offers(staged.filter(F.col("load_error").isNull()))
    per_source = staged.groupBy("source").agg(
        F.when(F.max("load_error").isNull(), "SUCCESS").otherwise("FAILURE").alias("status"),
        F.count_if(F.col("load_error").isNull()).alias("rows_read"),
    )
    return {"offers": built, "runs": per_source}


def failed_sources(log: DataFrame) -> DataFrame:
    return log.withColumn("error_type", acquisition_failure(F.col("error")))
