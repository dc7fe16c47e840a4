"""Understanding side-car of a semantic table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valora.operators.semantic import semantic_observations, understand

SIDECAR_COLUMNS = (
    "observation_id",
    "semantic_role",
    "understanding_status",
    "meaning_type",
    "meaning_json",
    "observation_provenance_json",
    "interpretation_provenance_json",
)


# The statuses of a side-car row.
UNDERSTANDING_STATUSES = (
    "FULLY_REPRESENTED", "PARTIALLY_UNDERSTOOD", "CLASSIFIED_ONLY", "AMBIGUOUS", "UNKNOWN", "UNREPRESENTED",
)


def sidecar(rows: DataFrame, reference: str, version: str | None = None) -> DataFrame:
    observed = understand(semantic_observations(rows, reference, version))
    provenance = F.to_json(
        F.struct(
            F.col("observation_origin").alias("origin_reference"),
            F.lit("COMMERCIAL_OBSERVATION").alias("origin_type"),
            F.col("observation_origin_version").alias("origin_version"),
        )
    )
    interpretation = F.to_json(
        F.struct(
            F.col("interpretation_origin").alias("origin_reference"),
            F.lit("SEMANTIC_NORMALIZATION").alias("origin_type"),
            F.col("interpretation_version").alias("origin_version"),
        )
    )
    return observed.withColumns(
        {
            "observation_provenance_json": provenance,
            "interpretation_provenance_json": interpretation,
        }
    ).select(*SIDECAR_COLUMNS)


def sidecar_checks(rows: DataFrame, built: DataFrame) -> DataFrame:
    """Input rows, output rows and distinct ids (all three must agree), and rows per status."""
    sides = rows.select(
        F.lit(True).alias("_given"), F.lit(None).cast("string").alias("_id"), F.lit(None).cast("string").alias("_status")
    ).union(
        built.select(F.lit(False), F.col("observation_id").cast("string"), "understanding_status")
    )
    counts = sides.agg(
        F.count_if("_given").alias("input_rows"),
        F.count_if(~F.col("_given")).alias("output_rows"),
        F.count_distinct("_id").alias("distinct_ids"),
        *[
            F.count_if(F.col("_status") == status).alias(f"{status.lower()}_rows")
            for status in UNDERSTANDING_STATUSES
        ],
    )
    return counts.withColumn(
        "consistent",
        (F.col("input_rows") == F.col("output_rows"))
        & (F.col("output_rows") == F.col("distinct_ids")),
    )


def write_sidecar(rows: DataFrame, path: str, reference: str, version: str | None = None) -> DataFrame:
    """Write the side-car, check what was written, and return counts per status.

    The table is computed once: the checks read the files. An inconsistent side-car is left
    in place and reported as an error.
    """
    sidecar(rows, reference, version).write.mode("overwrite").parquet(path)
    written = rows.sparkSession.read.parquet(path)
    checks = sidecar_checks(rows, written).first()
    if not checks["consistent"]:
        raise ValueError(
            f"side-car mismatch: input={checks['input_rows']} output={checks['output_rows']} "
            f"distinct ids={checks['distinct_ids']}"
        )
    return written.groupBy("understanding_status").count().orderBy("understanding_status")
