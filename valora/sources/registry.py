"""Source registry: read, validate, select what may be acquired."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from valora.functions import lexicon as lx
from valora.sources.files import with_row_numbers


def validate_registry(rows: DataFrame) -> DataFrame:
    """Trimmed, upper-cased registry rows with ``reject_reason``; blank rows are dropped.

    Input: the registry columns (optional ``notes``) and ``row_number``. The first row of a
    source is kept, later ones are rejected as duplicates.
    """
    fields = [*lx.REGISTRY_FIELDS, "notes"]
    if "notes" not in rows.columns:
        rows = rows.withColumn("notes", F.lit(""))
    df = rows.withColumns({c: F.trim(F.coalesce(F.col(c), F.lit(""))) for c in fields})
    df = df.filter(F.concat_ws("", *fields) != "")
    domains = dict(lx.REGISTRY_DOMAINS)
    df = df.withColumns({c: F.upper(c) for c in domains})
    first = df.filter(F.col("source") != "").groupBy("source").agg(
        F.min("row_number").alias("row_number"), F.lit(True).alias("_first")
    )
    df = df.join(first, ["source", "row_number"], "left")

    def place(text: str) -> Column:
        return F.concat(F.lit(f"{text} en fila "), F.col("row_number").cast("string"))

    missing = [F.when(F.col(c) == "", place(f"Campo obligatorio faltante '{c}'")) for c in lx.REGISTRY_FIELDS]
    duplicate = F.when(
        F.col("_first").isNull(), F.concat(F.lit("source duplicado: "), F.col("source"))
    )
    invalid = [
        F.when(~F.col(c).isin(*allowed), place(f"Valor inválido para '{c}'"))
        for c, allowed in lx.REGISTRY_DOMAINS
    ]
    return df.withColumn("reject_reason", F.coalesce(*missing, duplicate, *invalid)).drop("_first")


def acquisition_eligible() -> Column:
    return (
        (F.col("discovery_status") == "VERIFIED")
        & (F.col("price_visibility") == "PRICE_VISIBLE")
        & (F.col("source_kind") == "PROVIDER")
    )


def select_sources(registry: DataFrame) -> DataFrame:
    """Fetch specification of the sources that may be acquired."""
    return registry.filter(acquisition_eligible()).select(
        "source", "provider", "url", "province", "city"
    )


def read_registry(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Registry CSV (UTF-8, BOM allowed). ``strict`` fails the job on the first bad row."""
    raw = spark.read.csv(path, header=True, multiLine=True, encoding="UTF-8")
    clean = [c.lstrip("﻿") for c in raw.columns]
    missing = [c for c in lx.REGISTRY_FIELDS if c not in clean]
    if missing:
        raise ValueError("Faltan columnas obligatorias: " + ", ".join(missing))
    checked = validate_registry(with_row_numbers(raw.toDF(*clean), first=2))
    if not strict:
        return checked
    problem = F.when(F.col("reject_reason").isNotNull(), F.raise_error(F.col("reject_reason")))
    return checked.withColumn("source", F.coalesce(problem.cast("string"), F.col("source")))
