"""Landed files: numbered lines, encodings, delimited resources."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from valora.operators.procurement import resource_type, value_class
from valora.session import cut_lineage
from valora.sources.records import CHUNK_BITS, quoted_records, record_cells

DELIMITERS = (",", ";", "\t", "|")
# Characters cp1252 puts where latin-1 has control codes.
_CP1252 = "".join(
    bytes([b]).decode("cp1252") for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)
)
_LATIN1 = "".join(chr(b) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))


def with_row_numbers(df: DataFrame, name: str = "row_number", first: int = 1) -> DataFrame:
    """Physical row numbers of a file scan.

    Rows are numbered inside their task; only one count per task is gathered to place the
    tasks one after another.
    """
    marked = df.withColumn("_mono", F.monotonically_increasing_id()).withColumns(
        {
            "_task": F.shiftright("_mono", 33),
            "_index": F.col("_mono").bitwiseAND(F.lit((1 << 33) - 1)),
        }
    )
    sizes = marked.groupBy("_task").agg((F.max("_index") + 1).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    numbered = marked.join(offsets, "_task")
    return numbered.withColumn(name, F.col("_offset") + F.col("_index") + first).drop(
        "_mono", "_task", "_index", "_n", "_offset"
    )


def file_profiles(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``line_profiles`` of landed files, from one scan."""
    # The text source keeps the bytes of a line as they are.
    return line_profiles(
        spark.read.text(list(paths)).select(
            F.input_file_name().alias("file"), "value", F.monotonically_increasing_id().alias("_id")
        )
    )


def _left_open(text: Column, delimiter: str) -> Column:
    """Whether a record that starts with the line has a quoted field open at its end."""
    d = "\\" + delimiter if delimiter == "|" else delimiter
    cell = f'(?:"(?:[^"]|"")*+"[^{d}]*+|[^"{d}][^{d}]*+|){d}'
    return F.contains(text, F.lit('"')) & text.rlike(f'^(?:{cell})*+"(?:[^"]|"")*+$')


def line_profiles(lines: DataFrame) -> DataFrame:
    """Encoding, delimiter and ``quoted_breaks`` per file; one small row per file.

    Input: file, value (bytes of a line as a string), _id in line order. A file is UTF-8 when
    every line is valid, else cp1252 unless it uses an undefined byte. The delimiter is the
    candidate that occurs in the header and as often in all other lines. ``quoted_breaks``: a
    quoted field goes on after the end of a line.
    """
    ok = F.is_valid_utf8("value")
    undefined = ~ok & F.hex("value").rlike("^(?:..)*?(?:81|8D|8F|90|9D)")
    text = F.col("value")
    agg = []
    for i, d in enumerate(DELIMITERS):
        count = F.length(text) - F.length(F.replace(text, F.lit(d), F.lit("")))
        agg.append(F.min_by(count, F.col("_id")).alias(f"_d{i}_head"))
        agg.append(F.min(F.when(text != "", count)).alias(f"_d{i}_least"))
        agg.append(F.bool_or(_left_open(text, d)).alias(f"_d{i}_open"))
    scored = lines.groupBy("file").agg(
        F.bool_and(ok).alias("_utf8"), F.bool_or(undefined).alias("_undefined"), *agg
    )
    ranked = F.array(
        *[
            F.struct(
                F.least(F.col(f"_d{i}_head"), F.col(f"_d{i}_least")).alias("steady"),
                F.col(f"_d{i}_head").alias("head"),
                F.lit(-i).alias("preference"),
                F.lit(d).alias("delimiter"),
                F.col(f"_d{i}_open").alias("open"),
            )
            for i, d in enumerate(DELIMITERS)
        ]
    )
    best = F.array_max(ranked)
    return scored.select(
        "file",
        F.when(F.col("_utf8"), F.lit("utf-8"))
        .when(F.col("_undefined"), "latin-1")
        .otherwise("cp1252")
        .alias("encoding"),
        F.when(best["head"] > 0, best["delimiter"]).otherwise(",").alias("delimiter"),
        F.when(best["head"] > 0, best["open"]).otherwise(F.col("_d0_open")).alias("quoted_breaks"),
    )


def _decoded(value: Column, encoding: Column) -> Column:
    """Text of a line whose bytes came as they are."""
    latin = F.decode(value.cast("binary"), "ISO-8859-1")
    return (
        F.when(encoding == "utf-8", value)
        .when(encoding == "cp1252", F.translate(latin, _LATIN1, _CP1252))
        .otherwise(latin)
    )


def bulk_records(lines: DataFrame, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """``file``, ``row_number``, ``names``, ``cells`` and ``row_raw`` of the records of files.

    Input as for `line_profiles`; each file is read with its own encoding, delimiter and header.
    Records count from 1 with the header, blank ones do not. Of equal names the last counts.
    ``cells`` is null for a record that no csv reader accepts.
    """
    profiles = line_profiles(lines).select("file", "encoding", "delimiter")
    texts = lines.join(profiles, "file").select(
        "file", "_id", _decoded(F.col("value"), F.col("encoding")).alias("value"), "delimiter"
    )
    cells = cut_lineage(record_cells(quoted_records(texts, chunk_bits)).drop("record", "delimiter"))
    names = F.transform(F.col("cells"), lambda c, i: F.when(i == 0, F.ltrim(c, F.lit("\ufeff"))).otherwise(c))
    later = lambda i: F.slice("names", i + 2, F.size("names"))
    headers = (
        cells.where("record_no = 0")
        .select("file", names.alias("names"))
        .withColumn("_at", F.sequence(F.lit(0), F.size("names") - 1))
        .withColumn("_at", F.filter("_at", lambda i: ~F.array_contains(later(i), F.get("names", i))))
    )
    keys = F.transform("_at", lambda i: F.get("names", i))
    values = F.transform("_at", lambda i: F.coalesce(F.get("cells", i), F.lit("")))
    return (
        cells.where("record_no > 0")
        .join(headers, "file")
        .select(
            "file", (F.col("record_no") + 1).alias("row_number"), "names", "cells",
            F.map_from_arrays(keys, F.when(F.col("cells").isNotNull(), values)).alias("row_raw"),
        )
    )


def read_bulk(
    spark: SparkSession, path: str, resource_id: str, resource_name: str, multiline: bool = False
) -> DataFrame:
    """Rows of one delimited resource, classified: a file or a folder of files.

    Encoding, delimiter and header are those of each file. A file whose quoted fields hold line
    breaks raises a ValueError unless ``multiline`` is set; such a file is split among tasks
    like any other. A record that cannot be read is rejected as malformed.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.input_file_name().alias("file"), "value", F.monotonically_increasing_id().alias("_id")
    )
    if not multiline and not line_profiles(lines).where("quoted_breaks").isEmpty():
        raise ValueError(f"{path}: quoted fields hold line breaks; read it with multiline=True")
    found = bulk_records(lines)
    shaped = found.select(
        F.lit(resource_id).alias("resource_id"),
        F.lit(resource_name).alias("resource_name"),
        "row_number",
        F.coalesce("row_raw", F.create_map().cast("map<string,string>")).alias("row_raw"),
        (F.coalesce(F.size("cells"), F.lit(0)) > F.size("names")).alias("has_extra_columns"),
        F.col("cells").isNull().alias("malformed"),
    )
    return classify_bulk_rows(shaped)


def _cell(name: str) -> Column:
    return F.coalesce(F.try_element_at("row_raw", F.lit(name)), F.lit(""))


def stable_row_id(kind: Column, row_number: Column) -> Column:
    """Identity of a row by resource type; UNKNOWN when its fields are empty."""
    award = F.concat_ws("|", _cell("Numero_Proceso"), _cell("Documento_Contractual"), _cell("CUIT"))
    by_type = (
        F.when(kind == "adjudicaciones", F.regexp_replace(award, r"^\|+|\|+$", ""))
        .when(kind == "convocatorias", F.trim(_cell("Numero_Proceso")))
        .when(kind == "sipro", F.trim(_cell("CUIT_NIT")))
        .when(kind == "sibys", F.trim(_cell("codigo")))
        .otherwise(F.concat(F.lit("ROW:"), row_number.cast("string")))
    )
    return F.coalesce(F.nullif(by_type, F.lit("")), F.lit("UNKNOWN"))


def classify_bulk_rows(rows: DataFrame) -> DataFrame:
    """Accepted rows and rejects with a reason; blank rows are not seen.

    Input: resource_id, resource_name, row_number, row_raw map, has_extra_columns; if there is a
    column ``malformed``, its rows are rejected.
    """
    malformed = F.col("malformed") if "malformed" in rows.columns else F.lit(False)
    blank = F.forall(F.map_values("row_raw"), lambda v: F.trim(v) == "") & ~F.col("has_extra_columns")
    blank &= ~malformed
    df = rows.filter(~blank).withColumn("resource_type", resource_type(F.col("resource_name")))
    df = df.withColumn("stable_id", stable_row_id(F.col("resource_type"), F.col("row_number")))
    reason = (
        F.when(malformed, F.lit("malformed record"))
        .when(F.col("has_extra_columns"), "extra columns beyond header")
        .when(F.col("stable_id") == "UNKNOWN", "missing stable row identity")
    )
    return df.withColumns(
        {
            "value_class": value_class(F.col("resource_type"), F.col("resource_name")),
            "source_record_id": F.concat(
                "resource_id", F.lit(":ROW:"), F.col("row_number").cast("string")
            ),
            "reject_reason": reason,
        }
    ).drop("has_extra_columns", "malformed")


def bulk_counters(rows: DataFrame, keys: Sequence[str] = ("resource_type",)) -> DataFrame:
    rejected = F.col("reject_reason").isNotNull()
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows_seen"),
        F.count_if(~rejected).alias("rows_accepted"),
        F.count_if(rejected).alias("rows_rejected"),
    )


# --- tables ----------------------------------------------------------------------------------


def list_evidence(
    table: DataFrame, filters: Mapping[str, object] | None = None, order: str = "id", limit: int | None = None
) -> DataFrame:
    """Rows with the given equalities (pushed to the scan), in id order, optionally first n."""
    out = filtered(table, filters).orderBy(order)
    return out if limit is None else out.limit(limit)


def count_evidence(table: DataFrame, filters: Mapping[str, object] | None = None) -> DataFrame:
    return filtered(table, filters).agg(F.count(F.lit(1)).alias("n"))


def filtered(table: DataFrame, filters: Mapping[str, object] | None) -> DataFrame:
    for column, value in (filters or {}).items():
        if value is not None:
            table = table.filter(F.col(column) == F.lit(value))
    return table


def write_table(df: DataFrame, path: str, columns: Sequence[str], fmt: str = "parquet") -> None:
    """Write in a fixed column order."""
    writer = df.select(*columns).write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)


def read_cohorts(spark: SparkSession, path: str) -> DataFrame:
    """Cohort CSV; absent cadence and context columns take their defaults. First row wins."""
    raw = spark.read.csv(path, header=True, multiLine=True)
    raw = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
    return load_cohorts(with_row_numbers(raw))


def load_cohorts(raw: DataFrame) -> DataFrame:
    """Typed cohorts from text columns plus ``row_number``."""
    from valora.operators.cohorts import first_cohort

    def default(name: str, value: str) -> Column:
        if name not in raw.columns:
            return F.lit(value)
        return F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(value))

    prices = ("min_ars", "q1_ars", "median_ars", "q3_ars", "max_ars", "spread_ratio")
    typed = raw.withColumns(
        {
            "price_scope": default("price_scope", "UNKNOWN"),
            "commercial_context": default("commercial_context", "STANDARD"),
            **{c: F.col(c).try_cast("decimal(18,4)") for c in prices},
            **{c: F.col(c).cast("int") for c in ("observations_n", "providers_n")},
            **{c: F.upper(c) == "YES" for c in ("decision_ready", "range_ready")},
        }
    )
    return first_cohort(typed, "row_number").drop("row_number")
