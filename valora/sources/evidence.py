"""Evidence intake: raw documents, language evidence, candidate sources, price observations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from valora.functions.json_text import canonical_json
from valora.operators.dedup import accept_two_keys, mark_new, only_new, with_children
from valora.operators.procurement import UNKNOWN, json_problem, pick, present
from valora.session import ship_package
from valora.sources.files import with_row_numbers

RAW_KEY = ("source", "source_record_id", "content_hash")
ECONOMIC_IDENTITY = (
    "source",
    "source_record_id",
    "extractor_version",
    "economic_object_raw",
    "scope_raw",
    "price_value",
    "currency_raw",
    "device_type_raw",
    "operating_system_raw",
    "backup_raw",
    "drivers_raw",
    "programs_raw",
    "license_raw",
    "modality_raw",
    "comparable_status",
)
DOCUMENT_IDENTITY = ("raw_document_id", "extractor_version", "source_record_id")


# --- raw documents ------------------------------------------------------------------------------


def append_raw_documents(
    incoming: DataFrame, stored: DataFrame | None, order: str, hash_column: str = "content_hash"
) -> DataFrame:
    """Incoming documents with their SHA-256 and outcome ACQUIRED or DUPLICATE."""
    hashed = incoming.withColumn(hash_column, F.sha2(F.col("raw_content"), 256))
    if stored is not None and hash_column not in stored.columns:
        stored = stored.withColumn(hash_column, F.sha2(F.col("raw_content"), 256))
    return mark_new(hashed, RAW_KEY, order, stored)


def append_price_observations(
    incoming: DataFrame, stored: DataFrame | None, order: str
) -> DataFrame:
    """New observations only: a row is ignored when either identity is already taken."""
    return accept_two_keys(incoming, DOCUMENT_IDENTITY, ECONOMIC_IDENTITY, order, stored)


def append_orders(
    orders: DataFrame, lines: DataFrame, stored: DataFrame | None, order: str
) -> tuple[DataFrame, DataFrame]:
    """New orders with their lines; a duplicate order drops its lines too."""
    key = ("raw_document_id", "extractor_version")
    new = only_new(orders, key, order, stored)
    return new, with_children(new, lines, ("raw_document_id",))


# --- JSON lines ---------------------------------------------------------------------------------


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Numbered lines of a JSONL file; a leading BOM is dropped."""
    text = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("line"))
    return with_row_numbers(text, "line_number")


def _payload(lines: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Non-blank lines with parse problem and payload as string fields."""
    problem = json_problem(F.col("line"))
    schema = ", ".join(f"{f} STRING" for f in fields)
    return (
        lines.filter(F.trim("line") != "")
        .withColumn(
            "_problem",
            F.when(problem == "invalid raw JSON", F.lit("invalid JSON")).when(
                problem.isNotNull(), F.lit("line must be a JSON object")
            ),
        )
        .withColumn("_p", F.from_json(F.when(problem.isNull(), F.col("line")), schema))
    )


def _required(name: str) -> Column:
    value = F.col(f"_p.{name}")
    return F.when(value.isNull() | (value == ""), F.lit(f"{name} es obligatorio"))


def _iso(name: str) -> Column:
    return F.try_to_timestamp(F.col(f"_p.{name}"))


def _bad_time(name: str) -> Column:
    value = F.col(f"_p.{name}")
    bad = value.isNotNull() & (value != "") & _iso(name).isNull()
    return F.when(bad, F.concat(F.lit("invalid time: "), value))


def _metadata() -> tuple[Column, Column]:
    """(object text, reject reason). Falsy metadata is the empty object."""
    raw = F.col("_p.metadata")
    falsy = raw.isNull() | raw.isin("", "{}", "[]", "0", "0.0", "false")
    bad = ~falsy & ~raw.startswith("{")
    return (
        F.when(falsy, F.lit("{}")).otherwise(raw),
        F.when(bad, F.lit("metadata debe ser un objeto")),
    )


def import_language(lines: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """User texts from JSONL: outcome ACCEPTED, DUPLICATE or REJECTED with reason per line.

    A missing ``source_id`` becomes the hash of source, url and text.
    """
    fields = ("raw_text", "source", "source_url", "language", "observed_at", "source_id", "metadata")
    metadata, bad_metadata = _metadata()
    df = _payload(lines, fields)
    required = ("raw_text", "source", "source_url", "language", "observed_at")
    reason = F.coalesce(
        F.col("_problem"),
        *[_required(f) for f in required],
        _bad_time("observed_at"),
        bad_metadata,
    )
    given = F.nullif(F.trim(F.coalesce("_p.source_id", F.lit(""))), F.lit(""))
    zero = F.lit("\x00")
    digest = F.sha2(F.concat("_p.source", zero, "_p.source_url", zero, "_p.raw_text"), 256)
    rows = df.select(
        "line_number",
        *[F.col(f"_p.{f}").alias(f) for f in ("source", "source_url", "raw_text", "language")],
        F.coalesce(given, F.concat(F.lit("sha256:"), digest)).alias("source_id"),
        _iso("observed_at").alias("observed_at"),
        metadata.alias("metadata"),
        reason.alias("reject_reason"),
    )
    return _with_outcome(rows, ("source", "source_id"), stored)


def import_candidates(lines: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Candidate sources from JSONL, keyed by (url, source_type); default status CANDIDATE."""
    fields = (
        "name",
        "url",
        "source_type",
        "country",
        "language",
        "acquisition_method",
        "status",
        "last_checked_at",
        "notes",
        "metadata",
    )
    metadata, bad_metadata = _metadata()
    df = _payload(lines, fields)
    reason = F.coalesce(
        F.col("_problem"),
        bad_metadata,
        *[_required(f) for f in ("name", "url", "source_type", "acquisition_method")],
        _bad_time("last_checked_at"),
    )

    def text(name: str) -> Column:
        return F.trim(F.coalesce(F.col(f"_p.{name}"), F.lit("")))

    rows = df.select(
        "line_number",
        *[F.col(f"_p.{f}").alias(f) for f in ("name", "url", "source_type", "acquisition_method")],
        text("country").alias("country"),
        text("language").alias("language"),
        F.coalesce(F.nullif(text("status"), F.lit("")), F.lit("CANDIDATE")).alias("status"),
        _iso("last_checked_at").alias("last_checked_at"),
        F.coalesce("_p.notes", F.lit("")).alias("notes"),
        metadata.alias("metadata"),
        reason.alias("reject_reason"),
    )
    return _with_outcome(rows, ("url", "source_type"), stored)


def _with_outcome(rows: DataFrame, key: Sequence[str], stored: DataFrame | None) -> DataFrame:
    """Rejected rows never compete for a key: they are keyed by their own line."""
    ok = F.col("reject_reason").isNull()
    keyed = rows.withColumns(
        {
            **{f"_k_{k}": F.when(ok, F.col(k)) for k in key},
            "_k_line": F.when(~ok, F.col("line_number")),
        }
    )
    names = [f"_k_{k}" for k in key] + ["_k_line"]
    known = None
    if stored is not None:
        known = stored.select(
            *[F.col(k).alias(f"_k_{k}") for k in key], F.lit(None).cast("bigint").alias("_k_line")
        )
    marked = mark_new(keyed, names, "line_number", known)
    outcome = (
        F.when(~ok, F.lit("REJECTED"))
        .when(F.col("outcome") == "ACQUIRED", "ACCEPTED")
        .otherwise("DUPLICATE")
    )
    return marked.withColumn("outcome", outcome).drop(*names)


# --- landed search results ------------------------------------------------------------------------


def _document(df: DataFrame, identity: Column, reason: str, source: str, url: Column, metadata: dict):
    ship_package(df.sparkSession)
    df = df.withColumn("_canonical", canonical_json(F.col("payload")))
    unread = F.when(F.col("_canonical").isNull(), F.lit("invalid raw JSON"))
    bad = F.coalesce(json_problem(F.col("payload")), unread)
    missing = F.when(F.coalesce(F.trim(identity), F.lit("")) == "", F.lit(reason))
    return df.select(
        "arrival",
        F.lit(source).alias("source"),
        F.trim(identity).alias("source_record_id"),
        url.alias("source_url"),
        F.lit("application/json").alias("content_type"),
        F.col("_canonical").alias("raw_content"),
        F.sha2(F.col("_canonical"), 256).alias("content_hash"),
        F.coalesce(bad, missing).alias("reject_reason"),
        *[value.alias(name) for name, value in metadata.items()],
    )


def _object(df: DataFrame, names: Sequence[str]) -> DataFrame:
    schema = ", ".join(f"`{n}` STRING" for n in names)
    return df.withColumn("_r", F.from_json(F.col("payload"), schema))


def _first_link(links: Column, preferred: str) -> Column:
    entries = F.from_json(links, "map<string,string>")
    return F.coalesce(
        present(F.try_element_at(entries, F.lit(preferred))),
        F.try_element_at(F.map_values(entries), F.lit(1)),
    )


def notice_documents(landed: DataFrame, notice_url: str) -> DataFrame:
    """Search results to raw documents. ``notice_url`` is a ``%s`` template for the number."""
    names = ("publication-number", "id", "publication-date", "classification-cpv")
    names += ("notice-title", "buyer-name", "buyer-country", "links")
    df = _object(landed, names)
    rec = F.col("_r")
    links = F.from_json(rec["links"], "xml STRING, html STRING")
    number = present(rec["publication-number"])
    url = F.coalesce(
        F.when(present(links["xml"]).startswith("{"), _first_link(links["xml"], "MUL")),
        F.when(present(links["html"]).startswith("{"), _first_link(links["html"], "ENG")),
        F.when(number.isNotNull(), F.format_string(notice_url, number)),
        F.lit(UNKNOWN),
    )

    def given(name: str) -> Column:
        return F.coalesce(rec[name], F.lit(UNKNOWN))

    return _document(
        df,
        F.coalesce(number, present(rec["id"])),
        "missing source_record_id",
        "notices",
        url,
        {
            "publication_date_raw": given("publication-date"),
            "classification_raw": given("classification-cpv"),
            "title_raw": given("notice-title"),
            "buyer_raw": given("buyer-name"),
            "buyer_country_raw": given("buyer-country"),
        },
    )


def award_documents(landed: DataFrame, award_url: str) -> DataFrame:
    names = ("generated_internal_id", "internal_id", "Recipient Name", "Awarding Agency")
    names += ("Description", "Contract Description", "Award Amount", "NAICS", "PSC")
    names += ("Start Date", "End Date", "Place of Performance State Code")
    names += ("Place of Performance Country Code",)
    df = _object(landed, names)
    rec = F.col("_r")
    identity = F.coalesce(present(rec["generated_internal_id"]), present(rec["internal_id"]))

    def given(name: str) -> Column:
        return F.coalesce(rec[name], F.lit(UNKNOWN))

    return _document(
        df,
        identity,
        "missing generated_internal_id",
        "awards",
        F.format_string(award_url, F.trim(identity)),
        {
            "recipient_raw": given("Recipient Name"),
            "awarding_agency_raw": given("Awarding Agency"),
            "description_raw": pick(rec, "Description", "Contract Description"),
            "award_amount_raw": given("Award Amount"),
            "naics_raw": given("NAICS"),
            "psc_raw": given("PSC"),
            "start_date_raw": given("Start Date"),
            "end_date_raw": given("End Date"),
            "state_raw": given("Place of Performance State Code"),
            "country_raw": given("Place of Performance Country Code"),
        },
    )


def order_documents(landed: DataFrame, order_url: str) -> DataFrame:
    """Orders to raw documents with presence counts of their item fields."""
    names = ("Codigo", "Comprador", "Proveedor", "Descripcion", "Estado", "CodigoEstado")
    names += ("TipoMoneda", "Total", "TotalNeto", "Items")
    df = _object(landed, names)
    rec = F.col("_r")
    listed = F.from_json(rec["Items"], "Listado ARRAY<STRING>")["Listado"]
    items = F.filter(
        F.coalesce(listed, F.array().cast("array<string>")),
        lambda i: F.coalesce(i.startswith("{"), F.lit(False)),
    )
    fields = "Cantidad STRING, Unidad STRING, PrecioNeto STRING"
    df = df.withColumn("_items", F.transform(items, lambda i: F.from_json(i, fields)))

    def having(name: str) -> Column:
        return F.size(F.filter("_items", lambda i: present(i[name]).isNotNull()))

    def given(name: str, other: str | None = None) -> Column:
        second = [rec[other]] if other else []
        return F.coalesce(rec[name], *second, F.lit(UNKNOWN))

    code = F.trim(F.coalesce(rec["Codigo"], F.lit("")))
    return _document(
        df,
        F.when(code != "", F.concat(F.lit("PURCHASE_ORDER:"), code)),
        "missing Codigo",
        "orders",
        F.format_string(order_url, code),
        {
            "buyer_raw": given("Comprador"),
            "supplier_raw": given("Proveedor"),
            "description_raw": given("Descripcion"),
            "status_raw": given("Estado", "CodigoEstado"),
            "currency_raw": given("TipoMoneda"),
            "total_amount_raw": given("Total"),
            "net_amount_raw": given("TotalNeto"),
            "items_count": F.size("_items"),
            "has_several_items": F.size("_items") > 1,
            "quantity_fields_present": having("Cantidad"),
            "unit_fields_present": having("Unidad"),
            "unit_price_fields_present": having("PrecioNeto"),
        },
    )


def enrich_full_notices(
    documents: DataFrame, responses: DataFrame, stored: DataFrame | None = None
) -> DataFrame:
    """Match landed responses to search documents and classify each request.

    responses: source_record_id, status_code, content_type, body, waf_action, error. Outcome:
    ACCEPTED, DUPLICATE, NOT_AVAILABLE, REJECTED or FAILED, with reason.
    """
    df = documents.join(responses, "source_record_id", "left")
    body = F.coalesce("body", F.lit(""))
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    start = F.ltrim(body)
    readable = kind.rlike("xml|json") | start.startswith("<") | start.startswith("{")
    failed = F.col("status_code").isNull()
    absent = (F.col("status_code") != 200) | (body == "")
    prefix = "ted_direct_link_not_available: status="
    reason = (
        F.when(failed, F.coalesce("error", F.lit("no response")))
        .when(
            absent & (F.col("status_code") == 202) & (F.coalesce("waf_action", F.lit("")) != ""),
            F.concat(F.lit(f"{prefix}202 waf_action="), F.col("waf_action")),
        )
        .when(absent & (F.col("status_code") == 202), f"{prefix}202 empty body")
        .when(
            absent,
            F.concat(
                F.lit(prefix),
                F.col("status_code").cast("string"),
                F.lit(" body_length="),
                F.length(body).cast("string"),
            ),
        )
        .when(~readable, F.concat(F.lit("unexpected content_type="), F.coalesce("content_type", F.lit(""))))
    )
    state = (
        F.when(failed, F.lit("FAILED"))
        .when(absent, "NOT_AVAILABLE")
        .when(~readable, "REJECTED")
        .otherwise("READY")
    )
    classed = df.withColumns(
        {
            "reason": reason,
            "_state": state,
            "full_content_hash": F.when(state == "READY", F.sha2(body, 256)),
            "full_content_type": F.coalesce(F.nullif("content_type", F.lit("")), F.lit("application/xml")),
            "_own": F.when(state != "READY", F.col("arrival")),
        }
    )
    known = None
    if stored is not None:
        known = stored.select(
            "source_record_id", "full_content_hash", F.lit(None).cast("bigint").alias("_own")
        )
    marked = mark_new(classed, ("source_record_id", "full_content_hash", "_own"), "arrival", known)
    outcome = (
        F.when(F.col("_state") != "READY", F.col("_state"))
        .when(F.col("outcome") == "ACQUIRED", "ACCEPTED")
        .otherwise("DUPLICATE")
    )
    return marked.withColumn("outcome", outcome).drop("_state", "_own")


# --- run log -------------------------------------------------------------------------------------


def acquisition_failure(error: Column) -> Column:
    """Failure class of a logged error text; NULL without an error."""
    text = F.lower(error)
    dns = r"nameresolutionerror|failed to resolve|getaddrinfo failed|name or service not known"
    return F.when(
        error.isNotNull(),
        F.when(text.rlike(r"sslerror|certificate"), F.lit("TLS_CERTIFICATE_ERROR"))
        .when(text.rlike(r"timeout|timed out"), "TIMEOUT")
        .when(text.rlike(r"httperror|http error|client error|server error"), "HTTP_ERROR")
        .when(text.rlike(dns), "DNS_ERROR")
        .otherwise("CONNECTION_ERROR"),
    )


def acquisition_counters(log: DataFrame) -> DataFrame:
    """One row of run counters.

    log: error, raw_outcome, observations_new, observations_duplicate, exact_prices per source.
    """
    failed = F.col("error").isNotNull()

    def total(name: str) -> Column:
        return F.coalesce(F.sum(F.when(~failed, F.col(name).cast("bigint"))), F.lit(0))

    return log.agg(
        F.count(F.lit(1)).alias("sources_attempted"),
        F.count_if(~failed).alias("sources_succeeded"),
        F.count_if(failed).alias("sources_failed"),
        F.count_if(~failed & (F.col("raw_outcome") == "ACQUIRED")).alias("raw_docs_acquired"),
        F.count_if(~failed & (F.col("raw_outcome") == "DUPLICATE")).alias("raw_docs_duplicate"),
        total("observations_new").alias("observations_extracted"),
        total("observations_duplicate").alias("observations_duplicate"),
        total("exact_prices").alias("exact_prices"),
    )


def page_summary(observations: DataFrame, keys: Sequence[str] = ("source",)) -> DataFrame:
    return observations.groupBy(*keys).agg(
        F.count_if(F.col("price_value").isNotNull()).alias("exact_prices"),
        F.count_if(F.col("comparable_status") == "COMPARABLE_CORE").alias("comparable_core"),
        F.count_if(F.col("comparable_status") == "INDETERMINATE").alias("indeterminate"),
    )


# --- product feed -------------------------------------------------------------------------------


def feed_offers(feeds: DataFrame) -> DataFrame:
    """Product feeds (feed_id, payload = JSON array) to offers: special price, else list price.

    Items that are no product, have no text name or no positive price are skipped; the first
    item per trimmed name and feed is kept.
    """
    parts = int(feeds.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fields = "id_producto VARIANT, nombre VARIANT, precioEspecial STRING, precioLista STRING"

    def read(item: Column) -> Column:
        return F.when(item.startswith("{"), F.from_json(item, fields))

    # An item is read once, in the generate; reading costs more than the bytes of a feed suggest,
    # so the feeds are dealt out first.
    items = (
        feeds.select("feed_id", "payload")
        .repartition(parts, "feed_id", "payload")
        .select(
            "feed_id",
            F.posexplode(F.transform(F.from_json("payload", "array<string>"), read)).alias("position", "_f"),
        )
    )

    def usable(name: str) -> Column:
        value = F.col(f"_f.{name}")
        number = value.try_cast("double")
        return F.when((value != "") & (number.isNull() | (number != 0)), value)

    raw = F.coalesce(usable("precioEspecial"), usable("precioLista"), F.lit("0"))
    named = F.col("_f.nombre")
    name = F.when(F.schema_of_variant(named) == "STRING", F.try_variant_get(named, "$", "string"))
    priced = (
        items.filter(F.col("_f.id_producto").isNotNull())  # JSON null counts as given
        .select("feed_id", "position", name.alias("_name"), raw.alias("price_raw"))
        .filter(F.col("_name") != "")
        .withColumn("price", F.col("price_raw").try_cast("double").try_cast("bigint"))
        .filter(F.col("price") > 0)
    )
    first = F.min(F.struct("position", "price_raw", "price"))
    return (
        priced.groupBy("feed_id", F.trim("_name").alias("service_raw"))
        .agg(first.alias("_first"))
        .select("feed_id", "_first.position", "service_raw", "_first.price_raw", "_first.price")
    )
