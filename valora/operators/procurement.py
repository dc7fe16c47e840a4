"""Purchase orders, notices and awards from raw JSON text.

A document is parsed once into string fields (nested values keep their JSON text), so raw
values survive untouched and missing ones become the literal UNKNOWN.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valora.functions.rules import once, settled

UNKNOWN = "UNKNOWN"
_EMPTY = ("", "[]", "{}")


def _fields(text: Column, names: Sequence[str]) -> Column:
    return F.from_json(text, ", ".join(f"`{n}` STRING" for n in names))


def present(value: Column) -> Column:
    """The raw value, NULL when it is null, '', [] or {}."""
    return F.when(~value.isin(*_EMPTY), value)


def pick(record: Column, *names: str, fallback: Column | None = None) -> Column:
    """First present field, else the fallback, else UNKNOWN."""
    last = F.lit(UNKNOWN) if fallback is None else fallback
    return F.coalesce(*[present(record[n]) for n in names], last)


def json_problem(text: Column) -> Column:
    """Why a text is not a JSON object; NULL when it is."""
    return F.when(F.try_parse_json(text).isNull(), F.lit("invalid raw JSON")).when(
        ~F.ltrim(text).startswith("{"), "raw content must be a JSON object"
    )


def _number(value: Column) -> Column:
    return F.when(value != UNKNOWN, value).try_cast("double")


def total_consistency(expected: Column, observed: Column) -> Column:
    """MATCH within one cent, MISMATCH, or NOT_EVALUABLE when a side is missing."""
    return (
        F.when(expected.isNull() | observed.isNull(), F.lit("NOT_EVALUABLE"))
        .when(F.abs(expected - observed) < 0.01, "MATCH")
        .otherwise("MISMATCH")
    )


# --- purchase orders --------------------------------------------------------------------------

_ORDER = (
    "Codigo",
    "Nombre",
    "Descripcion",
    "Estado",
    "CodigoEstado",
    "TipoMoneda",
    "Total",
    "Pais",
    "Fechas",
    "Comprador",
    "Proveedor",
    "Items",
)
_LINE = (
    "EspecificacionComprador",
    "Producto",
    "Descripcion",
    "Categoria",
    "CodigoCategoria",
    "CodigoProducto",
    "Cantidad",
    "Unidad",
    "PrecioNeto",
    "Total",
    "Moneda",
    "Correlativo",
    "Codigo",
    "Id",
)


def _line(item: Column, order_currency: Column) -> Column:
    """struct of one item's raw fields, status and consistency; its JSON is read once."""
    return once(_fields(item, _LINE), lambda rec: _line_fields(item, rec, order_currency))


def _line_fields(item: Column, rec: Column, order_currency: Column) -> Column:
    description = pick(rec, "EspecificacionComprador", "Producto", "Descripcion")
    category, quantity = pick(rec, "Categoria"), pick(rec, "Cantidad")
    net, total = pick(rec, "PrecioNeto"), pick(rec, "Total")
    nothing = F.lit(True)
    for value in (description, category, quantity, net, total):
        nothing = nothing & (value == UNKNOWN)
    reason = (
        F.when(~item.startswith("{"), F.lit("item must be a JSON object"))
        .when(item == "{}", "empty item")
        .when(nothing, "item without observable description/category/economics")
    )
    partial = F.lit(False)
    for value in (description, quantity, net, total):
        partial = partial | (value == UNKNOWN)
    return F.struct(
        reason.alias("reject_reason"),
        F.when(reason.isNotNull(), F.lit("REJECTED"))
        .when(partial, "PARTIAL")
        .otherwise("EXTRACTED")
        .alias("status"),
        description.alias("description_raw"),
        category.alias("category_raw"),
        pick(rec, "CodigoCategoria").alias("category_code_raw"),
        pick(rec, "CodigoProducto").alias("product_code_raw"),
        quantity.alias("quantity_raw"),
        pick(rec, "Unidad").alias("unit_raw"),
        net.alias("net_price_raw"),
        total.alias("total_raw"),
        pick(rec, "Moneda", fallback=order_currency).alias("currency_raw"),
        F.coalesce(*[present(rec[n]) for n in ("Correlativo", "Codigo", "Id", "CodigoProducto")]).alias(
            "stable_id"
        ),
        total_consistency(_number(quantity) * _number(net), _number(total)).alias("consistency"),
    )


def extract_orders(documents: DataFrame, version: str = "purchase_order_v1") -> DataFrame:
    """Orders with their parsed lines as an array column; bad documents keep a reason.

    Everything about one document stays in its row, so extraction needs no shuffle.
    Input: raw_document_id, source, source_url, raw_content.
    """
    df = documents.withColumn("_problem", json_problem(F.col("raw_content"))).withColumn(
        "_o", _fields(F.when(F.col("_problem").isNull(), F.col("raw_content")), _ORDER)
    )
    rec = F.col("_o")
    container = F.from_json(rec["Items"], "Cantidad STRING, Listado ARRAY<STRING>")
    df = df.withColumn("_items", container).withColumn("_currency", pick(rec, "TipoMoneda"))
    listed = F.coalesce(F.col("_items.Listado"), F.array().cast("array<string>"))
    df = df.withColumn("lines", F.transform(listed, lambda i: _line(F.coalesce(i, F.lit("null")), F.col("_currency"))))
    valid = F.filter("lines", lambda x: x["reject_reason"].isNull())
    rejected = F.filter("lines", lambda x: x["reject_reason"].isNotNull())
    df = df.withColumn("_valid", valid).withColumn("_rejected", rejected)
    no_line = F.size("_valid") == 0
    bad_total = F.exists("_valid", lambda x: _number(x["total_raw"]).isNull())
    line_sum = F.aggregate(
        "_valid", F.lit(0.0), lambda acc, x: acc + F.coalesce(_number(x["total_raw"]), F.lit(0.0))
    )
    total = pick(rec, "Total")
    core = [pick(rec, n) for n in ("Codigo", "Comprador", "Proveedor", "TipoMoneda", "Total")]
    any_missing = F.lit(False)
    for value in core:
        any_missing = any_missing | (value == UNKNOWN)
    reason = F.coalesce(
        F.col("_problem"),
        F.when(pick(rec, "Codigo") == UNKNOWN, F.lit("missing purchase order Codigo")),
    )
    partial = (F.size("_rejected") > 0) | no_line | any_missing
    buyer = _fields(rec["Comprador"], ("RegionUnidad", "ComunaUnidad"))
    supplier = _fields(rec["Proveedor"], ("Region", "Comuna"))
    extracted = df.select(
        "raw_document_id",
        "source",
        "source_url",
        F.lit(version).alias("extractor_version"),
        pick(rec, "Codigo").alias("source_record_id"),
        F.when(reason.isNotNull(), F.lit("REJECTED"))
        .when(partial, "PARTIAL")
        .otherwise("EXTRACTED")
        .alias("status"),
        reason.alias("reject_reason"),
        F.array_join(F.transform("_rejected", lambda x: x["reject_reason"]), "; ").alias(
            "line_reject_reasons"
        ),
        pick(rec, "Nombre").alias("name_raw"),
        pick(rec, "Descripcion", "Nombre").alias("description_raw"),
        pick(rec, "Comprador").alias("buyer_raw"),
        pick(rec, "Proveedor").alias("supplier_raw"),
        pick(rec, "Estado", "CodigoEstado").alias("status_raw"),
        pick(rec, "Fechas").alias("date_raw"),
        F.col("_currency").alias("currency_raw"),
        total.alias("order_total_raw"),
        pick(rec, "Pais").alias("country_raw"),
        pick(buyer, "RegionUnidad").alias("buyer_region_raw"),
        pick(buyer, "ComunaUnidad").alias("buyer_comuna_raw"),
        pick(supplier, "Region").alias("supplier_region_raw"),
        pick(supplier, "Comuna").alias("supplier_comuna_raw"),
        F.coalesce(F.col("_items.Cantidad"), F.size("lines").cast("string")).alias(
            "items_count_raw"
        ),
        F.size("lines").alias("items_seen"),
        F.size("_valid").alias("lines_extracted"),
        F.size("_rejected").alias("lines_rejected"),
        total_consistency(
            F.when(~no_line & ~bad_total, line_sum), _number(total)
        ).alias("lines_vs_total"),
        "lines",
    )
    # The lines too: exploding them infers a filter on their number, which else reads all JSON again.
    return settled(extracted, ("status", "reject_reason", "lines"))


def order_lines(orders: DataFrame) -> DataFrame:
    """One row per listed item of an accepted order; rejects keep their reason."""
    exploded = orders.filter(F.col("reject_reason").isNull()).select(
        "raw_document_id",
        "source",
        F.col("source_record_id").alias("order_id"),
        F.posexplode("lines").alias("line_index", "_line"),
    )
    return exploded.select(
        "raw_document_id",
        "source",
        "order_id",
        "line_index",
        F.concat("order_id", F.lit(":LINE:"), F.col("line_index").cast("string")).alias(
            "source_record_id"
        ),
        "_line.*",
    ).withColumn(
        "stable_id",
        F.coalesce("stable_id", F.concat(F.lit("INDEX:"), F.col("line_index").cast("string"))),
    )


def order_counters(orders: DataFrame, new: Column | None = None) -> DataFrame:
    """Batch counters from one aggregate over the extracted orders (no line shuffle).

    ``new`` marks orders that were not stored before.
    """
    fresh = F.lit(True) if new is None else new
    ok = F.col("reject_reason").isNull()
    partial_lines = F.size(F.filter("lines", lambda x: x["status"] == "PARTIAL"))

    def total(value: Column, test: Column) -> Column:
        return F.coalesce(F.sum(F.when(test, value).cast("bigint")), F.lit(0))

    return orders.agg(
        F.count(F.lit(1)).alias("orders_processed"),
        F.count_if(ok & fresh & (F.col("status") == "EXTRACTED")).alias("orders_extracted"),
        F.count_if(ok & fresh & (F.col("status") == "PARTIAL")).alias("orders_partial"),
        F.count_if(~ok).alias("orders_rejected"),
        F.count_if(ok & ~fresh).alias("duplicate"),
        total(F.col("items_seen"), ok).alias("items_seen"),
        total(F.col("lines_extracted"), ok & fresh).alias("items_extracted"),
        total(partial_lines, ok & fresh).alias("items_partial"),
        total(F.col("lines_rejected"), ok).alias("items_rejected"),
    )


# --- characterisation ----------------------------------------------------------------------------


def class_code(code: Column) -> Column:
    """Whole-number text of a classification code; blank is UNKNOWN."""
    text = F.coalesce(present(code.cast("string")), F.lit(UNKNOWN))
    return F.coalesce(
        text.try_cast("double").try_cast("bigint").cast("string"), F.trim(text)
    )


def technology_scope(code: Column) -> Column:
    """struct(status, reason) from the official classification only."""

    def verdict(status: str, reason: str) -> Column:
        return F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"))

    value = class_code(code)
    return (
        F.when(
            value.isin("", "0", UNKNOWN),
            verdict("UNKNOWN", "MISSING_OR_UNKNOWN_OFFICIAL_CLASSIFICATION"),
        )
        .when(
            value.startswith("43"), verdict("TECH_RELEVANT", "UNSPSC_43_IT_BROADCAST_TELECOM")
        )
        .when(
            value.startswith("8111"), verdict("TECH_RELEVANT", "UNSPSC_8111_COMPUTER_SERVICES")
        )
        .otherwise(verdict("NON_TECH", "UNSPSC_STRUCTURED_NON_TECH"))
    )


def category_prefix(code: Column) -> Column:
    text = code.cast("string")
    return F.when(text.isNull() | text.isin("", UNKNOWN), UNKNOWN).otherwise(
        F.substring(text, 1, 2)
    )


def _explained(status: str, reason: str, expected: Column, observed: Column, **more: Column):
    return F.struct(
        F.lit(status).alias("status"),
        F.lit(reason).alias("reason"),
        expected.cast("double").alias("expected"),
        observed.cast("double").alias("observed"),
        *[v.cast("double").alias(k) for k, v in more.items()],
    )


def explain_line(quantity: Column, net: Column, total: Column) -> Column:
    """Quantity x net price against the line total. Not evaluable hides a zero total."""
    q, p, t = (c.cast("string").try_cast("double") for c in (quantity, net, total))
    none = F.lit(None)
    expected = q * p
    return (
        F.when(
            q.isNull() | p.isNull() | t.isNull(),
            _explained(
                "NOT_EVALUABLE",
                "MISSING_OR_NON_NUMERIC_LINE_ECONOMICS",
                none,
                F.nullif(t, F.lit(0.0)),
            ),
        )
        .when(
            F.abs(expected - t) < 0.01,
            _explained("MATCH", "QUANTITY_X_NET_PRICE_MATCHES_LINE_TOTAL", expected, t),
        )
        .when(
            (t == 0) & (expected > 0),
            _explained(
                "MISMATCH", "LINE_TOTAL_ZERO_BUT_QUANTITY_X_NET_PRICE_POSITIVE", expected, t
            ),
        )
        .otherwise(
            _explained("MISMATCH", "LINE_TOTAL_DIFFERS_FROM_QUANTITY_X_NET_PRICE", expected, t)
        )
    )


def explain_order(
    total: Column, net: Column, tax: Column, charges: Column, discounts: Column, lines: Column
) -> Column:
    """Line sum against order total, else header net + tax + charges - discounts."""
    t, n, x, c, d, s = (
        v.cast("string").try_cast("double") for v in (total, net, tax, charges, discounts, lines)
    )
    zero, none = F.lit(0.0), F.lit(None)
    header = n + F.coalesce(x, zero) + F.coalesce(c, zero) - F.coalesce(d, zero)
    return (
        F.when(
            t.isNull() | s.isNull(),
            _explained(
                "NOT_EVALUABLE",
                "MISSING_OR_NON_NUMERIC_ORDER_TOTALS",
                none,
                F.nullif(t, zero),
                lines=F.nullif(s, zero),
            ),
        )
        .when(
            F.abs(s - t) < 0.01,
            _explained("MATCH", "SUM_LINE_TOTAL_MATCHES_ORDER_TOTAL", s, t, lines=s),
        )
        .when(
            F.coalesce(F.abs(header - t) < 0.01, F.lit(False)),
            _explained(
                "MISMATCH",
                "ORDER_TOTAL_MATCHES_HEADER_NET_TAX_CHARGES_DISCOUNTS_NOT_LINE_TOTALS",
                header,
                t,
                lines=s,
            ),
        )
        .otherwise(
            _explained("MISMATCH", "ORDER_TOTAL_DIFFERS_FROM_SUM_LINE_TOTAL", none, t, lines=s)
        )
    )


# --- notices ------------------------------------------------------------------------------------

# Value fields by meaning, strongest first, and general currency fields.
NOTICE_VALUES = (
    ("estimated_value", ("estimated-value-notice", "estimated-value-lot")),
    (
        "award_value",
        ("result-awarded-value-lot", "result-final-value-notice", "awarded-value"),
    ),
    ("contract_value", ("contract-value", "contract-value-notice")),
    ("framework_value", ("result-framework-maximum-value-cur-notice", "framework-value")),
)
NOTICE_CURRENCIES = (
    "currency",
    "value-currency",
    "estimated-value-notice-currency",
    "result-awarded-value-lot-currency",
    "result-final-value-notice-currency",
    "result-framework-maximum-value-cur-notice",
)
NOTICE_SUPPLIERS = (
    "tendering-party-name",
    "winner-name",
    "organisation-name-tenderer",
    "supplier-name",
)


def _entry(record: Column, *names: str) -> Column:
    return F.coalesce(*[present(F.try_element_at(record, F.lit(n))) for n in names])


def _currency(record: Column, value_names: Sequence[str]) -> Column:
    own = [k for n in value_names for k in (f"{n}-currency", n.replace("value", "value-cur"))]
    return F.coalesce(_entry(record, *own, *NOTICE_CURRENCIES), F.lit(UNKNOWN))


def extract_notices(documents: DataFrame, version: str = "notice_v1") -> DataFrame:
    """Typed notice rows from JSON text; value meaning by precedence, dynamic value fields kept."""
    problem = json_problem(F.col("raw_content"))
    df = documents.withColumn("_problem", problem).withColumn(
        "_m",
        F.from_json(
            F.when(F.col("_problem").isNull(), F.col("raw_content")), "map<string,string>"
        ),
    )
    rec = F.col("_m")

    def field(name: str) -> Column:
        has = F.coalesce(F.map_contains_key(rec, name), F.lit(False))
        return F.when(has, F.try_element_at(rec, F.lit(name))).otherwise(UNKNOWN)

    number = F.coalesce(_entry(rec, "publication-number", "id"), F.lit(UNKNOWN))
    value = F.coalesce(*[_entry(rec, *names) for _, names in NOTICE_VALUES], F.lit(UNKNOWN))
    meaning = F.coalesce(
        *[F.when(_entry(rec, *names).isNotNull(), F.lit(m)) for m, names in NOTICE_VALUES],
        F.lit("unknown_value_semantics"),
    )
    currency = F.coalesce(
        *[
            F.when(_entry(rec, *names).isNotNull(), _currency(rec, names))
            for _, names in NOTICE_VALUES
        ],
        _currency(rec, ()),
    )
    core = {
        "title_raw": field("notice-title"),
        "classification_raw": field("classification-cpv"),
        "buyer_raw": field("buyer-name"),
        "country_raw": field("buyer-country"),
        "published_at_raw": field("publication-date"),
    }
    reason = F.coalesce(
        F.col("_problem"), F.when(number == UNKNOWN, F.lit("missing publication number"))
    )
    incomplete = F.lit(False)
    for column in core.values():
        incomplete = incomplete | F.coalesce(column == UNKNOWN, F.lit(False))
    dynamic = F.map_filter(rec, lambda k, v: F.lower(k).rlike("value|currency|amount"))
    return df.select(
        "raw_document_id",
        "source",
        "source_url",
        F.lit(version).alias("extractor_version"),
        number.alias("source_record_id"),
        F.when(reason.isNotNull(), F.lit("REJECTED"))
        .when(incomplete, "PARTIAL")
        .otherwise("EXTRACTED")
        .alias("status"),
        reason.alias("reject_reason"),
        *[column.alias(name) for name, column in core.items()],
        field("description-lot").alias("description_raw"),
        F.coalesce(_entry(rec, *NOTICE_SUPPLIERS), F.lit(UNKNOWN)).alias("supplier_raw"),
        value.alias("value_raw"),
        currency.alias("currency_raw"),
        meaning.alias("value_semantics"),
        field("notice-type").alias("notice_type_raw"),
        field("procedure-type").alias("procedure_type_raw"),
        field("links").alias("links_raw"),
        F.to_json(dynamic).alias("value_fields_raw"),
    )


def extraction_counters(extracted: DataFrame, new: Column | None = None) -> DataFrame:
    """processed / extracted / partial / rejected / duplicate of notices or awards."""
    fresh = F.lit(True) if new is None else new
    ok = F.col("reject_reason").isNull()
    return extracted.agg(
        F.count(F.lit(1)).alias("processed"),
        F.count_if(ok & fresh & (F.col("status") != "PARTIAL")).alias("extracted"),
        F.count_if(ok & fresh & (F.col("status") == "PARTIAL")).alias("partial"),
        F.count_if(~ok).alias("rejected"),
        F.count_if(ok & ~fresh).alias("duplicate"),
    )


def display_text(value: Column) -> Column:
    """English entry of a multilingual JSON object, else its first language, else the text."""
    languages = F.from_json(F.when(value.startswith("{"), value), "map<string,string>")

    def head(text: Column) -> Column:
        listed = F.from_json(F.when(text.startswith("["), text), "array<string>")
        return F.when(text.startswith("["), F.try_element_at(listed, F.lit(1))).otherwise(
            F.when(~text.startswith("{"), text)
        )

    english = F.coalesce(
        present(F.try_element_at(languages, F.lit("eng"))),
        present(F.try_element_at(languages, F.lit("ENG"))),
    )
    others = F.array_compact(F.transform(F.map_values(languages), head))
    return F.coalesce(head(english), F.try_element_at(others, F.lit(1)), value)


# --- awards -------------------------------------------------------------------------------------

# Award fields (output name, JSON fields tried in order).
AWARD_FIELDS = (
    ("recipient_raw", ("Recipient Name",)),
    ("recipient_uei_raw", ("Recipient UEI",)),
    ("awarding_agency_raw", ("Awarding Agency",)),
    ("awarding_sub_agency_raw", ("Awarding Sub Agency",)),
    ("funding_agency_raw", ("Funding Agency",)),
    ("funding_sub_agency_raw", ("Funding Sub Agency",)),
    ("description_raw", ("Description", "Contract Description")),
    ("award_amount_raw", ("Award Amount",)),
    ("potential_award_amount_raw", ("Potential Award Amount",)),
    ("naics_raw", ("NAICS",)),
    ("psc_raw", ("PSC",)),
    ("award_type_raw", ("Contract Award Type",)),
    ("start_date_raw", ("Start Date",)),
    ("end_date_raw", ("End Date",)),
    ("award_date_raw", ("Award Date",)),
    ("performance_state_raw", ("Place of Performance State Code",)),
    ("performance_country_raw", ("Place of Performance Country Code",)),
    ("recipient_state_raw", ("Recipient State Code",)),
    ("recipient_country_raw", ("Recipient Country Code",)),
    ("recipient_location_raw", ("Recipient Location",)),
    ("award_id_raw", ("Award ID",)),
    ("internal_id_raw", ("internal_id",)),
)


def extract_awards(documents: DataFrame, version: str = "award_v1") -> DataFrame:
    """Award rows from JSON text; amounts are US dollars."""
    names = ["generated_internal_id", "internal_id"]
    names += [n for _, sources in AWARD_FIELDS for n in sources if n not in names]
    df = documents.withColumn("_problem", json_problem(F.col("raw_content"))).withColumn(
        "_a", _fields(F.when(F.col("_problem").isNull(), F.col("raw_content")), names)
    )
    rec = F.col("_a")
    identity = pick(rec, "generated_internal_id", "internal_id")
    reason = F.coalesce(
        F.col("_problem"), F.when(identity == UNKNOWN, F.lit("missing stable award identity"))
    )
    return df.select(
        "raw_document_id",
        "source",
        "source_url",
        F.lit(version).alias("extractor_version"),
        identity.alias("source_record_id"),
        F.when(reason.isNull(), F.lit("EXTRACTED")).otherwise("REJECTED").alias("status"),
        reason.alias("reject_reason"),
        F.lit("USD").alias("currency_raw"),
        *[pick(rec, *sources).alias(name) for name, sources in AWARD_FIELDS],
    )


# --- awards and calls ---------------------------------------------------------------------------


def match_calls(awards: DataFrame, calls: DataFrame, on: str) -> DataFrame:
    """Flag awards whose process has a call. Calls are reduced to distinct keys first."""
    keys = calls.select(on).distinct().withColumn("_call", F.lit(True))
    return awards.join(keys, on, "left").withColumn("has_call", F.col("_call").isNotNull()).drop("_call")


def call_coverage(awards: DataFrame, calls: DataFrame, on: str) -> DataFrame:
    """Awards, awards with a call and distinct processes."""
    return match_calls(awards, calls, on).agg(
        F.count(F.lit(1)).alias("awards"),
        F.count_if("has_call").alias("matched"),
        F.count_distinct(on).alias("processes"),
    )


def resource_type(name: Column) -> Column:
    low = F.lower(name)
    return (
        F.when(low.contains("adjudic"), F.lit("adjudicaciones"))
        .when(low.contains("convocatoria"), "convocatorias")
        .when(low.contains("sipro") | low.contains("proveedor"), "sipro")
        .when(
            low.contains("sibys") | low.contains("cat?logo") | low.contains("catalogo"), "sibys"
        )
        .otherwise("other")
    )


def value_class(kind: Column, name: Column) -> Column:
    low = F.lower(name)
    return (
        F.when((kind == "adjudicaciones") & low.contains("2016 - 2026"), F.lit("P0_ECONOMIC"))
        .when((kind == "convocatorias") & low.contains("2016 - 2026"), "P1_MARKET_ACTIVITY")
        .when((kind == "sipro") & low.contains("2016-2026"), "P1_SUPPLIER_INTELLIGENCE")
        .when(kind == "sibys", "P1_TAXONOMY")
        .otherwise("P2_HISTORICAL")
    )
