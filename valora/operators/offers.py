"""Offer rows: normalise, fan out by modality, reject with a reason, summarise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valora.functions.price import MOST_DIGITS, literal_price, literal_reject_reason
from valora.functions.rules import by_distinct, settled
from valora.functions.text import catalog_service, city_name, company_name, province_name

OFFER_IDENTITY = (
    "company",
    "source",
    "province",
    "city",
    "service_identity",
    "price_identity",
    "currency",
    "period",
    "observed_on",
    "modality",
)


def normalize_offers(dto: DataFrame) -> DataFrame:
    """Canonical company and place next to the raw values.

    Names repeat in very many rows, so each distinct one is repaired once.
    """
    return by_distinct(
        dto,
        ("company_raw", "province_raw", "city_raw"),
        {
            "company": company_name(F.col("company_raw")),
            "province": province_name(F.col("province_raw")),
            "city": city_name(F.col("city_raw")),
        },
    )


def _present(raw: Column) -> Column:
    return F.coalesce(raw != "", F.lit(False))


def fan_out_modalities(offers: DataFrame) -> DataFrame:
    """One row per priced modality; a row without modality prices keeps its plain price."""
    priced = [
        F.struct(F.lit(name).alias("modality"), F.col(f"price_{name}_raw").alias("modality_raw"))
        for name in ("freelance", "local")
    ]
    kept = F.filter(F.array(*priced), lambda p: _present(p["modality_raw"]))
    plain = F.array(
        F.struct(
            F.lit(None).cast("string").alias("modality"),
            F.lit(None).cast("string").alias("modality_raw"),
        )
    )
    cells = F.when(F.size(kept) > 0, kept).otherwise(plain)
    return offers.select("*", F.inline(cells))


def _quoted(raw: Column) -> Column:
    return F.coalesce(F.concat(F.lit("'"), raw, F.lit("'")), F.lit("None"))


def offer_reject_reason(literal_reason: Column) -> Column:
    """Reason text for a fanned-out row; NULL when it becomes an offer or is skipped.

    ``literal_reason`` is the guard's verdict on the row's own literal.
    """
    raw, modality, price = F.col("price_raw"), F.col("modality_raw"), F.col("price")
    by_modality = F.concat(
        literal_reason,
        F.lit(": modalidad="),
        F.col("modality"),
        F.lit(", precio_raw="),
        _quoted(modality),
    )
    plain = F.concat(literal_reason, F.lit(": precio_raw="), _quoted(raw))
    not_positive = F.concat(F.lit("PRECIO_NO_REPRESENTABLE: precio="), price.cast("string"))
    has_price = F.coalesce(price > 0, F.lit(False))
    return (
        F.when(F.col("modality").isNotNull(), by_modality)
        .when(has_price & ~_present(raw), F.lit(None).cast("string"))
        .when(has_price, plain)
        .otherwise(F.coalesce(plain, F.when(price <= 0, not_positive)))
    )


def build_offers(dto: DataFrame) -> DataFrame:
    """Every input row to offers and rejects, told apart by ``outcome``.

    Explicit price wins over the parsed literal; the currency comes from the price used.
    """
    literal = F.when(F.col("modality").isNotNull(), F.col("modality_raw")).otherwise(
        F.col("price_raw")
    )
    parsed = F.col("_parsed")
    explicit = F.col("modality").isNull() & F.col("price").isNotNull()
    rows = (
        fan_out_modalities(
            by_distinct(
                normalize_offers(dto),
                ("service_raw",),
                {"service": catalog_service(F.col("service_raw"))},
            )
        )
        .withColumn("price_literal", literal)
        .withColumn("_reason", literal_reject_reason(F.col("price_literal")))
        .withColumn("_parsed", literal_price(F.col("price_literal"), F.col("_reason")))
        .withColumns(
            {
                "reject_reason": offer_reject_reason(F.col("_reason")),
                "price_value": F.when(explicit, F.col("price")).otherwise(parsed["value"]),
                "price_currency": F.when(explicit, F.col("currency")).otherwise(
                    parsed["currency"]
                ),
                "period": F.when(~explicit, parsed["period"]),
            }
        )
    )
    outcome = (
        F.when(~_present(F.col("service_raw")), F.lit("SKIPPED"))
        .when(F.col("reject_reason").isNotNull(), "REJECTED")
        .when(F.coalesce(F.col("price_value") > 0, F.lit(False)), "OFFER")
        .otherwise("SKIPPED")
    )
    built = rows.withColumn("outcome", outcome).select(
        "company",
        "province",
        "city",
        "source",
        "service",
        "service_raw",
        "price_value",
        F.col("price_currency").alias("currency"),
        "period",
        "modality",
        F.col("price_literal").alias("price_raw"),
        "observed_on",
        "outcome",
        F.when(F.col("outcome") == "REJECTED", F.col("reject_reason")).alias("reject_reason"),
        *[c for c in ("offer_id", "row_id") if c in dto.columns],
    )
    return settled(built, ("outcome", "reject_reason"))


def offers_only(built: DataFrame) -> DataFrame:
    return built.filter(F.col("outcome") == "OFFER").drop("outcome", "reject_reason")


def rejects_only(built: DataFrame) -> DataFrame:
    return built.filter(F.col("outcome") == "REJECTED").select(
        "source", F.col("reject_reason").alias("reason")
    )


def with_identity(offers: DataFrame) -> DataFrame:
    """Columns of the idempotency key: raw text replaces the canonical value when present."""
    return offers.withColumns(
        {
            "service_identity": F.coalesce(F.nullif("service_raw", F.lit("")), F.col("service")),
            "price_identity": F.coalesce(
                F.nullif("price_raw", F.lit("")), F.col("price_value").cast("string")
            ),
        }
    )


def price_list_rows(rows: DataFrame) -> DataFrame:
    """Rows of a two-price list: no service or no positive price is a reject."""

    def number(raw: str) -> Column:
        digits = F.regexp_replace(F.coalesce(F.col(raw), F.lit("")), r"\D", "")
        return F.coalesce(F.nullif(digits, F.lit("")).try_cast("bigint"), F.lit(0))

    def too_long(raw: str) -> Column:
        digits = F.regexp_replace(F.coalesce(F.col(raw), F.lit("")), r"\D|^0+", "")
        return F.length(digits) > MOST_DIGITS

    freelance, local = number("price_freelance_raw"), number("price_local_raw")
    no_service = F.coalesce(F.trim("service_raw"), F.lit("")) == ""
    reason = F.when(no_service, F.lit("sin servicio")).when(
        too_long("price_freelance_raw") | too_long("price_local_raw"), "precio fuera de rango"
    ).when((freelance <= 0) & (local <= 0), "sin ningún precio válido")
    price = F.when(freelance > 0, freelance).otherwise(local)
    return rows.withColumn("reject_reason", reason).withColumn(
        "price", F.when(F.col("reject_reason").isNull(), price)
    )


# --- summaries ---------------------------------------------------------------------------------


def _one_off_price() -> Column:
    return F.when(F.col("period").isNull() & (F.col("price_value") > 0), F.col("price_value"))


def _one_off_columns() -> list[Column]:
    price = _one_off_price()
    zero = F.lit(0.0)
    return [
        F.coalesce(F.avg(price), zero).alias("avg_price"),
        F.coalesce(F.min(price).cast("double"), zero).alias("min_price"),
        F.coalesce(F.max(price).cast("double"), zero).alias("max_price"),
    ]


def one_off_statistics(offers: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Average, minimum and maximum over one-off positive prices; 0.0 when there are none."""
    return offers.groupBy(*keys).agg(*_one_off_columns())


def service_summary(offers: DataFrame, keys: Sequence[str] = ("service",)) -> DataFrame:
    """Count of all offers, one-off price statistics and distinct companies (whole record)."""
    return offers.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("offers_n"),
        F.count_distinct(F.struct("company", "province", "city", "source")).alias("companies_n"),
        *_one_off_columns(),
    )


def company_prices(offers: DataFrame) -> DataFrame:
    """Price list of each company per service, one row per price."""
    return offers.select("service", "company", "modality", "price_value", "currency", "period")


def _service_hits(
    offers: DataFrame, service: str, province: str | None, city: str | None
) -> DataFrame:
    hits = offers.filter(F.col("service") == catalog_service(F.lit(service)))
    for column, wanted in (("province", province), ("city", city)):
        if wanted:
            hits = hits.filter(F.lower(F.coalesce(F.col(column), F.lit(""))) == wanted.lower())
    return hits


def lookup_service(
    offers: DataFrame, service: str, province: str | None = None, city: str | None = None
) -> DataFrame:
    """One-row answer for a service text, with the sorted places that offer it."""
    hits = _service_hits(offers, service, province, city)
    return place_summary(hits, ()).withColumn("requested", F.lit(service))


def place_summary(offers: DataFrame, keys: Sequence[str] = ("service",)) -> DataFrame:
    """Service summary plus sorted distinct cities and provinces; NULL prices when empty."""
    price = _one_off_price()

    def places(column: str) -> Column:
        return F.array_sort(F.collect_set(F.nullif(column, F.lit(""))))

    def or_zero(stat: Column) -> Column:
        return F.when(F.count(F.lit(1)) > 0, F.coalesce(stat.cast("double"), F.lit(0.0)))

    return offers.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("offers_n"),
        or_zero(F.min(price)).alias("min_price"),
        or_zero(F.avg(price)).alias("avg_price"),
        or_zero(F.max(price)).alias("max_price"),
        F.count_distinct(F.struct("company", "province", "city", "source")).alias("companies_n"),
        places("city").alias("cities"),
        places("province").alias("provinces"),
    )


def service_companies(
    offers: DataFrame, service: str, province: str | None = None, city: str | None = None
) -> DataFrame:
    """The companies behind a service answer, with each of their prices, one row each."""
    return _service_hits(offers, service, province, city).select(
        "service", "company", "province", "city", "source", "modality", "price_value", "currency", "period"
    )
