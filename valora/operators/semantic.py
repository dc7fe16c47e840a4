"""Semantic classification of observations and their typed meanings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valora.functions import lexicon as lx
from valora.functions.price import number_key
from valora.functions.rules import all_labels, capture, first_label, once, text_or_empty
from valora.functions.text import fold, without_badges

SEMANTIC_COLUMNS = (
    "observation_id",
    "source",
    "province",
    "city",
    "economic_object_raw",
    "price_value",
    "currency",
    "semantic_role",
    "market_scope",
    "matched_services",
    "canonical_service",
    "comparability_key",
    "original_comparable_status",
    "extractor_version",
)
_CLASS_COLUMNS = (
    "semantic_role",
    "market_scope",
    "matched_services",
    "canonical_service",
    "comparability_key",
)


def classify_observations(
    df: DataFrame, text: str = "economic_object_raw", province: str = "province"
) -> DataFrame:
    """Conservative class of a new observation: goods and composites never get a cohort key."""
    clean = F.col("_clean")
    signals = sum((clean.rlike(p).cast("int") for p in lx.HARDWARE_SIGNALS), F.lit(0))
    staged = df.withColumn("_clean", without_badges(F.col(text))).withColumn("_signals", signals)
    kind = (
        F.when(F.col("_signals") >= 2, "GOODS")
        .when(clean.rlike(lx.OS_INSTALL), "FORMATEO_INSTALACION_SO")
        .when(
            clean.rlike(lx.COMPUTER) & clean.rlike(lx.NO_BOOT) & ~clean.rlike(lx.NO_POWER),
            "REPARACION_INICIO_WINDOWS",
        )
        .when(clean.rlike(lx.DISK_CHANGE) & clean.rlike(lx.CLONING), "COMPOSITE")
        .otherwise("NONE")
    )
    staged = staged.withColumn("_kind", kind)
    service = F.when(~F.col("_kind").isin("GOODS", "COMPOSITE", "NONE"), F.col("_kind"))
    has_key = service.isNotNull() & (F.coalesce(F.col(province), F.lit("")) != "")

    def by_kind(single, goods, composite, other):
        return (
            F.when(service.isNotNull(), single)
            .when(F.col("_kind") == "GOODS", goods)
            .when(F.col("_kind") == "COMPOSITE", composite)
            .otherwise(other)
        )

    return staged.withColumns(
        {
            "semantic_role": by_kind(
                F.lit("SINGLE_SERVICE"), "HARDWARE_PRODUCT", "COMPOSITE_SERVICE", "UNMAPPED"
            ),
            "market_scope": by_kind(
                F.lit("LOCAL_SERVICE"), "GOODS_MARKET", "MIXED_OR_UNKNOWN", "UNKNOWN"
            ),
            "matched_services": by_kind(service, "", "REPARACION_HW|BACKUP_DATOS", ""),
            "canonical_service": F.coalesce(service, F.lit("")),
            "comparability_key": F.when(
                has_key, F.concat_ws("::", F.col(province), service)
            ).otherwise(""),
        }
    ).drop("_clean", "_signals", "_kind")


def _frozen_last(baseline: DataFrame, order: str) -> DataFrame:
    """Baseline with its join key, last row per key."""
    keyed = baseline.withColumns(
        {
            "_k_source": text_or_empty(F.col("source")),
            "_k_object": text_or_empty(F.col("economic_object_raw")),
            "_k_price": text_or_empty(F.col("price_value")),
            "_k_currency": text_or_empty(F.col("currency")),
        }
    )
    keys = ["_k_source", "_k_object", "_k_price", "_k_currency"]
    last = keyed.groupBy(*keys).agg(F.max(order).alias(order))
    return keyed.join(last, [*keys, order], "left_semi")


def extend_baseline(
    observations: DataFrame, raw_documents: DataFrame, baseline: DataFrame, order: str
) -> DataFrame:
    """Reuse the frozen row with the same source, object, price text and currency, else classify.

    A reused row keeps everything but its observation id. ``reused`` tells the two apart.
    """
    live = (
        observations.join(
            raw_documents.select("raw_document_id", "province", "city"), "raw_document_id"
        )
        .withColumns(
            {
                "observation_id": F.col("observation_id").cast("string"),
                "economic_object_raw": F.coalesce("economic_object_raw", F.lit("")),
                "price_value": number_key(F.col("price_value")),
                "currency": F.coalesce("currency", F.lit("")),
                "province": F.coalesce("province", F.lit("")),
                "city": F.coalesce("city", F.lit("")),
            }
        )
        .withColumns(
            {
                "_k_source": F.trim("source"),
                "_k_object": F.trim("economic_object_raw"),
                "_k_price": F.col("price_value"),
                "_k_currency": F.trim("currency"),
            }
        )
    )
    keys = ["_k_source", "_k_object", "_k_price", "_k_currency"]
    frozen = _frozen_last(baseline, order)
    kept = [c for c in SEMANTIC_COLUMNS if c != "observation_id"]
    frozen = frozen.select(*keys, *[F.col(c).alias(f"_f_{c}") for c in kept], F.lit(True).alias("_hit"))
    joined = classify_observations(live.withColumnRenamed("comparable_status", "original_comparable_status")).join(
        frozen, keys, "left"
    )
    hit = F.col("_hit").isNotNull()
    return joined.select(
        "observation_id",
        *[
            F.when(hit, F.coalesce(F.col(f"_f_{c}"), F.lit(""))).otherwise(F.col(c)).alias(c)
            for c in kept
        ],
        hit.alias("reused"),
    ).select(*SEMANTIC_COLUMNS, "reused")


def export_counts(rows: DataFrame) -> DataFrame:
    """Rows per role, market and (non-empty) canonical service from one scan."""
    grouped = rows.groupingSets(
        [["semantic_role"], ["market_scope"], ["canonical_service"]],
        "semantic_role",
        "market_scope",
        "canonical_service",
    ).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_g"))
    kind = F.when(F.col("_g") == 3, "semantic_role").when(F.col("_g") == 5, "market_scope")
    return (
        grouped.withColumn("dimension", kind.otherwise("canonical_service"))
        .withColumn("label", F.coalesce("semantic_role", "market_scope", "canonical_service"))
        .filter((F.col("dimension") != "canonical_service") | (F.col("label") != ""))
        .select("dimension", "label", "n")
    )


# --- typed meanings of a folded text -------------------------------------------------------------


def price_context(folded: Column, published_currency: Column | None = None) -> Column:
    percent = F.replace(capture(folded, r"\b(\d+(?:[,.]\d+)?)\s*%", 1), F.lit(","), F.lit("."))
    published = F.lit(None).cast("string") if published_currency is None else published_currency
    return F.struct(
        first_label(folded, lx.PRICE_CONTEXT_KINDS, "UNKNOWN").alias("kind"),
        first_label(folded, lx.PRICE_CONTEXT_CADENCE, "UNKNOWN").alias("price_scope"),
        F.coalesce(F.nullif(text_or_empty(published), F.lit("")), F.lit("UNKNOWN")).alias(
            "published_currency"
        ),
        all_labels(folded, lx.CURRENCY_MARKERS).alias("currency_markers"),
        percent.try_cast("double").alias("percent"),
        F.when(folded.rlike(r"\bequipos?\b"), "EQUIPMENT_COUNT").alias("quantity_unit"),
    )


def scope_meaning(folded: Column) -> Column:
    """Capacity band, else delivery modes, else device profile, else tier."""
    amount = F.replace(capture(folded, lx.CAPACITY_BAND, 1), F.lit(","), F.lit("."))
    middle = F.when(folded.rlike(lx.MID_HIGH_TIER), F.array(F.lit("MID_HIGH"))).when(
        folded.rlike(lx.MID_TIER), F.array(F.lit("MID"))
    )
    none = F.array().cast("array<string>")
    found = F.struct(
        amount.try_cast("double").alias("capacity"),
        all_labels(folded, lx.DELIVERY_MODES).alias("modes"),
        all_labels(folded, lx.SCOPE_DEVICES).alias("devices"),
        F.concat(F.coalesce(middle, none), all_labels(folded, lx.SCOPE_TIERS)).alias("tiers"),
    )
    return once(found, lambda f: _scope_of(folded, f))


def _scope_of(folded: Column, found: Column) -> Column:
    none = F.array().cast("array<string>")
    capacity, modes = found["capacity"], found["modes"]
    devices, tiers = found["devices"], found["tiers"]
    is_band = capacity.isNotNull()
    is_mode = ~is_band & (F.size(modes) > 0)
    is_object = ~is_band & ~is_mode
    kind = (
        F.when(is_band, F.lit("DATA_CAPACITY_BAND"))
        .when(is_mode, "PROVIDER_DELIVERY_CONTEXT")
        .when(F.size(devices) > 0, "DEVICE_PROFILE")
        .when(F.size(tiers) > 0, "TIER_ONLY")
        .otherwise("UNKNOWN")
    )
    return F.struct(
        kind.alias("kind"),
        F.when(is_object, devices).otherwise(none).alias("device_types"),
        F.when(is_object, tiers).otherwise(none).alias("tiers"),
        capacity.alias("capacity_max_value"),
        F.when(is_band, F.upper(F.regexp_extract(folded, lx.CAPACITY_BAND, 2))).alias(
            "capacity_unit"
        ),
        F.when(is_mode, modes).otherwise(none).alias("delivery_modes"),
    )


def hardware_meaning(folded: Column) -> Column:
    return once(
        all_labels(folded, lx.HARDWARE_FAMILIES), lambda found: _hardware_of(folded, found)
    )


def _hardware_of(folded: Column, families: Column) -> Column:
    brands = all_labels(folded, [(b, (rf"\b{b.lower()}\b",)) for b in lx.HARDWARE_BRANDS])
    specs = [F.regexp_extract_all(folded, F.lit(p), F.lit(0)) for p in lx.HARDWARE_SPECS]
    kind = (
        F.when(folded.rlike(lx.SERVICE_VERBS), F.lit("SERVICE_LIKE_CONFLICT"))
        .when(F.size(families) == 1, "SINGLE_COMPONENT_FAMILY")
        .when(F.size(families) >= 2, "MULTI_COMPONENT_SYSTEM")
        .otherwise("UNKNOWN")
    )
    return F.struct(
        kind.alias("kind"),
        families.alias("families"),
        brands.alias("brands"),
        all_labels(folded, lx.HARDWARE_VARIANTS).alias("variants"),
        F.array_distinct(F.transform(F.concat(*specs), F.upper)).alias("specs"),
    )


def non_object_meaning(folded: Column) -> Column:
    def meaning(kind: str, signals: tuple[str, ...]) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"),
            F.array(*[F.lit(s) for s in signals]).cast("array<string>").alias("signals"),
        )

    cases = [F.when(folded.rlike(p), meaning(k, s)) for k, p, s in lx.NON_OBJECT_KINDS]
    marketing = folded.rlike(lx.SERVICE_LANGUAGE) & folded.rlike(lx.MARKETING_LANGUAGE)
    cases.append(
        F.when(
            marketing,
            meaning("MARKETING_SERVICE_COPY", ("SERVICE_LANGUAGE", "MARKETING_LANGUAGE")),
        )
    )
    return F.coalesce(*cases, meaning("UNKNOWN", ()))


def logistics_meaning(folded: Column) -> Column:
    rules = {
        "channels": lx.LOGISTICS_CHANNELS,
        "destinations": lx.LOGISTICS_DESTINATIONS,
        "carriers": lx.LOGISTICS_CARRIERS,
        "coverage": lx.LOGISTICS_COVERAGE,
    }
    found = F.struct(*[all_labels(folded, table).alias(name) for name, table in rules.items()])
    return once(found, _logistics_of)


def _logistics_of(found: Column) -> Column:
    channels, destinations = found["channels"], found["destinations"]
    carriers, coverage = found["carriers"], found["coverage"]
    branch = F.array_contains(destinations, "BRANCH")
    kind = (
        F.when(
            F.array_contains(channels, "MOTORBIKE_COURIER") & (F.size(coverage) > 0),
            F.lit("LOCAL_COURIER_DELIVERY"),
        )
        .when(F.array_contains(destinations, "HOME"), "HOME_DELIVERY")
        .when(branch & F.array_contains(channels, "DELIVERY"), "BRANCH_DELIVERY")
        .when(branch | F.array_contains(destinations, "PICKUP_POINT"), "PICKUP_POINT")
        .otherwise("UNKNOWN")
    )
    return F.struct(
        kind.alias("kind"),
        channels.alias("channels"),
        destinations.alias("destinations"),
        carriers.alias("carriers"),
        coverage.alias("coverage"),
    )


# --- understanding status ----------------------------------------------------------------------


def price_context_status(meaning: Column) -> Column:
    no_scope = meaning["price_scope"] == "UNKNOWN"
    return (
        F.when((meaning["kind"] == "UNKNOWN") & no_scope, F.lit("PRICE_CONTEXT_UNKNOWN"))
        .when(no_scope, "PRICE_CONTEXT_PARTIAL")
        .otherwise("PRICE_CONTEXT_UNDERSTOOD")
    )


def scope_status(meaning: Column) -> Column:
    kind = meaning["kind"]
    full = (
        F.when(kind == "DEVICE_PROFILE", F.size(meaning["device_types"]) > 0)
        .when(kind == "TIER_ONLY", F.size(meaning["tiers"]) > 0)
        .when(
            kind == "DATA_CAPACITY_BAND",
            meaning["capacity_max_value"].isNotNull() & meaning["capacity_unit"].isNotNull(),
        )
        .when(kind == "PROVIDER_DELIVERY_CONTEXT", F.size(meaning["delivery_modes"]) > 0)
        .otherwise(False)
    )
    return (
        F.when(kind == "UNKNOWN", F.lit("SCOPE_UNKNOWN"))
        .when(full, "SCOPE_UNDERSTOOD")
        .otherwise("SCOPE_PARTIAL")
    )


def hardware_status(meaning: Column) -> Column:
    kind, n = meaning["kind"], F.size(meaning["families"])
    full = ((kind == "SINGLE_COMPONENT_FAMILY") & (n == 1)) | (
        (kind == "MULTI_COMPONENT_SYSTEM") & (n >= 2)
    )
    return (
        F.when(kind == "UNKNOWN", F.lit("HARDWARE_UNKNOWN"))
        .when(kind == "SERVICE_LIKE_CONFLICT", "HARDWARE_AMBIGUOUS")
        .when(full, "HARDWARE_UNDERSTOOD")
        .otherwise("HARDWARE_PARTIAL")
    )


def non_object_status(meaning: Column) -> Column:
    return F.when(meaning["kind"] == "UNKNOWN", F.lit("NON_OBJECT_UNKNOWN")).otherwise(
        "NON_OBJECT_UNDERSTOOD"
    )


def logistics_status(meaning: Column) -> Column:
    seen = sum(
        (F.size(meaning[f]) for f in ("channels", "destinations", "carriers", "coverage")),
        F.lit(0),
    )
    return (
        F.when(meaning["kind"] == "UNKNOWN", F.lit("LOGISTICS_UNKNOWN"))
        .when(seen > 0, "LOGISTICS_UNDERSTOOD")
        .otherwise("LOGISTICS_PARTIAL")
    )


def role_status(role: Column, canonical: Column, matched: Column) -> Column:
    """Status an observation has from its role alone (``matched`` is an array)."""
    return (
        F.when(role == "UNMAPPED", F.lit("UNKNOWN"))
        .when(
            role == "SINGLE_SERVICE",
            F.when(canonical.isNotNull(), "FULLY_REPRESENTED").otherwise("AMBIGUOUS"),
        )
        .when(
            (role == "COMPOSITE_SERVICE") & (F.size(matched) > 0), "PARTIALLY_UNDERSTOOD"
        )
        .otherwise("CLASSIFIED_ONLY")
    )


def rolled_up_status(typed: Column) -> Column:
    """Typed status to observation status."""
    return (
        F.when(typed.contains("AMBIGUOUS"), F.lit("AMBIGUOUS"))
        .when(typed.contains("UNKNOWN"), "UNKNOWN")
        .when(typed.contains("UNDERSTOOD") | typed.contains("PARTIAL"), "PARTIALLY_UNDERSTOOD")
        .otherwise("UNREPRESENTED")
    )


# --- rows to observations to understanding ---------------------------------------------------------


def semantic_observations(
    rows: DataFrame, reference: str | None = None, version: str | None = None
) -> DataFrame:
    """Validated observations; invalid rows stay, with ``reject_reason``.

    Optional input columns: provider, source_url.
    """
    clean = {
        c: text_or_empty(F.col(c))
        for c in (
            "observation_id",
            "source",
            "economic_object_raw",
            "semantic_role",
            "market_scope",
            "canonical_service",
            "province",
            "extractor_version",
        )
    }
    for optional in ("provider", "source_url"):
        clean[optional] = (
            text_or_empty(F.col(optional)) if optional in rows.columns else F.lit("")
        )
    services = F.filter(
        F.transform(F.split(F.coalesce("matched_services", F.lit("")), r"\|"), F.trim),
        lambda s: s != "",
    )
    df = rows.withColumns({**clean, "matched": services})
    role = F.col("semantic_role")

    def missing(name: str) -> Column:
        return F.when(F.col(name) == "", F.lit(f"Missing required field: {name}"))

    unknown_role = F.when(
        ~role.isin(*lx.ROLES),
        F.concat(
            F.lit("Unknown semantic_role for observation_id="),
            F.col("observation_id"),
            F.lit(": "),
            role,
        ),
    )
    illegal = F.when(
        (F.col("canonical_service") != "") & (role != "SINGLE_SERVICE"),
        F.lit("Only SINGLE_SERVICE observations may carry canonical_service."),
    )
    origin = F.concat(
        F.lit("source="), F.col("source"), F.lit(";observation_id="), F.col("observation_id")
    )
    with_url = F.when(
        F.col("source_url") != "", F.concat(origin, F.lit(";url="), F.col("source_url"))
    ).otherwise(origin)
    return df.withColumns(
        {
            "reject_reason": F.coalesce(
                missing("semantic_role"),
                unknown_role,
                missing("observation_id"),
                missing("economic_object_raw"),
                missing("source"),
                illegal,
            ),
            "provider": F.coalesce(F.nullif("provider", F.lit("")), F.col("source")),
            "market_scope": F.coalesce(F.nullif("market_scope", F.lit("")), F.lit("UNKNOWN")),
            "province": F.nullif("province", F.lit("")),
            "canonical_service": F.nullif("canonical_service", F.lit("")),
            "observation_origin": with_url,
            "observation_origin_version": F.nullif("extractor_version", F.lit("")),
            "interpretation_origin": F.lit(reference or "UNKNOWN_INTERPRETATION_PROVENANCE"),
            "interpretation_version": F.lit(version).cast("string"),
        }
    )


_TYPED = (
    ("PRICE_CONTEXT", "PriceContextMeaning", price_context, price_context_status),
    ("SCOPE_DEVICE", "ScopeMeaning", scope_meaning, scope_status),
    ("HARDWARE_PRODUCT", "HardwareMeaning", hardware_meaning, hardware_status),
    ("NON_OBJECT", "NonObjectMeaning", non_object_meaning, non_object_status),
    ("LOGISTICS_CONTEXT", "LogisticsMeaning", logistics_meaning, logistics_status),
)


def understand(observations: DataFrame) -> DataFrame:
    """Dispatch each valid observation to its typed meaning and roll the status up."""
    role = F.col("semantic_role")
    df = observations.filter(F.col("reject_reason").isNull()).withColumn(
        "_folded", fold(F.col("economic_object_raw"))
    )
    # A typed meaning is evaluated only for rows of its role.
    df = df.withColumns(
        {f"_m{i}": F.when(role == r, build(F.col("_folded"))) for i, (r, _, build, _) in enumerate(_TYPED)}
    )
    typed = F.coalesce(*[F.when(role == r, st(F.col(f"_m{i}"))) for i, (r, _, _, st) in enumerate(_TYPED)])
    name = F.coalesce(*[F.when(role == r, F.lit(n)) for r, n, _, _ in _TYPED], F.lit(""))
    body = F.coalesce(
        *[F.when(role == r, F.to_json(F.col(f"_m{i}"))) for i, (r, _, _, _) in enumerate(_TYPED)],
        F.lit(""),
    )
    plain = role_status(role, F.col("canonical_service"), F.col("matched"))
    return df.withColumns(
        {
            "typed_status": typed,
            "understanding_status": F.when(typed.isNull(), plain).otherwise(
                rolled_up_status(typed)
            ),
            "meaning_type": name,
            "meaning_json": body,
        }
    ).drop("_folded", *[f"_m{i}" for i in range(len(_TYPED))])


def cohort_contract(text: Column) -> Column:
    """OS-install offers comparable as a core cohort: explicitly without backup, nothing extra."""
    plain = F.lower(F.coalesce(text, F.lit("")))
    core = (
        plain.contains("sistema operativo")
        & plain.rlike(r"sin\s+backup")
        & ~plain.rlike(r"limpieza|hardware|ssd|programas")
    )
    return F.when(core, F.lit("COMPARABLE_CORE")).otherwise("INDETERMINATE")


