"""Technical needs to priced routes, and whole questions to decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valora.functions import question_lexicon as q
from valora.functions.price import commercial_context, question_cadence
from valora.functions.rules import lookup, settled
from valora.functions.text import fold
from valora.operators.cohorts import COHORT_KEYS, LOCAL, REMOTE
from valora.operators.decisions import evaluate_prices

_PRICED_TYPES = ("EXACT", "PER_HOUR", "PER_MONTH", "PER_VISIT", "PER_UNIT")


def technical_routes(parsed: DataFrame) -> DataFrame:
    """One row per (technical need, candidate route) with service, market and status."""
    service = lookup(F.col("route"), q.ROUTE_SERVICES)
    province = F.col("geography.province")
    known = F.col("canonical_service").isNotNull()
    ready = known & F.col("market").isNotNull()
    return (
        settled(parsed, ("query_kind", "technical_need", "geography"))
        .filter(F.col("query_kind") == "TECHNICAL_NEED")
        .select("*", F.posexplode("technical_need.candidate_routes").alias("route_order", "route"))
        .drop("canonical_services", "market_scope", "economic_object_kind")
        .withColumn("canonical_service", service)
        .withColumn("market", F.when(known, province))
        .withColumns(
            {
                "route_status": F.when(known, F.lit("RESOLVED")).otherwise("UNRESOLVED"),
                "economic_object_kind": F.when(known, F.lit("SERVICE")),
                "market_scope": F.when(known, F.lit("LOCAL")),
                "market_key": F.when(ready, F.concat_ws("::", "market", "canonical_service")),
                "market_status": F.when(ready, F.lit("READY"))
                .when(known, "MISSING_PROVINCE")
                .otherwise("UNRESOLVED"),
                "resolution_reason": F.when(ready, F.lit(q.ROUTE_RESOLVED))
                .when(known, q.ROUTE_NO_PROVINCE)
                .otherwise(
                    F.coalesce(lookup(F.col("route"), q.ROUTE_UNRESOLVED), F.lit(q.ROUTE_UNKNOWN))
                ),
            }
        )
    )


def pricing_readiness(routes: DataFrame) -> DataFrame:
    """Whether a resolved route can be looked up, and why not."""
    resolved = F.col("route_status") == "RESOLVED"
    has_service = F.col("canonical_service").isNotNull()
    local = F.col("market_scope") == "LOCAL"
    remote = F.col("market_scope") == "REMOTE_NATIONAL"
    has_market = F.col("market").isNotNull()
    national = F.coalesce(F.col("market") == "AR", F.lit(False))

    def case(unresolved, no_service, no_province, local_ok, no_country, remote_ok, other):
        return (
            F.when(~resolved, unresolved)
            .when(~has_service, no_service)
            .when(local & ~has_market, no_province)
            .when(local, local_ok)
            .when(remote & ~national, no_country)
            .when(remote, remote_ok)
            .otherwise(other)
        )

    status = case(
        F.lit("UNRESOLVED_ROUTE"),
        F.lit("UNRESOLVED_ROUTE"),
        F.lit("MISSING_PROVINCE"),
        F.lit("READY_FOR_PRICING"),
        F.lit("INSUFFICIENT_MARKET_CONTEXT"),
        F.lit("READY_FOR_PRICING"),
        F.lit("INSUFFICIENT_MARKET_CONTEXT"),
    )
    reason = case(
        F.col("resolution_reason"),
        F.lit(q.NO_SERVICE),
        F.lit(q.NEEDS_PROVINCE),
        F.lit(q.READY_LOCAL),
        F.lit(q.NEEDS_COUNTRY),
        F.lit(q.READY_REMOTE),
        F.lit(q.BAD_SCOPE),
    )
    return routes.withColumns(
        {
            "readiness_status": status,
            "ready": status == "READY_FOR_PRICING",
            "readiness_reason": reason,
        }
    )


def probe_evidence(readiness: DataFrame, cohorts: DataFrame) -> DataFrame:
    """Look up each ready route with unknown cadence and standard context."""
    scope = F.when(F.col("market_scope") == "REMOTE_NATIONAL", REMOTE).otherwise(LOCAL)
    asks = readiness.withColumns(
        {
            "cohort_scope": scope,
            "price_scope": F.lit("UNKNOWN"),
            "commercial_context": F.lit("STANDARD"),
            "_no_price": F.lit(None).cast("double"),
            "market": _spread_missing(F.col("market"), F.col("ready")),
        }
    )
    joined = evaluate_prices(
        settled(asks, ("cohort_scope", *COHORT_KEYS)),
        cohorts.withColumnRenamed("market_scope", "cohort_scope"),
        "_no_price",
        ("cohort_scope", *COHORT_KEYS),
    )
    probe = (
        F.when(~F.col("ready"), F.lit("NOT_PROBED"))
        .when(F.col("status").isin("RANGE_READY", "DECISION_READY"), "EVIDENCE_AVAILABLE")
        .otherwise(F.col("status"))
    )
    return joined.withColumns(
        {
            "probe_status": probe,
            "probe_reason": F.when(F.col("ready"), F.col("status")).otherwise(
                F.col("readiness_status")
            ),
            "market": F.when(~F.col("market").startswith("~"), F.col("market")),
        }
    ).drop("_no_price", "status", "price_position", "decision_label")


def _spread_missing(key: Column, usable: Column) -> Column:
    """A join key for rows that must not match, spread over many values.

    NULL keys would all hash to one task of the outer join.
    """
    noise = F.pmod(F.xxhash64("folded"), F.lit(4096)).cast("string")
    return F.when(usable & key.isNotNull(), key).otherwise(F.concat(F.lit("~"), noise))


def resolve_questions(parsed: DataFrame, cohorts: DataFrame, text: str = "text") -> DataFrame:
    """Question to status, refusal reason or evidence. One join to cohorts, one to cadences."""
    market = (
        F.when(F.col("market_scope") == "LOCAL", F.col("geography.province")).when(
            F.col("market_scope") == "REMOTE_NATIONAL", F.lit("AR")
        )
    )
    price = F.col("price")
    evaluating = F.col("intent_action") == "EVALUATE_PRICE"
    refusal = (
        F.when(
            F.col("is_bundle") | (F.size("canonical_services") != 1),
            F.lit("SINGLE_CANONICAL_SERVICE_REQUIRED"),
        )
        .when(F.col("economic_object_kind") != "SERVICE", "SERVICE_ONLY_V1")
        .when(~F.col("market_scope").isin("LOCAL", "REMOTE_NATIONAL"), "UNSUPPORTED_MARKET_SCOPE")
    )
    late_refusal = (
        F.when(evaluating & (price["currency"] != "ARS"), F.lit("ARS_ONLY_V1"))
        .when(
            evaluating & (price["value"].isNull() | ~price["type"].isin(*_PRICED_TYPES)),
            "EXACT_PRICE_REQUIRED_FOR_EVALUATION",
        )
        .when(
            ~F.col("intent_action").isin("EVALUATE_PRICE", "SUGGEST_PRICE", "MARKET_REFERENCE"),
            "UNSUPPORTED_INTENT",
        )
    )
    need = F.col("query_kind") == "TECHNICAL_NEED"
    asks = parsed.withColumn("_plain", fold(F.col(text), collapse=False)).withColumns(
        {
            "_early": F.when(~need & ~F.col("clarification_required"), refusal),
            "_late": late_refusal,
            "canonical_service": F.try_element_at("canonical_services", F.lit(1)),
            "cohort_scope": F.when(F.col("market_scope") == "LOCAL", LOCAL).otherwise(REMOTE),
            "price_scope": question_cadence(F.col("_plain"), price["type"]),
            "commercial_context": commercial_context(F.col("_plain")),
            "proposed_price": F.when(evaluating, price["value"]),
        }
    )
    eligible = ~need & ~F.col("clarification_required") & F.col("_early").isNull()
    asks = asks.withColumns(
        {"_eligible": eligible, "market": _spread_missing(market, eligible)}
    )
    asks = settled(asks, ("cohort_scope", *COHORT_KEYS))
    scoped = cohorts.withColumnRenamed("market_scope", "cohort_scope")
    place = ("cohort_scope", "market", "canonical_service", "commercial_context")
    cadences = (
        scoped.filter(F.col("price_scope") != "UNKNOWN")
        .groupBy(*place)
        .agg(F.lit(True).alias("_has_cadence"))
    )
    evaluated = evaluate_prices(
        asks.join(cadences, list(place), "left"),
        scoped,
        "proposed_price",
        ("cohort_scope", *COHORT_KEYS),
    )
    needs_cadence = (
        F.col("_eligible") & (F.col("price_scope") == "UNKNOWN") & F.col("_has_cadence").isNotNull()
    )
    refused = F.coalesce(F.col("_early"), F.col("_late"))
    status = (
        F.when(need, F.lit("TECHNICAL_NEED_ROUTED"))
        .when(F.col("clarification_required") | needs_cadence, "CLARIFICATION_REQUIRED")
        .when(refused.isNotNull(), "UNSUPPORTED_QUERY")
        .otherwise(F.col("status"))
    )
    no_province = need & F.col("geography.province").isNull()
    answered = ~status.isin("TECHNICAL_NEED_ROUTED", "CLARIFICATION_REQUIRED", "UNSUPPORTED_QUERY")
    asked = status.isin("TECHNICAL_NEED_ROUTED", "CLARIFICATION_REQUIRED")
    facts = ("min_ars", "q1_ars", "median_ars", "q3_ars", "max_ars", "observations_n")
    facts += ("providers_n", "evidence_confidence", "price_position", "decision_label")
    return (
        evaluated.withColumns(
            {
                "clarification_reason": F.when(no_province, q.NEED_PROVINCE_REASON)
                .when(needs_cadence, q.CADENCE_REASON)
                .when(asked, F.col("clarification_reason")),
                "clarification_question": F.when(no_province, q.NEED_PROVINCE_QUESTION)
                .when(needs_cadence, q.CADENCE_QUESTION)
                .when(asked, F.col("clarification_question")),
                "unsupported_reason": F.when(status == "UNSUPPORTED_QUERY", refused),
                **{name: F.when(answered, F.col(name)) for name in facts},
                "market": F.when(answered, F.col("market")),
                "status": status,
            }
        )
        .drop("_plain", "_early", "_late", "_eligible", "_has_cadence")
    )


def audit_questions(resolved: DataFrame, expected: DataFrame, on: str = "id") -> DataFrame:
    """Compare answers with adjudicated cases: outcome per case.

    ``expected``: id, expected_behavior, expected_status, allow_decision and any of the
    ``expected_<field>`` columns below; NULL means "not adjudicated".
    """
    actual = {
        "intent_action": F.col("intent_action"),
        "intent_side": F.col("intent_side"),
        "economic_object_kind": F.col("economic_object_kind"),
        "canonical_services": F.array_join("canonical_services", "|"),
        "market_scope": F.col("market_scope"),
        "price_value": F.col("price.value"),
        "currency": F.col("price.currency"),
        "province": F.col("geography.province"),
        "city": F.col("geography.city"),
        "condition": F.col("condition"),
        "parts_scope": F.col("parts_scope"),
    }
    wrong = F.lit(False)
    for name, column in actual.items():
        if f"expected_{name}" not in expected.columns:
            continue
        want = F.col(f"expected_{name}")
        if name == "price_value":
            bad = column.isNull() | (F.abs(column - want) >= 1e-9)
        else:
            bad = ~column.eqNullSafe(want)
        wrong = wrong | (want.isNotNull() & bad)
    status, behavior = F.col("status"), F.col("expected_behavior")
    wrong_status = (
        ((behavior == "CLARIFICATION") & (status != "CLARIFICATION_REQUIRED"))
        | ((behavior == "SAFE_UNSUPPORTED") & (status != "UNSUPPORTED_QUERY"))
        | (
            (behavior == "PARSE")
            & (
                status.isin("CLARIFICATION_REQUIRED", "UNSUPPORTED_QUERY")
                | F.coalesce(status != F.col("expected_status"), F.lit(False))
            )
        )
    )
    outcome = (
        F.when(
            (status == "DECISION_READY") & ~F.coalesce("allow_decision", F.lit(False)),
            F.lit("UNSAFE_DECISION"),
        )
        .when(wrong_status | wrong, "WRONG_INTERPRETATION")
        .when(behavior == "CLARIFICATION", "CLARIFICATION_CORRECT")
        .when(behavior == "SAFE_UNSUPPORTED", "SAFE_UNSUPPORTED")
        .otherwise("PARSE_CORRECT")
    )
    return resolved.join(expected, on).withColumn("audit_outcome", outcome)
