"""Price decisions against cohorts and their wording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valora.functions.price import pesos
from valora.functions.rules import lookup
from valora.operators.cohorts import COHORT_KEYS

_COHORT_FACTS = (
    "observations_n",
    "providers_n",
    "min_ars",
    "q1_ars",
    "median_ars",
    "q3_ars",
    "max_ars",
    "evidence_confidence",
    "decision_ready",
    "range_ready",
)


def evidence_status(proposed: Column) -> Column:
    """Status of a row already joined to its cohort (``range_ready`` NULL = no cohort)."""
    return (
        F.when(F.col("range_ready").isNull(), F.lit("NO_EVIDENCE"))
        .when(~F.col("range_ready"), "INSUFFICIENT_EVIDENCE")
        .when(~F.col("decision_ready") | proposed.isNull(), "RANGE_READY")
        .otherwise("DECISION_READY")
    )


def price_position(proposed: Column) -> Column:
    """Against the observed range, bounds included; filled as soon as a range is usable."""
    position = (
        F.when(proposed < F.col("min_ars"), F.lit("BELOW_OBSERVED_RANGE"))
        .when(proposed > F.col("max_ars"), "ABOVE_OBSERVED_RANGE")
        .otherwise("WITHIN_OBSERVED_RANGE")
    )
    return F.when(F.col("range_ready") & proposed.isNotNull(), position)


def decision_label(proposed: Column) -> Column:
    label = (
        F.when(proposed < F.col("q1_ars"), F.lit("BAJO"))
        .when(proposed > F.col("q3_ars"), "ALTO")
        .otherwise("RAZONABLE")
    )
    return F.when(F.col("decision_ready") & proposed.isNotNull(), label)


def evaluate_prices(
    asks: DataFrame,
    cohorts: DataFrame,
    proposed: str = "proposed_price",
    keys: tuple[str, ...] = COHORT_KEYS,
) -> DataFrame:
    """Left join asks to their cohort and add status, position and label.

    One cohort row per key is expected. No broadcast is forced: Spark broadcasts the cohorts
    when their measured size is small, else it joins by key with skew handling.
    """
    facts = cohorts.select(*keys, *_COHORT_FACTS)
    price = F.col(proposed)
    return (
        asks.join(facts, list(keys), "left")
        .withColumns(
            {
                "status": evidence_status(price),
                "price_position": price_position(price),
                "decision_label": decision_label(price),
                "observations_n": F.coalesce("observations_n", F.lit(0)),
                "providers_n": F.coalesce("providers_n", F.lit(0)),
                "evidence_confidence": F.coalesce("evidence_confidence", F.lit("NONE")),
            }
        )
        .drop("decision_ready", "range_ready")
    )


# --- wording -------------------------------------------------------------------------------------

# Headlines and sentences shown to a user.
HEADLINES = (
    ("CLARIFICATION_REQUIRED", "Necesito una aclaración"),
    ("UNSUPPORTED_QUERY", "Todavía no puedo comparar esta consulta"),
    ("RANGE_READY", "Rango de mercado disponible"),
    ("INSUFFICIENT_EVIDENCE", "Evidencia insuficiente"),
    ("NO_EVIDENCE", "Sin evidencia comparable"),
)
NO_COHORT_HEADLINE = "Sin evidencia disponible"
NO_COHORT_SUMMARY = "No encontré una cohorte comparable para esta consulta."
DEFAULT_QUESTION = "Necesito un dato más para comparar correctamente."
UNSUPPORTED_SUMMARY = "La consulta está fuera del alcance seguro de la decisión de precios v1."
RANGE_SUMMARY = (
    "Hay evidencia suficiente para mostrar un rango empírico, "
    "pero no para emitir BAJO/RAZONABLE/ALTO."
)
INSUFFICIENT_SUMMARY = (
    "Hay precios observados, pero la muestra o diversidad de proveedores "
    "todavía no alcanza para una decisión confiable."
)
INSUFFICIENT_CAVEAT = "La decisión se retiene en lugar de sobreinterpretar la muestra."
NO_EVIDENCE_SUMMARY = "No encontré precios comparables para este servicio y mercado."


def _sentence(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def explain_decision() -> dict[str, Column]:
    """headline, summary, evidence_line and caveat for rows with a ``status``.

    Wording only: it never changes evidence, thresholds or labels.
    """
    status = F.col("status")
    asked = status == "CLARIFICATION_REQUIRED"
    refused = status == "UNSUPPORTED_QUERY"
    decided = status == "DECISION_READY"
    has_cohort_answer = status.isin(
        "DECISION_READY", "RANGE_READY", "INSUFFICIENT_EVIDENCE", "NO_EVIDENCE"
    )
    low, high = pesos(F.col("q1_ars")), pesos(F.col("q3_ars"))
    decided_summary = (
        F.when(
            F.col("decision_label") == "BAJO",
            _sentence(
                "El precio consultado está bajo para esta cohorte. "
                "El 25% central inferior comienza en ",
                low,
                ".",
            ),
        )
        .when(
            F.col("decision_label") == "ALTO",
            _sentence(
                "El precio consultado está alto para esta cohorte. "
                "El cuartil superior comienza por encima de ",
                high,
                ".",
            ),
        )
        .otherwise(
            _sentence(
                "El precio consultado está dentro del rango razonable de la cohorte (",
                low,
                "–",
                high,
                ").",
            )
        )
    )
    evidence_line = _sentence(
        "Rango observado ",
        pesos(F.col("min_ars")),
        "–",
        pesos(F.col("max_ars")),
        "; mediana ",
        pesos(F.col("median_ars")),
        "; ",
        F.col("observations_n").cast("string"),
        " precios de ",
        F.col("providers_n").cast("string"),
        " proveedores.",
    )
    trust = _sentence("Confianza de evidencia: ", F.col("evidence_confidence"), ".")
    headline = F.when(decided, F.col("decision_label")).otherwise(
        F.coalesce(lookup(status, HEADLINES), F.lit(NO_COHORT_HEADLINE))
    )
    summary = (
        F.when(asked, F.coalesce(F.col("clarification_question"), F.lit(DEFAULT_QUESTION)))
        .when(refused, UNSUPPORTED_SUMMARY)
        .when(decided, decided_summary)
        .when(status == "RANGE_READY", RANGE_SUMMARY)
        .when(status == "INSUFFICIENT_EVIDENCE", INSUFFICIENT_SUMMARY)
        .when(status == "NO_EVIDENCE", NO_EVIDENCE_SUMMARY)
        .otherwise(NO_COHORT_SUMMARY)
    )
    caveat = (
        F.when(asked, F.col("clarification_reason"))
        .when(refused, F.col("unsupported_reason"))
        .when(decided | (status == "RANGE_READY"), trust)
        .when(status == "INSUFFICIENT_EVIDENCE", INSUFFICIENT_CAVEAT)
    )
    return {
        "headline": headline,
        "summary": summary,
        "evidence_line": F.when(has_cohort_answer & (status != "NO_EVIDENCE"), evidence_line),
        "caveat": caveat,
    }
