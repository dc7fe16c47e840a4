"""Whether two offers may be compared, and why not."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that change the material scope of an offer.
MATERIAL_WORDS = ("equipo", "insumo", "hardware")
ONE_OFF = "puntual"


def material_scope(text: Column) -> Column:
    """Bit mask of the material words in a text."""
    plain = F.lower(F.coalesce(text, F.lit("")))
    bits = [F.contains(plain, F.lit(w)).cast("int") * (1 << i) for i, w in enumerate(MATERIAL_WORDS)]
    return sum(bits[1:], bits[0])


def known_period(period: Column, period_known: Column) -> Column:
    """Period of a price; a known price without one is one-off, an unknown one stays NULL."""
    return F.when(period_known, F.coalesce(F.nullif(period, F.lit("")), F.lit(ONE_OFF)))


def is_one_off(period: Column) -> Column:
    return period.isNull()


def is_indicative(raw: Column) -> Column:
    plain = F.lower(F.coalesce(raw, F.lit("")))
    return plain.contains("orientativo") | plain.contains("referencia")


def offer_signature(df: DataFrame, unfit_sources: Sequence[str] = ()) -> DataFrame:
    """The facts a verdict depends on: source fitness, material scope, period, indicative."""
    fit = ~F.col("source").isin(*unfit_sources) if unfit_sources else F.lit(True)
    return df.withColumns(
        {
            "_fit": F.coalesce(fit, F.lit(True)),
            "_scope": material_scope(F.col("service_raw")),
            "_period": known_period(F.col("period"), F.col("period_known")),
            "_indicative": is_indicative(F.col("price_raw")),
        }
    )


def verdict(left: str, right: str) -> dict[str, Column]:
    """State, cause and warning of two signatures with column prefixes ``left``/``right``."""

    def both(name: str) -> tuple[Column, Column]:
        return F.col(f"{left}{name}"), F.col(f"{right}{name}")

    (fit_l, fit_r), (scope_l, scope_r) = both("_fit"), both("_scope")
    (per_l, per_r), (ind_l, ind_r) = both("_period"), both("_indicative")
    cause = (
        F.when(~(fit_l & fit_r), F.lit("fuente_no_apta"))
        .when(scope_l != scope_r, "scope_material_distinto")
        .when(per_l.isNull() != per_r.isNull(), "periodicidad_desconocida")
        .when(per_l != per_r, "periodicidad_incompatible")
        .when(per_l != ONE_OFF, "unidad_economica_desconocida")
    )
    state = (
        F.when(cause.isNull(), F.lit("potencialmente_comparable"))
        .when(
            cause.isin("scope_material_distinto", "periodicidad_incompatible"), "no_comparable"
        )
        .otherwise("indeterminado")
    )
    warning = F.when(cause.isNull() & (ind_l | ind_r), F.lit("precio_orientativo"))
    return {"state": state, "cause": cause, "warning": warning}


def compare_pairs(
    offers: DataFrame, pairs: DataFrame, unfit_sources: Sequence[str] = ()
) -> DataFrame:
    """Verdict for each given pair (left_id, right_id): two key joins, nothing else."""
    signed = offer_signature(offers, unfit_sources).select(
        "offer_id", "_fit", "_scope", "_period", "_indicative"
    )
    for side in ("left", "right"):
        renamed = signed.select(
            F.col("offer_id").alias(f"{side}_id"),
            *[F.col(c).alias(f"{side}{c}") for c in signed.columns if c != "offer_id"],
        )
        pairs = pairs.join(renamed, f"{side}_id")
    return pairs.withColumns(verdict("left", "right")).drop(
        *[f"{s}{c}" for s in ("left", "right") for c in ("_fit", "_scope", "_period", "_indicative")]
    )


def pair_verdict_counts(
    offers: DataFrame, block: Sequence[str], unfit_sources: Sequence[str] = ()
) -> DataFrame:
    """Verdicts over *all* unordered pairs inside each block, without making a pair.

    A verdict depends only on the two signatures, of which a block has a handful, so offers
    are counted per signature first and pairs follow by multiplication.
    """
    block = list(block)
    facts = ["_fit", "_scope", "_period", "_indicative"]
    counts = (
        offer_signature(offers, unfit_sources)
        .groupBy(*block, *facts)
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("_sig", F.concat_ws("|", *[F.coalesce(F.col(f).cast("string"), F.lit("?")) for f in facts]))
    )
    left = counts.select(*block, *[F.col(c).alias(f"left{c}") for c in [*facts, "_sig"]], F.col("n").alias("n_left"))
    right = counts.select(*block, *[F.col(c).alias(f"right{c}") for c in [*facts, "_sig"]], F.col("n").alias("n_right"))
    pairs = left.join(right, block).filter(F.col("left_sig") <= F.col("right_sig"))
    n_pairs = F.when(
        F.col("left_sig") == F.col("right_sig"),
        F.shiftright(F.col("n_left") * (F.col("n_left") - 1), 1),
    ).otherwise(F.col("n_left") * F.col("n_right"))
    return (
        pairs.withColumns({**verdict("left", "right"), "_pairs": n_pairs})
        .groupBy(*block, "state", "cause", "warning")
        .agg(F.sum("_pairs").alias("pairs"))
        .filter(F.col("pairs") > 0)
    )
