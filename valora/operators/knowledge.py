"""Semantic knowledge: concepts, aliases, resolution, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valora.functions.rules import text_or_empty
from valora.functions.text import fold
from valora.operators.semantic import classify_observations

PROVIDER_CONTEXT = "PROVIDER_OBSERVATION"
SINGLE = "SINGLE_SERVICE"
#: Keys that the rows of one expression are dealt over; its aliases are copied as often.
SPREAD = 16
PARITY_OUTCOMES = ("PARITY", "AMBIGUOUS_PRESERVED", "MISSING", "WRONG_CONCEPT")


def _clean_rows(rows: DataFrame) -> DataFrame:
    names = ("observation_id", "economic_object_raw", "canonical_service", "semantic_role")
    names += ("market_scope", "source", "price_value", "currency")
    return rows.withColumns({n: text_or_empty(F.col(n)) for n in names})


def skip_reason() -> Column:
    """Why a cleaned row cannot seed an alias; NULL when it can."""
    return (
        F.when(F.col("economic_object_raw") == "", F.lit("MISSING_RAW_EXPRESSION"))
        .when(F.col("canonical_service") == "", "MISSING_CANONICAL_SERVICE")
        .when(
            F.col("semantic_role") != SINGLE,
            F.concat(F.lit("SEMANTIC_ROLE:"), F.col("semantic_role")),
        )
    )


def seed_concepts(rows: DataFrame, strict: bool = True) -> DataFrame:
    """Concepts with their single market scope. ``strict`` fails on any other number of scopes."""
    eligible = _clean_rows(rows).filter(skip_reason().isNull())
    scope = F.nullif("market_scope", F.lit(""))
    concepts = eligible.groupBy(F.col("canonical_service").alias("concept_id")).agg(
        F.min(scope).alias("_low"), F.max(scope).alias("_high")
    )
    single = F.col("_low").isNotNull() & (F.col("_low") == F.col("_high"))
    failure = F.raise_error(
        F.concat(F.lit("Cannot derive a single concept_type for "), F.col("concept_id"))
    )
    kind = F.when(single, F.col("_low"))
    return concepts.select(
        "concept_id", (kind.otherwise(failure) if strict else kind).alias("concept_type")
    )


def seed_aliases(rows: DataFrame, source_path: str, version: str = "v4") -> DataFrame:
    """One alias per eligible row, with provenance by id or by a 16-hex row hash."""
    fields = ("source", "economic_object_raw", "price_value", "currency")
    fields += ("semantic_role", "canonical_service")
    row_hash = F.substring(F.sha2(F.concat_ws("|", *fields), 256), 1, 16)
    by_id = F.concat(F.lit(f"{source_path}:observation_id="), F.col("observation_id"))
    by_hash = F.concat(F.lit(f"{source_path}:row_hash="), row_hash)
    number = F.when(F.col("observation_id").rlike(r"^\d+$"), F.col("observation_id"))
    return (
        _clean_rows(rows)
        .filter(skip_reason().isNull())
        .select(
            F.col("economic_object_raw").alias("expression"),
            fold(F.col("economic_object_raw")).alias("folded"),
            F.col("canonical_service").alias("concept_id"),
            F.lit(PROVIDER_CONTEXT).alias("context"),
            F.lit("SEMANTIC_NORMALIZATION").alias("origin_type"),
            F.when(F.col("observation_id") != "", by_id).otherwise(by_hash).alias(
                "origin_reference"
            ),
            F.lit(version).alias("origin_version"),
            F.coalesce(number.try_cast("bigint"), F.lit(10**12)).alias("sort_number"),
            F.when(number.isNull(), F.col("observation_id")).otherwise("").alias("sort_text"),
        )
    )


def with_known_concepts(aliases: DataFrame, concepts: DataFrame) -> DataFrame:
    """The aliases; one that points to a concept that does not exist is an error."""
    known = concepts.select(F.col("concept_id").alias("_known")).distinct()
    failure = F.raise_error(F.concat(F.lit("Alias of an unknown concept: "), F.col("concept_id")))
    checked = F.when(F.col("_known").isNull(), failure).otherwise(F.col("concept_id"))
    return (
        aliases.join(known, F.col("concept_id") == F.col("_known"), "left")
        .withColumn("concept_id", checked)
        .drop("_known")
    )


def expression_candidates(
    expressions: DataFrame, aliases: DataFrame, expression: str = "expression"
) -> DataFrame:
    """Every candidate of each expression with its provenance, one row each.

    The detail behind ``resolve_expressions``: one row per alias of the folded expression in
    its context. Rows of one expression are dealt over ``SPREAD`` keys, so that a common one,
    which gives by far the most rows, is not the work of one task.
    """
    keyed = expressions.withColumn("folded", fold(F.col(expression)))
    if "context" not in keyed.columns:
        keyed = keyed.withColumn("context", F.lit(PROVIDER_CONTEXT))
    detail = aliases.select(
        "folded",
        "context",
        "concept_id",
        F.col("expression").alias("alias_expression"),
        "origin_type",
        "origin_reference",
        "origin_version",
        F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("_salt"),
    )
    row = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in keyed.columns])))
    keys = ["folded", "context", "_salt"]
    # a given number of partitions is kept: what is joined is small, what comes out is not
    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.withColumn("_salt", F.pmod(row, F.lit(SPREAD)).cast("int")).repartition(parts, *keys)
    return dealt.join(detail, keys).drop("_salt")


def missing_concepts(aliases: DataFrame, concepts: DataFrame) -> DataFrame:
    """Concept ids aliases point to that do not exist; must be empty."""
    return (
        aliases.join(concepts.select("concept_id"), "concept_id", "left_anti")
        .select("concept_id")
        .distinct()
    )


def alias_index(aliases: DataFrame) -> DataFrame:
    """Distinct concepts per folded expression and context: bounded by the concept list.

    The alias table itself stays the detail (candidates with provenance), keyed by ``folded``;
    it is never multiplied with the expressions.
    """
    pairs = aliases.select("folded", "context", "concept_id").distinct()
    return pairs.groupBy("folded", "context").agg(
        F.count(F.lit(1)).alias("concepts_n"),
        F.array_sort(F.collect_set("concept_id")).alias("candidate_concepts"),
    )


def resolve_expressions(
    expressions: DataFrame, aliases: DataFrame, expression: str = "expression"
) -> DataFrame:
    """Folded equality lookup in a context: UNKNOWN, RESOLVED or AMBIGUOUS."""
    n = F.coalesce("concepts_n", F.lit(0))
    status = (
        F.when(n == 0, F.lit("UNKNOWN")).when(n == 1, "RESOLVED").otherwise("AMBIGUOUS")
    )
    keyed = expressions.withColumn("folded", fold(F.col(expression)))
    if "context" not in keyed.columns:
        keyed = keyed.withColumn("context", F.lit(PROVIDER_CONTEXT))
    none = F.array().cast("array<string>")
    return keyed.join(alias_index(aliases), ["folded", "context"], "left").withColumns(
        {
            "core_status": status,
            "candidate_concepts": F.coalesce("candidate_concepts", none),
            "concepts_n": n,
        }
    )


def profile_rows(rows: DataFrame) -> DataFrame:
    """Long-form profile (section, label, value) of a normalisation table."""
    df = _clean_rows(rows).select(
        "semantic_role",
        "canonical_service",
        F.col("economic_object_raw").alias("raw"),
        fold(F.col("economic_object_raw")).alias("folded"),
        skip_reason().alias("skip"),
    )
    # Rows repeat: equal ones are counted first, by hash. The smallest and largest text of a group
    # need a sort of what is grouped, which is then one row per distinct row of a task.
    df = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("rows"))
    has_canonical = F.col("canonical_service") != ""
    eligible = F.col("skip").isNull()

    def counted(test: Column) -> Column:
        return F.coalesce(F.sum(F.when(test, F.col("rows"))), F.lit(0))

    # One pass: the rows are grouped in six ways at once, and each group says what it counts for.
    ways = ("folded", "raw", "canonical_service", "skip", "semantic_role")
    groups = df.groupingSets([[F.col(w)] for w in ways] + [[]], *ways).agg(
        F.grouping_id().alias("gid"),
        counted(F.lit(True)).alias("n"),
        counted(has_canonical).alias("with_canonical"),
        counted(eligible).alias("seeds"),
        F.min(F.when(has_canonical, F.col("canonical_service"))).alias("low"),
        F.max(F.when(has_canonical, F.col("canonical_service"))).alias("high"),
    )

    def by(way: str) -> Column:
        """Grouped by ``way`` alone: all bits of the grouping id but its own are set."""
        return F.col("gid") == (1 << len(ways)) - 1 - (1 << (len(ways) - 1 - ways.index(way)))

    def total(label: str, value: Column) -> Column:
        return _entry(F.lit("total"), F.lit(label), value)

    n, seeds = F.col("n"), F.col("seeds")
    named = F.col("folded") != ""
    entries = (
        F.when(
            by("folded"),
            F.array(
                total("duplicate_normalized_expressions", named & (n > 1)),
                total("unique_aliases", seeds > 0),
                total("same_expression_multiple_canonical", named & (F.col("low") != F.col("high"))),
            ),
        )
        .when(by("raw"), F.array(total("duplicate_raw_expressions", (F.col("raw") != "") & (n > 1))))
        .when(by("canonical_service"), F.array(total("unique_concepts", seeds > 0)))
        .when(by("skip"), F.array(_entry(F.lit("skip_reason"), F.col("skip"), n)))
        .when(
            by("semantic_role"),
            F.array(
                _entry(F.lit("role_rows"), F.col("semantic_role"), n),
                _entry(F.lit("role_with_canonical"), F.col("semantic_role"), F.col("with_canonical")),
            ),
        )
        .otherwise(
            F.array(
                total("total_rows", n),
                total("rows_with_canonical", F.col("with_canonical")),
                total("eligible_alias_rows", seeds),
                total("skipped_rows", n - seeds),
            )
        )
    )
    labels = (
        "total_rows", "rows_with_canonical", "eligible_alias_rows", "skipped_rows", "unique_aliases",
        "unique_concepts", "duplicate_raw_expressions", "duplicate_normalized_expressions",
        "same_expression_multiple_canonical",
    )
    zeros = df.sparkSession.range(1).select(F.inline(F.array(*[total(x, F.lit(0)) for x in labels])))
    return (
        groups.select(F.inline(entries))
        .where("section != 'skip_reason' OR label IS NOT NULL")
        .unionByName(zeros)
        .groupBy("section", "label")
        .agg(F.sum("value").alias("value"))
    )


def _entry(section: Column, label: Column, value: Column) -> Column:
    number = F.coalesce(value.cast("bigint"), F.lit(0).cast("bigint"))
    return F.struct(section.alias("section"), label.alias("label"), number.alias("value"))


def parity_outcomes(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """Resolve every eligible row against the index and compare with its own concept."""
    eligible = _clean_rows(rows).filter(skip_reason().isNull())
    resolved = resolve_expressions(
        eligible.drop("context"), aliases, expression="economic_object_raw"
    )
    expected_found = F.array_contains("candidate_concepts", F.col("canonical_service"))
    outcome = (
        F.when(F.col("core_status") == "UNKNOWN", F.lit("MISSING"))
        .when(~expected_found, "WRONG_CONCEPT")
        .when(F.col("core_status") == "AMBIGUOUS", "AMBIGUOUS_PRESERVED")
        .otherwise("PARITY")
    )
    return resolved.withColumn("outcome", outcome)


def parity_audit(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """Count per outcome; outcomes that do not occur are reported as zero."""
    counted = parity_outcomes(rows, aliases).agg(
        *[F.count_if(F.col("outcome") == name).alias(name) for name in PARITY_OUTCOMES]
    )
    return counted.unpivot([], list(PARITY_OUTCOMES), "outcome", "n")


def aggregate_candidates(observations: DataFrame) -> DataFrame:
    """Candidates by (folded expression, context, concept): frequency and independence.

    The ordered observations of a candidate stay rows of the input, keyed the same way.
    """
    keys = ["normalized_expression", "context", "proposed_concept_id"]
    keyed = observations.withColumn("normalized_expression", fold(F.col("expression")))
    # Counted by hash per provider and province. The smallest row of a candidate needs a sort of all
    # rows in a task, so it is found apart: together, each row is sorted once per distinct count more.
    cells = keyed.groupBy(*keys, "provider", "province").agg(F.count(F.lit(1)).alias("_n"))
    counts = cells.groupBy(*keys).agg(
        F.sum("_n").alias("observations_n"),
        F.count_distinct("provider").alias("providers_n"),
        F.count_distinct(F.nullif("province", F.lit(""))).alias("provinces_n"),
    )
    first = F.min(F.struct("provider", "observation_id", "source", "expression"))
    firsts = keyed.groupBy(*keys).agg(first["expression"].alias("expression"))
    renamed = firsts.withColumnsRenamed({k: f"_f_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_f_{k}")) for k in keys]
    return counts.join(renamed, same).select(
        *keys, "expression", F.lit("OBSERVED").alias("status"), "observations_n", "providers_n", "provinces_n"
    )


def _single_match(canonical: Column) -> Column:
    return (F.size("candidate_concepts") == 1) & F.array_contains("candidate_concepts", canonical)


def shadow_compare(
    observations: DataFrame, aliases: DataFrame, expression: str = "expression"
) -> DataFrame:
    """Rule classification next to knowledge resolution; the rule result stays authoritative."""
    legacy = classify_observations(observations, expression, "province")
    both = resolve_expressions(legacy, aliases, expression)
    canonical = F.nullif("canonical_service", F.lit(""))
    named, core = canonical.isNotNull(), F.col("core_status")
    outside = ~F.col("semantic_role").isin(SINGLE, "UNMAPPED") & ~named
    status = (
        F.when(core == "AMBIGUOUS", F.lit("CORE_AMBIGUOUS"))
        .when(outside, "NOT_COMPARABLE")
        .when(named & (core == "UNKNOWN"), "CORE_UNKNOWN")
        .when(~named & (core == "RESOLVED"), "LEGACY_UNKNOWN_CORE_RESOLVED")
        .when(
            named & (core == "RESOLVED"),
            F.when(_single_match(canonical), "PARITY").otherwise("LEGACY_RESOLVED_CORE_DIFFERENT"),
        )
        .otherwise("NOT_COMPARABLE")
    )
    return both.withColumn("comparison", status)


def knowledge_reuse(
    rows: DataFrame,
    aliases: DataFrame,
    seed_expressions: DataFrame,
    corpus_expressions: DataFrame,
    generalizes: bool = False,
) -> DataFrame:
    """How fresh rows reuse stored knowledge. Both expression tables have ``expression``.

    ``generalizes`` says the rows came from the live rule classifier.
    """
    cleaned = _clean_rows(rows)
    core = resolve_expressions(cleaned, aliases, "economic_object_raw")
    for name, table in (("seen_seed", seed_expressions), ("seen_corpus", corpus_expressions)):
        known = table.select(fold(F.col("expression")).alias("folded")).distinct()
        core = core.join(known.withColumn(f"_{name}", F.lit(True)), "folded", "left").withColumn(
            name, F.col(f"_{name}").isNotNull()
        )
    canonical = F.nullif("canonical_service", F.lit(""))
    named, status = canonical.isNotNull(), F.col("core_status")
    fresh = "LIVE_GENERALIZATION" if generalizes else "FRESH_UNSEEN_CANONICAL_CORE_UNKNOWN"
    reuse = (
        F.when(
            ~F.col("semantic_role").isin(SINGLE, "UNMAPPED") & ~named, F.lit("NOT_COMPARABLE")
        )
        .when(status == "AMBIGUOUS", "CORE_AMBIGUOUS")
        .when(
            named & (status == "UNKNOWN"),
            F.when(
                F.col("seen_corpus") & ~F.col("seen_seed"), "SEED_SEEN_NON_ALIAS_CORE_UNKNOWN"
            ).otherwise(fresh),
        )
        .when(~named & (status == "RESOLVED"), "CORE_MEMORY_LEGACY_UNKNOWN")
        .when(
            named & (status == "RESOLVED"),
            F.when(~_single_match(canonical), "SEMANTIC_DISAGREEMENT")
            .when(F.col("seen_seed"), "EXACT_MEMORY_REUSE")
            .otherwise("SHARED_PARITY_ON_FRESH"),
        )
        .otherwise("BOTH_UNKNOWN")
    )
    return core.withColumn("reuse_class", reuse).drop("_seen_seed", "_seen_corpus")
