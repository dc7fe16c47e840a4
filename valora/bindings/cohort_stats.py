"""Cohorts, decisions on prices, and the offer and award readouts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valora.bindings.base import Catalog, cadence_sql, context_sql, derive
from valora.operators import cohorts as co
from valora.operators import decisions as de
from valora.operators import readouts as ro
from valora.operators.quantiles import exact_quantiles
from valora.sources.files import load_cohorts

catalog = Catalog()

_KEYS = "market_scope, market, canonical_service, price_scope, commercial_context"
derive(
    "cohort_rows",
    """SELECT *, CASE WHEN market_scope = 'LOCAL_SERVICE' THEN province ELSE 'AR' END AS market
    FROM {observations}""",
)
_INPUT = f"""SELECT market_scope, market, canonical_service, {cadence_sql()} AS price_scope,
    {context_sql()} AS commercial_context, price, source FROM {{cohort_rows}}
  WHERE semantic_role = 'SINGLE_SERVICE' AND currency = 'ARS'"""
_STATS = f"""SELECT {_KEYS}, count(*) AS observations_n, count(DISTINCT source) AS providers_n,
    min(price) AS min_ars, quantile_cont(price, 0.25) AS q1_ars, quantile_cont(price, 0.5) AS median_ars,
    quantile_cont(price, 0.75) AS q3_ars, max(price) AS max_ars, max(price) / min(price) AS spread
  FROM ({_INPUT}) GROUP BY ALL"""
_GRADED = f"""SELECT *, CASE WHEN observations_n >= 5 AND providers_n >= 3 AND spread <= 2.5 THEN 'MEDIUM'
    WHEN observations_n >= 3 AND providers_n >= 2 AND spread <= 2.0 THEN 'LOW' ELSE 'INSUFFICIENT' END AS evidence_confidence
  FROM ({_STATS})"""
COHORTS_SQL = f"""SELECT {_KEYS}, observations_n, providers_n, round(min_ars, 4) AS min_ars,
    round(q1_ars, 4) AS q1_ars, round(median_ars, 4) AS median_ars, round(q3_ars, 4) AS q3_ars,
    round(max_ars, 4) AS max_ars, round(spread, 3) AS spread_ratio, evidence_confidence,
    evidence_confidence = 'MEDIUM' AS decision_ready, evidence_confidence IN ('LOW', 'MEDIUM') AS range_ready
  FROM ({_GRADED})"""
_MONEY = ("min_ars", "q1_ars", "median_ars", "q3_ars", "max_ars")


def semantic_rows(df: DataFrame) -> DataFrame:
    return df.withColumn("price_value", F.col("price").cast("string"))


def cohort_table(df: DataFrame) -> DataFrame:
    stats = co.cohort_statistics(semantic_rows(df), texts_repeat=True)
    return stats.withColumns({c: F.round(c, 4) for c in _MONEY})


@catalog.query("AGG-01", COHORTS_SQL, df="observations")
def cohort_statistics(df):
    return cohort_table(df)


@catalog.query(
    "AGG-02",
    """SELECT l_suppkey, quantile_cont(l_extendedprice, 0.1) AS p10, quantile_cont(l_extendedprice, 0.5) AS p50,
      quantile_cont(l_extendedprice, 0.9) AS p90 FROM lineitem GROUP BY l_suppkey""",
    df="lineitem",
)
def supplier_quantiles(df):
    wanted = (("p10", 0.1), ("p50", 0.5), ("p90", 0.9))
    return exact_quantiles(df, ["l_suppkey"], "l_extendedprice", wanted)


@catalog.query(
    "AGG-03",
    """SELECT p_type, s_nationkey, n, providers, CASE WHEN n >= 5 AND providers >= 3 AND spread <= 2.5 THEN 'MEDIUM'
        WHEN n >= 3 AND providers >= 2 AND spread <= 2.0 THEN 'LOW' ELSE 'INSUFFICIENT' END AS confidence
      FROM (SELECT p_type, s_nationkey, count(*) AS n, count(DISTINCT l_suppkey) AS providers,
        max(p_retailprice * (1 + l_discount * 10)) / min(p_retailprice * (1 + l_discount * 10)) AS spread
      FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
      GROUP BY p_type, s_nationkey)""",
    lines="lineitem",
    part="part",
    supplier="supplier",
)
def cohort_confidence(lines, part, supplier):
    price = F.col("p_retailprice") * (1 + F.col("l_discount") * 10)
    joined = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).join(
        supplier, F.col("l_suppkey") == F.col("s_suppkey")
    )
    stats = joined.groupBy("p_type", "s_nationkey").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("l_suppkey").alias("providers"),
        (F.max(price) / F.min(price)).alias("_spread"),
    )
    grade = co.confidence(F.col("n"), F.col("providers"), F.col("_spread"))
    return stats.withColumn("confidence", grade).drop("_spread")


@catalog.query(
    "AGG-04",
    f"""SELECT market_scope, evidence_confidence, count(*) AS cohorts, sum(observations_n)::BIGINT AS observations
      FROM ({_GRADED}) GROUP BY ALL""",
    df="observations",
)
def cohorts_by_scope(df):
    return (
        co.cohort_statistics(semantic_rows(df), texts_repeat=True)
        .groupBy("market_scope", "evidence_confidence")
        .agg(F.count(F.lit(1)).alias("cohorts"), F.sum("observations_n").alias("observations"))
    )


# --- decisions ----------------------------------------------------------------------------------


derive(
    "asks",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
      CASE WHEN p_size < 40 THEN 'LOCAL_SERVICE' ELSE 'REMOTE_NATIONAL_SERVICE' END AS market_scope,
      CASE WHEN p_size < 40 THEN n_name ELSE 'AR' END AS market,
      CASE WHEN p_size = 3 THEN 'OTHER' ELSE p_type END AS canonical_service,
      'UNKNOWN' AS price_scope, 'STANDARD' AS commercial_context,
      CASE WHEN l_quantity = 50 THEN NULL ELSE p_retailprice * (0.95 + l_discount) END AS proposed_price
    FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
    JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey""",
)


@catalog.query(
    "DEC-01",
    f"""SELECT a.l_orderkey, a.l_linenumber, a.l_partkey, a.l_suppkey,
      CASE WHEN c.range_ready IS NULL THEN 'NO_EVIDENCE' WHEN NOT c.range_ready THEN 'INSUFFICIENT_EVIDENCE'
        WHEN NOT c.decision_ready OR proposed_price IS NULL THEN 'RANGE_READY' ELSE 'DECISION_READY' END AS status,
      CASE WHEN c.range_ready AND proposed_price IS NOT NULL THEN CASE WHEN proposed_price < min_ars THEN 'BELOW_OBSERVED_RANGE'
        WHEN proposed_price > max_ars THEN 'ABOVE_OBSERVED_RANGE' ELSE 'WITHIN_OBSERVED_RANGE' END END AS price_position,
      CASE WHEN c.decision_ready AND proposed_price IS NOT NULL THEN CASE WHEN proposed_price < q1_ars THEN 'BAJO'
        WHEN proposed_price > q3_ars THEN 'ALTO' ELSE 'RAZONABLE' END END AS decision_label,
      coalesce(observations_n, 0) AS observations_n, coalesce(evidence_confidence, 'NONE') AS evidence_confidence
    FROM {{asks}} a LEFT JOIN ({COHORTS_SQL}) c USING (market_scope, market, canonical_service, price_scope, commercial_context)""",
    asks="asks",
    df="observations",
)
def decide_prices(asks, df):
    keys = ("market_scope", *co.COHORT_KEYS)
    return de.evaluate_prices(asks, cohort_table(df), "proposed_price", keys).select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "status",
        "price_position",
        "decision_label",
        "observations_n",
        "evidence_confidence",
    )


# --- cohort file ---------------------------------------------------------------------------------

derive(
    "cohort_file",
    """SELECT o_orderkey AS row_number, 'M' || CAST(o_custkey % 40 AS STRING) AS market, o_orderpriority AS canonical_service,
      CAST(o_orderkey % 9 AS STRING) AS observations_n, '3' AS providers_n,
      CAST(CAST(FLOOR(o_totalprice) AS BIGINT) AS STRING) AS min_ars, CAST(CAST(FLOOR(o_totalprice) AS BIGINT) + 1 AS STRING) AS q1_ars,
      CAST(CAST(FLOOR(o_totalprice) AS BIGINT) + 2 AS STRING) AS median_ars, CAST(CAST(FLOOR(o_totalprice) AS BIGINT) + 3 AS STRING) AS q3_ars,
      CAST(CAST(FLOOR(o_totalprice) AS BIGINT) + 4 AS STRING) AS max_ars, '1.5' AS spread_ratio, 'LOW' AS evidence_confidence,
      'no' AS decision_ready, 'Yes' AS range_ready,
      CASE WHEN o_orderstatus = 'O' THEN 'PER_HOUR' ELSE '' END AS price_scope FROM {orders}""",
)


@catalog.query(
    "SRC-17",
    """SELECT market, canonical_service, coalesce(nullif(price_scope, ''), 'UNKNOWN') AS price_scope,
      'STANDARD' AS commercial_context, CAST(observations_n AS INTEGER) AS observations_n,
      CAST(min_ars AS DOUBLE) AS min_ars, CAST(q3_ars AS DOUBLE) AS q3_ars, FALSE AS decision_ready, TRUE AS range_ready
    FROM {cohort_file} QUALIFY row_number() OVER (PARTITION BY market, canonical_service, price_scope ORDER BY row_number) = 1""",
    df="cohort_file",
)
def loaded_cohorts(df):
    return load_cohorts(df).select(
        "market",
        "canonical_service",
        "price_scope",
        "commercial_context",
        "observations_n",
        F.col("min_ars").cast("double").alias("min_ars"),
        F.col("q3_ars").cast("double").alias("q3_ars"),
        "decision_ready",
        "range_ready",
    )


@catalog.query(
    "SRC-18",
    f"""SELECT {', '.join(co.COHORT_COLUMNS)} FROM ({COHORTS_SQL})""",
    df="observations",
)
def cohort_export(df):
    """The fixed column order cohort files are written in."""
    return co.ordered_cohorts(cohort_table(df)).select(*co.COHORT_COLUMNS)


# --- award readouts -------------------------------------------------------------------------------

derive(
    "awards",
    """SELECT o_orderkey, c_name AS recipient, n_name AS agency, o_orderdate, o_orderpriority AS naics_text,
      CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN 0.0 WHEN o_orderkey % 17 = 0 THEN -o_totalprice
        ELSE o_totalprice END AS amount,
      CAST(541511 + c_nationkey % 4 AS STRING) AS naics_code, CASE WHEN c_nationkey % 2 = 0 THEN c_mktsegment END AS naics_description,
      CASE WHEN c_nationkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS psc_text,
      CASE WHEN o_orderkey % 19 = 0 THEN 'UNKNOWN' ELSE SUBSTRING(CAST(o_orderdate AS STRING), 1, 10) END AS start_date,
      r_name AS country, n_name AS state,
      CASE o_orderkey % 4 WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN 'short' WHEN 2 THEN '' ELSE 'a long enough description ' || c_name END AS description
    FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
    JOIN {region} ON n_regionkey = r_regionkey""",
)
_LABEL = """CASE WHEN naics_description IS NOT NULL THEN naics_code || ' - ' || naics_description ELSE naics_code END"""
_LONG = f"""SELECT 'naics' AS dimension, {_LABEL} AS label, coalesce(amount, 0.0) AS a FROM {{awards}}
  UNION ALL SELECT 'psc', coalesce(psc_text, 'UNKNOWN'), coalesce(amount, 0.0) FROM {{awards}}
  UNION ALL SELECT 'agency', agency, coalesce(amount, 0.0) FROM {{awards}}
  UNION ALL SELECT 'recipient', recipient, coalesce(amount, 0.0) FROM {{awards}}"""


def _labels():
    return {
        "naics": ro.group_label(F.col("naics_code"), F.col("naics_description"), F.lit("UNKNOWN")),
        "psc": F.coalesce("psc_text", F.lit("UNKNOWN")),
        "agency": F.col("agency"),
        "recipient": F.col("recipient"),
    }


def _top_sql(metric: str) -> str:
    return f"""SELECT dimension, label, n AS award_count, round(total, 2) AS observed_amount, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY {metric} DESC, label) AS rank FROM (
        SELECT dimension, label, count(*) AS n, sum(a) AS total FROM ({_LONG}) GROUP BY ALL)) WHERE rank <= 10"""


def _top(df, by_amount):
    out = ro.top_groups(df, _labels(), F.col("amount"), 10, by_amount)
    return out.withColumn("observed_amount", F.round("observed_amount", 2))


catalog.query("AGG-10", _top_sql("n"), df="awards")(lambda df: _top(df, False))
catalog.query("AGG-10-amount", _top_sql("total"), df="awards")(lambda df: _top(df, True))


@catalog.query(
    "AGG-09",
    """SELECT count(*) AS total_awards, round(sum(amount), 2) AS total_amount, round(median(amount), 4) AS median_amount,
      min(amount) AS min_amount, max(amount) AS max_amount, count(*) FILTER (amount = 0) AS zero_awards,
      count(*) FILTER (amount < 0) AS negative_awards FROM {awards}""",
    df="awards",
)
def award_distribution(df):
    out = ro.amount_distribution(df)
    return out.withColumns(
        {"total_amount": F.round("total_amount", 2), "median_amount": F.round("median_amount", 4)}
    )


@catalog.query(
    "AGG-11",
    f"SELECT o_orderkey, {_LABEL} AS naics, coalesce(psc_text, 'UNKNOWN') AS psc FROM {{awards}}",
    df="awards",
)
def award_labels(df):
    labels = _labels()
    return df.select("o_orderkey", labels["naics"].alias("naics"), labels["psc"].alias("psc"))


@catalog.query(
    "AGG-12",
    """SELECT CASE WHEN length(start_date) >= 7 AND start_date <> 'UNKNOWN' THEN substr(start_date, 1, 7) ELSE 'UNKNOWN' END AS month,
      count(*) AS award_count FROM {awards} GROUP BY 1""",
    df="awards",
)
def awards_by_month(df):
    return ro.awards_by_month(df, F.col("start_date"))


@catalog.query(
    "AGG-13",
    """SELECT country || ':' || state AS place, count(*) AS award_count FROM {awards} GROUP BY 1
      ORDER BY award_count DESC, place LIMIT 10""",
    df="awards",
)
def awards_by_place(df):
    return ro.awards_by_place(df, F.col("country"), F.col("state"), 10)


_EXTREME = "SELECT o_orderkey, recipient, agency, amount FROM {awards}"
catalog.query(
    "AGG-14",
    f"{_EXTREME} WHERE amount IS NOT NULL ORDER BY amount DESC, o_orderkey LIMIT 10",
    df="awards",
)(
    lambda df: ro.extreme_awards(df, "amount", 10, ["o_orderkey"]).select(
        "o_orderkey", "recipient", "agency", "amount"
    )
)
catalog.query(
    "AGG-14-smallest",
    f"{_EXTREME} WHERE amount > 0 ORDER BY amount, o_orderkey LIMIT 10",
    df="awards",
)(
    lambda df: ro.extreme_awards(df, "amount", 10, ["o_orderkey"], largest=False).select(
        "o_orderkey", "recipient", "agency", "amount"
    )
)


@catalog.query(
    "AGG-15",
    """SELECT count(*) FILTER (description IN ('', 'UNKNOWN')) AS empty,
      count(*) FILTER (length(description) BETWEEN 1 AND 19 AND description <> 'UNKNOWN') AS short_lt_20,
      count(*) FILTER (length(description) >= 20) AS normal_gte_20 FROM {awards}""",
    df="awards",
)
def award_descriptions(df):
    return ro.description_quality(df, F.col("description"))


# --- coverage and audits ----------------------------------------------------------------------

derive(
    "reviewed",
    """SELECT d.doc_id AS doc_id, CASE WHEN text = '' THEN 'UNKNOWN' ELSE text END AS text, lang, source,
      CASE WHEN quality = 1 THEN '[]' WHEN quality = 0 THEN 'low' ELSE NULL END AS quality_raw,
      CASE WHEN toxic = 1 THEN 'UNKNOWN' WHEN toxic = 0 THEN CHR(123) || CHR(125) ELSE 'x' END AS toxic_raw
    FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""",
)


@catalog.query(
    "AGG-18",
    """SELECT unnest(['text', 'lang', 'quality', 'toxic']) AS field,
      unnest([count(*) FILTER (text NOT IN ('', 'UNKNOWN')), count(lang), count(*) FILTER (quality_raw = 'low'),
        count(*) FILTER (toxic_raw = 'x')]) AS present, count(*) AS total FROM {reviewed}""",
    df="reviewed",
)
def field_coverage(df):
    fields = {
        "text": F.col("text"),
        "lang": F.col("lang"),
        "quality": F.col("quality_raw"),
        "toxic": F.col("toxic_raw"),
    }
    return ro.field_coverage(df, fields)


@catalog.query(
    "AGG-20",
    """SELECT 'missing' AS label, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
      UNION ALL SELECT 'extra', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
      UNION ALL SELECT 'status=' || CAST(quality AS VARCHAR), count(*) FROM labels GROUP BY quality""",
    documents="documents",
    labels="labels",
)
def review_audit(documents, labels):
    return ro.review_audit(documents, labels, "doc_id", "quality")


@catalog.query(
    "AGG-20-ids",
    """SELECT doc_id, 'missing' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
      UNION ALL SELECT doc_id, 'extra' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""",
    documents="documents",
    labels="labels",
)
def differing_ids(documents, labels):
    return ro.review_differences(documents, labels, "doc_id").select("doc_id", "side")


# --- runs --------------------------------------------------------------------------------------


@catalog.query(
    "AGG-22",
    """SELECT status, count(*) AS runs, count(DISTINCT source) AS names FROM (SELECT user_id AS source,
      CASE WHEN event_type = 'error' THEN 'FAILURE' ELSE 'SUCCESS' END AS status FROM events) GROUP BY status""",
    events="events",
)
def run_metrics(events):
    failed = F.col("event_type") == "error"
    runs = events.select(
        F.col("user_id").alias("source"),
        F.when(failed, "FAILURE").otherwise("SUCCESS").alias("status"),
    )
    return ro.run_metrics(runs)


@catalog.query(
    "AGG-22-names",
    """SELECT DISTINCT CASE WHEN event_type = 'error' THEN 'FAILURE' ELSE 'SUCCESS' END AS status,
      user_id AS source FROM events""",
    events="events",
)
def run_names(events):
    failed = F.col("event_type") == "error"
    status = F.when(failed, "FAILURE").otherwise("SUCCESS").alias("status")
    return ro.run_names(events.select(F.col("user_id").alias("source"), status))


@catalog.query(
    "AGG-24",
    """SELECT round(count(*) FILTER (event_type IN ('view', 'purchase')) / count(*), 6) AS acquisition_yield,
      round(count(*) FILTER (value > 5) / count(*) FILTER (event_type <> 'error'), 6) AS economic_density,
      round(count(*) FILTER (event_type = 'purchase') / count(DISTINCT user_id), 6) AS useful_observation_yield,
      round(count(*) FILTER (event_type = 'click') / count(*) FILTER (event_type <> 'error'), 6) AS technology_yield
    FROM events""",
    events="events",
)
def yields(events):
    kind = F.col("event_type")
    sources = events.select("user_id").distinct().agg(F.count(F.lit(1)).alias("_s"))
    counts = {
        "operations": F.lit(1),
        "acquired": kind != "error",
        "accepted": kind.isin("view", "purchase"),
        "useful_semantics": F.col("value") > 5,
        "comparable": kind == "purchase",
        "technology": kind == "click",
    }
    flags = events.agg(*[F.sum(c.cast("bigint")).alias(n) for n, c in counts.items()])
    row = flags.join(sources.withColumnRenamed("_s", "sources"), F.lit(True))
    return ro.yield_ratios(row, {n: F.col(n) for n in [*counts, "sources"]})


@catalog.query(
    "AGG-25",
    """SELECT i AS stage_order, ['DISCOVERED', 'VERIFIED', 'ACQUISITION_ATTEMPTED', 'RAW_ACQUIRED', 'PRICE_DETECTED',
        'ECONOMIC_OBSERVATION', 'QUALITY_ACCEPTED', 'COMPARABLE'][i] AS stage, n,
      CASE WHEN i = 1 THEN 1.0 ELSE round(n / lag(n) OVER (ORDER BY i), 6) END::DOUBLE AS conversion
    FROM (SELECT i, count(*) FILTER (least(7, CAST(floor(value / 3) AS BIGINT)) >= i - 1) AS n
      FROM events, range(1, 9) r(i) GROUP BY i)""",
    events="events",
)
def acquisition_funnel(events):
    return ro.funnel(events, F.least(F.lit(7), F.floor(F.col("value") / 3)))
