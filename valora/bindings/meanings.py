"""Classification, meanings and knowledge over observation texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from valora.bindings.base import Catalog, LINE_ID, derive, filled, quoted
from valora.functions.rules import joined
from valora.functions.text import fold
from valora.operators import knowledge as kn
from valora.operators import semantic as se
from valora.plans.understanding import UNDERSTANDING_STATUSES, sidecar, sidecar_checks

catalog = Catalog()

# text, role, market, service, kind, status and (for meanings) the joined signals
_CLASS = (
    ("Ryzen 5 RTX 4060 16GB {name}", "HARDWARE_PRODUCT", "GOODS_MARKET", ""),
    ("Instalación de Windows {name}", "SINGLE_SERVICE", "LOCAL_SERVICE", "FORMATEO_INSTALACION_SO"),
    ("PC {name} que no arranca", "SINGLE_SERVICE", "LOCAL_SERVICE", "REPARACION_INICIO_WINDOWS"),
    ("PC {name} no inicia y no enciende", "UNMAPPED", "UNKNOWN", ""),
    ("Cambio de disco y clonado {name}", "COMPOSITE_SERVICE", "MIXED_OR_UNKNOWN", ""),
    ("{name} Más popular", "UNMAPPED", "UNKNOWN", ""),
    ("SSD 480 GB {name}", "UNMAPPED", "UNKNOWN", ""),
)
N_CLASS = len(_CLASS)


def _arms(values) -> str:
    return " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))


derive(
    "new_texts",
    f"""SELECT p_partkey, p_partkey % {N_CLASS} AS no, CASE p_partkey % {N_CLASS}
      {_arms(filled(t, name='p_name') for t, *_ in _CLASS)} END AS economic_object_raw,
      CASE WHEN p_size = 1 THEN '' ELSE p_brand END AS province FROM {{part}}""",
)
_ROLE = f"CASE no {_arms(quoted(c[1]) for c in _CLASS)} END"
_MARKET = f"CASE no {_arms(quoted(c[2]) for c in _CLASS)} END"
_SERVICE = f"CASE no {_arms(quoted(c[3]) for c in _CLASS)} END"
catalog.query(
    "SEM-01",
    f"""SELECT p_partkey, {_ROLE} AS semantic_role, {_MARKET} AS market_scope,
      CASE WHEN no = 4 THEN 'REPARACION_HW|BACKUP_DATOS' ELSE {_SERVICE} END AS matched_services,
      {_SERVICE} AS canonical_service,
      CASE WHEN {_SERVICE} <> '' AND province <> '' THEN province || '::' || {_SERVICE} ELSE '' END AS comparability_key
    FROM {{new_texts}}""",
    df="new_texts",
)(
    lambda df: se.classify_observations(df).select(
        "p_partkey",
        "semantic_role",
        "market_scope",
        "matched_services",
        "canonical_service",
        "comparability_key",
    )
)

# --- frozen baseline ----------------------------------------------------------------------------

derive(
    "live_observations",
    f"""SELECT {LINE_ID} AS observation_id, l_suppkey AS raw_document_id, 's' || CAST(l_suppkey AS STRING) AS source,
      economic_object_raw, no, CAST(p_retailprice + l_linenumber AS STRING) AS price_value, 'ARS' AS currency,
      'INDETERMINATE' AS comparable_status, 'v3' AS extractor_version, l_linenumber
    FROM {{lineitem}} JOIN {{new_texts}} n ON l_partkey = n.p_partkey JOIN {{part}} p ON l_partkey = p.p_partkey""",
)
derive(
    "live_documents",
    "SELECT s_suppkey AS raw_document_id, n_name AS province, '' AS city FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey",
)
# The frozen table holds the observations of lines 1 to 3, with a later copy of line 1.
derive(
    "frozen",
    """SELECT source, economic_object_raw, price_value, currency, MIN(observation_id) AS observation_id, l_linenumber AS row_number,
      'frozen province' AS province, '' AS city, 'SINGLE_SERVICE' AS semantic_role, 'LOCAL_SERVICE' AS market_scope,
      'FROZEN' AS matched_services, 'FROZEN_' || CAST(l_linenumber AS STRING) AS canonical_service, '' AS comparability_key,
      'OLD' AS original_comparable_status, 'v1' AS extractor_version
    FROM (SELECT source, economic_object_raw, CASE WHEN price_value LIKE '%.0' THEN REPLACE(price_value, '.0', '') ELSE price_value END AS price_value,
      currency, observation_id, l_linenumber FROM {live_observations}) x WHERE l_linenumber <= 3
    GROUP BY source, economic_object_raw, price_value, currency, l_linenumber""",
)
_LIVE_KEY = "CASE WHEN price_value LIKE '%.0' THEN replace(price_value, '.0', '') ELSE price_value END"


@catalog.query(
    "SEM-02",
    f"""SELECT o.observation_id, f.source IS NOT NULL AS reused, coalesce(f.semantic_role, {_ROLE}) AS semantic_role,
      coalesce(f.canonical_service, {_SERVICE}) AS canonical_service, coalesce(f.province, d.province) AS province,
      coalesce(f.extractor_version, o.extractor_version) AS extractor_version
    FROM {{live_observations}} o JOIN {{live_documents}} d USING (raw_document_id)
    LEFT JOIN (SELECT * FROM {{frozen}} QUALIFY row_number() OVER (PARTITION BY source, economic_object_raw, price_value, currency ORDER BY row_number DESC) = 1) f
      ON f.source = o.source AND f.economic_object_raw = o.economic_object_raw AND f.price_value = {_LIVE_KEY.replace('price_value', 'o.price_value')} AND f.currency = o.currency""",
    observations="live_observations",
    documents="live_documents",
    baseline="frozen",
)
def extended_rows(observations, documents, baseline):
    return se.extend_baseline(observations, documents, baseline, "row_number").select(
        "observation_id", "reused", "semantic_role", "canonical_service", "province", "extractor_version"
    )


@catalog.query(
    "SEM-03",
    """SELECT 'semantic_role' AS dimension, semantic_role AS label, count(*) AS n FROM {observations} GROUP BY 2
      UNION ALL SELECT 'market_scope', market_scope, count(*) FROM {observations} GROUP BY 2
      UNION ALL SELECT 'canonical_service', canonical_service, count(*) FROM {observations} GROUP BY 2""",
    df="observations",
)
def role_counts(df):
    return se.export_counts(df)


# --- meanings -----------------------------------------------------------------------------------

# Per role: (text, expected columns in order of the query below).
_MEANINGS = {
    "PRICE_CONTEXT": (
        ("Ticket premium $ {n}", ("TICKET_TIER", "UNKNOWN", "ARS", None, None, "PRICE_CONTEXT_PARTIAL")),
        ("10,5% OFF por mes en efectivo", ("PAYMENT_DISCOUNT", "PER_MONTH", "", 10.5, None, "PRICE_CONTEXT_UNDERSTOOD")),
        ("Adicional por visita u$s {n} o pesos", ("ADDITIONAL_CHARGE", "PER_VISIT", "USD|ARS", None, None, "PRICE_CONTEXT_UNDERSTOOD")),
        ("Precios por cantidad: 5 equipos", ("QUANTITY_PRICE_TABLE", "PER_UNIT", "", None, "EQUIPMENT_COUNT", "PRICE_CONTEXT_UNDERSTOOD")),
        ("Demora 48 hs", ("TURNAROUND_TIME", "UNKNOWN", "", None, None, "PRICE_CONTEXT_PARTIAL")),
        ("{name}", ("UNKNOWN", "UNKNOWN", "", None, None, "PRICE_CONTEXT_UNKNOWN")),
        ("Precio actual la hora", ("PRICE_CHANGE", "PER_HOUR", "", None, None, "PRICE_CONTEXT_UNDERSTOOD")),
    ),
    "SCOPE_DEVICE": (
        ("Hasta 1,5 TB {name}", ("DATA_CAPACITY_BAND", "", "", 1.5, "TB", "", "SCOPE_UNDERSTOOD")),
        ("Freelance / Taller", ("PROVIDER_DELIVERY_CONTEXT", "", "", None, None, "FREELANCE|WORKSHOP", "SCOPE_UNDERSTOOD")),
        ("Notebook o PC gamer gama media alta", ("DEVICE_PROFILE", "NOTEBOOK|PC", "MID_HIGH|GAMER", None, None, "", "SCOPE_UNDERSTOOD")),
        ("Básica ultra {name}", ("TIER_ONLY", "", "BASIC|PREMIUM", None, None, "", "SCOPE_UNDERSTOOD")),
        ("{name}", ("UNKNOWN", "", "", None, None, "", "SCOPE_UNKNOWN")),
        ("All in one gama media", ("DEVICE_PROFILE", "AIO", "MID", None, None, "", "SCOPE_UNDERSTOOD")),
    ),
    "HARDWARE_PRODUCT": (
        ("Placa de video ASUS RTX 4060 OC 8 GB", ("SINGLE_COMPONENT_FAMILY", "GPU", "ASUS", "OC", "8 GB", "HARDWARE_UNDERSTOOD")),
        ("PC Gamer AMD Ryzen 5 DDR4 16GB SSD 1 TB 500W", ("MULTI_COMPONENT_SYSTEM", "CPU|MEMORY|STORAGE", "AMD", "GAMING", "16GB|1 TB|DDR4|500W", "HARDWARE_UNDERSTOOD")),
        ("Cambio de disco Kingston", ("SERVICE_LIKE_CONFLICT", "STORAGE", "KINGSTON", "", "", "HARDWARE_AMBIGUOUS")),
        ("{name}", ("UNKNOWN", "", "", "", "", "HARDWARE_UNKNOWN")),
    ),
    "NON_OBJECT": (
        ("Precio:", ("PRICE_LABEL", "PRICE_LABEL", "NON_OBJECT_UNDERSTOOD")),
        ("desde", ("PRICING_LOWER_BOUND", "LOWER_BOUND", "NON_OBJECT_UNDERSTOOD")),
        ("$ 0,00", ("ZERO_VALUE_PLACEHOLDER", "ZERO_LITERAL|DO_NOT_OVERRIDE_OBSERVED_PRICE", "NON_OBJECT_UNDERSTOOD")),
        ("Disponible", ("AVAILABILITY_STATUS", "AVAILABLE", "NON_OBJECT_UNDERSTOOD")),
        ("Problemas generales {name}", ("GENERIC_SERVICE_HEADING", "GENERIC_SERVICE_CONTEXT", "NON_OBJECT_UNDERSTOOD")),
        ("Servicio técnico, precio claro", ("MARKETING_SERVICE_COPY", "SERVICE_LANGUAGE|MARKETING_LANGUAGE", "NON_OBJECT_UNDERSTOOD")),
        ("{name}", ("UNKNOWN", "", "NON_OBJECT_UNKNOWN")),
    ),
    "LOGISTICS_CONTEXT": (
        ("Envío en moto dentro de la circunvalación", ("LOCAL_COURIER_DELIVERY", "DELIVERY|MOTORBIKE_COURIER", "", "", "WITHIN_CIRCUNVALACION", "LOGISTICS_UNDERSTOOD")),
        ("Envío a domicilio Andreani", ("HOME_DELIVERY", "DELIVERY", "HOME", "ANDREANI", "", "LOGISTICS_UNDERSTOOD")),
        ("Correo a sucursal OCA", ("BRANCH_DELIVERY", "DELIVERY|POSTAL_COURIER", "BRANCH", "OCA", "", "LOGISTICS_UNDERSTOOD")),
        ("Retiro en Córdoba {name}", ("PICKUP_POINT", "", "PICKUP_POINT", "", "CORDOBA", "LOGISTICS_UNDERSTOOD")),
        ("{name}", ("UNKNOWN", "", "", "", "", "LOGISTICS_UNKNOWN")),
    ),
}
_TEXTS = [(role, text, want) for role, rows in _MEANINGS.items() for text, want in rows]
_SERVICES = (
    ("SINGLE_SERVICE", "Formateo {name}", "FORMATEO", "FORMATEO", "FULLY_REPRESENTED"),
    ("SINGLE_SERVICE", "Arreglo {name}", "", "", "AMBIGUOUS"),
    ("COMPOSITE_SERVICE", "Combo {name}", "", "A|B", "PARTIALLY_UNDERSTOOD"),
    ("COMPOSITE_SERVICE", "Pack {name}", "", "", "CLASSIFIED_ONLY"),
    ("UNMAPPED", "{name}", "", "", "UNKNOWN"),
)
_ALL = [(r, t, "", "") for r, t, _ in _TEXTS] + [(r, t, c, m) for r, t, c, m, _ in _SERVICES]
N_TEXTS = len(_ALL)
_NO = f"(l_partkey + l_linenumber) % {N_TEXTS}"
derive(
    "context_rows",
    f"""SELECT {LINE_ID} AS observation_id, 's' || CAST(l_suppkey AS STRING) AS source, {_NO} AS no,
      CASE {_NO} {_arms(filled(t, name='p_name', n='CAST(l_partkey AS STRING)') for _, t, _, _ in _ALL)} END AS economic_object_raw,
      CASE {_NO} {_arms(quoted(r) for r, *_ in _ALL)} END AS semantic_role,
      CASE {_NO} {_arms(quoted(c) for _, _, c, _ in _ALL)} END AS canonical_service,
      CASE {_NO} {_arms(quoted(m) for *_, m in _ALL)} END AS matched_services,
      'LOCAL_SERVICE' AS market_scope, CASE WHEN l_tax = 0.0 THEN '' ELSE ' Salta ' END AS province, 'v3' AS extractor_version,
      CASE WHEN l_quantity = 1 THEN ' USD ' ELSE '' END AS currency, '1' AS price_value
    FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey""",
)


def _sql_value(value) -> str:
    if value is None:
        return "NULL"
    return quoted(value) if isinstance(value, str) else str(value)


def _expected(role: str, names: tuple[str, ...]) -> str:
    cases = []
    for position, name in enumerate(names):
        arms = " ".join(
            f"WHEN {i} THEN {_sql_value(want[position])}"
            for i, (r, _, want) in enumerate(_TEXTS)
            if r == role
        )
        cases.append(f"CASE no {arms} END AS {name}")
    return f"SELECT observation_id, {', '.join(cases)} FROM {{context_rows}} WHERE semantic_role = '{role}'"


def _of_role(df, role):
    return df.filter(F.col("semantic_role") == role).withColumn(
        "folded", fold(F.col("economic_object_raw"))
    )


@catalog.query(
    "SEM-04",
    _expected("PRICE_CONTEXT", ("kind", "price_scope", "markers", "percent", "quantity_unit", "status")),
    df="context_rows",
)
def price_contexts(df):
    rows = _of_role(df, "PRICE_CONTEXT").withColumn("m", se.price_context(F.col("folded"), F.col("currency")))
    return rows.select(
        "observation_id",
        "m.kind",
        "m.price_scope",
        joined(F.col("m.currency_markers")).alias("markers"),
        "m.percent",
        "m.quantity_unit",
        se.price_context_status(F.col("m")).alias("status"),
    )


@catalog.query(
    "SEM-05",
    _expected("SCOPE_DEVICE", ("kind", "devices", "tiers", "capacity", "unit", "modes", "status")),
    df="context_rows",
)
def scopes(df):
    rows = _of_role(df, "SCOPE_DEVICE").withColumn("m", se.scope_meaning(F.col("folded")))
    return rows.select(
        "observation_id",
        "m.kind",
        joined(F.col("m.device_types")).alias("devices"),
        joined(F.col("m.tiers")).alias("tiers"),
        F.col("m.capacity_max_value").alias("capacity"),
        F.col("m.capacity_unit").alias("unit"),
        joined(F.col("m.delivery_modes")).alias("modes"),
        se.scope_status(F.col("m")).alias("status"),
    )


@catalog.query(
    "SEM-06",
    _expected("HARDWARE_PRODUCT", ("kind", "families", "brands", "variants", "specs", "status")),
    df="context_rows",
)
def hardware(df):
    rows = _of_role(df, "HARDWARE_PRODUCT").withColumn("m", se.hardware_meaning(F.col("folded")))
    return rows.select(
        "observation_id",
        "m.kind",
        *[joined(F.col(f"m.{c}")).alias(c) for c in ("families", "brands", "variants", "specs")],
        se.hardware_status(F.col("m")).alias("status"),
    )


@catalog.query(
    "SEM-07", _expected("NON_OBJECT", ("kind", "signals", "status")), df="context_rows"
)
def non_objects(df):
    rows = _of_role(df, "NON_OBJECT").withColumn("m", se.non_object_meaning(F.col("folded")))
    return rows.select(
        "observation_id",
        "m.kind",
        joined(F.col("m.signals")).alias("signals"),
        se.non_object_status(F.col("m")).alias("status"),
    )


@catalog.query(
    "SEM-08",
    _expected("LOGISTICS_CONTEXT", ("kind", "channels", "destinations", "carriers", "coverage", "status")),
    df="context_rows",
)
def logistics(df):
    rows = _of_role(df, "LOGISTICS_CONTEXT").withColumn("m", se.logistics_meaning(F.col("folded")))
    return rows.select(
        "observation_id",
        "m.kind",
        *[joined(F.col(f"m.{c}")).alias(c) for c in ("channels", "destinations", "carriers", "coverage")],
        se.logistics_status(F.col("m")).alias("status"),
    )


_ROLE_STATUS = " ".join(
    f"WHEN {len(_TEXTS) + i} THEN '{s[4]}'" for i, s in enumerate(_SERVICES)
)
_TYPED_STATUS = " ".join(f"WHEN {i} THEN '{want[-1]}'" for i, (_, _, want) in enumerate(_TEXTS))
_ROLLED = " ".join(
    "WHEN {} THEN '{}'".format(
        i,
        "AMBIGUOUS"
        if "AMBIGUOUS" in want[-1]
        else "UNKNOWN"
        if "UNKNOWN" in want[-1]
        else "PARTIALLY_UNDERSTOOD",
    )
    for i, (_, _, want) in enumerate(_TEXTS)
)


@catalog.query(
    "SEM-09",
    f"""SELECT observation_id, CASE no {_ROLE_STATUS} ELSE 'CLASSIFIED_ONLY' END AS role_status FROM {{context_rows}}""",
    df="context_rows",
)
def role_statuses(df):
    seen = se.semantic_observations(df)
    return seen.select(
        "observation_id",
        se.role_status(F.col("semantic_role"), F.col("canonical_service"), F.col("matched")).alias(
            "role_status"
        ),
    )


derive(
    "raw_semantic_rows",
    """SELECT observation_id, economic_object_raw, canonical_service, matched_services, province, extractor_version, market_scope, no,
      CASE WHEN no = 3 THEN ' ' ELSE source END AS source,
      CASE WHEN no = 1 THEN '' WHEN no = 2 THEN 'NEW_ROLE' ELSE semantic_role END AS semantic_role,
      CASE WHEN no = 4 THEN 'ILLEGAL' ELSE canonical_service END AS canonical_given FROM {context_rows}""",
)


@catalog.query(
    "SEM-10",
    """SELECT observation_id, CASE no WHEN 1 THEN 'Missing required field: semantic_role'
        WHEN 2 THEN 'Unknown semantic_role for observation_id=' || observation_id || ': NEW_ROLE'
        WHEN 3 THEN 'Missing required field: source'
        WHEN 4 THEN 'Only SINGLE_SERVICE observations may carry canonical_service.' END AS reject_reason,
      CASE WHEN trim(province) <> '' THEN 'Salta' END AS province, matched_services AS matched,
      'source=' || trim(source) || ';observation_id=' || observation_id AS observation_origin FROM {raw_semantic_rows}""",
    df="raw_semantic_rows",
)
def validated_observations(df):
    rows = df.withColumn("canonical_service", F.col("canonical_given"))
    return se.semantic_observations(rows).select(
        "observation_id",
        "reject_reason",
        "province",
        joined(F.col("matched")).alias("matched"),
        "observation_origin",
    )


@catalog.query(
    "SEM-11",
    f"""SELECT observation_id, CASE no {_TYPED_STATUS} END AS typed_status,
      CASE no {_ROLE_STATUS} {_ROLLED} END AS understanding_status,
      CASE semantic_role WHEN 'PRICE_CONTEXT' THEN 'PriceContextMeaning' WHEN 'SCOPE_DEVICE' THEN 'ScopeMeaning'
        WHEN 'HARDWARE_PRODUCT' THEN 'HardwareMeaning' WHEN 'NON_OBJECT' THEN 'NonObjectMeaning'
        WHEN 'LOGISTICS_CONTEXT' THEN 'LogisticsMeaning' ELSE '' END AS meaning_type FROM {{context_rows}}""",
    df="context_rows",
)
def understanding(df):
    return se.understand(se.semantic_observations(df)).select(
        "observation_id", "typed_status", "understanding_status", "meaning_type"
    )


_STATUS_COUNTS = ", ".join(
    f"count(*) FILTER (status = '{s}') AS {s.lower()}_rows" for s in UNDERSTANDING_STATUSES
)


@catalog.query(
    "SRC-19",
    f"""SELECT count(*) AS input_rows, count(*) AS output_rows, count(DISTINCT observation_id) AS distinct_ids,
      count(*) = count(DISTINCT observation_id) AS consistent, {_STATUS_COUNTS}
      FROM (SELECT observation_id, CASE no {_ROLE_STATUS} {_ROLLED} END AS status FROM {{context_rows}})""",
    df="context_rows",
)
def understanding_sidecar(df):
    return sidecar_checks(df, sidecar(df, "context_rows", "v1"))


# --- knowledge ----------------------------------------------------------------------------------

# Concept of a part: its type, but one in eight names also has a second concept.
derive(
    "knowledge_rows",
    """SELECT CAST(p_partkey AS STRING) AS observation_id, CASE WHEN p_size = 50 THEN ' ' WHEN p_partkey % 3 = 0 THEN UPPER(p_name) ELSE p_name END AS economic_object_raw,
      CASE WHEN p_size = 49 THEN '' WHEN p_name LIKE 'red%' AND p_size < 5 THEN 'SECOND' ELSE 'C_' || p_name END AS canonical_service,
      CASE WHEN p_size = 48 THEN 'COMPOSITE_SERVICE' ELSE 'SINGLE_SERVICE' END AS semantic_role,
      'LOCAL_SERVICE' AS market_scope, p_brand AS source, p_brand AS provider, CAST(p_retailprice AS STRING) AS price_value, 'ARS' AS currency,
      p_type AS province, p_name, p_size FROM {part}""",
)
_ELIGIBLE = "trim(economic_object_raw) <> '' AND canonical_service <> '' AND semantic_role = 'SINGLE_SERVICE'"
_FOLDED = "lower(trim(economic_object_raw))"
_INDEX = f"""SELECT {_FOLDED} AS folded, count(DISTINCT canonical_service) AS n, min(canonical_service) AS one,
    string_agg(DISTINCT canonical_service, '|' ORDER BY canonical_service) AS concepts FROM {{knowledge_rows}} WHERE {_ELIGIBLE} GROUP BY 1"""


def _aliases(df):
    return kn.seed_aliases(df, "frozen.csv")


catalog.query(
    "KNW-01",
    f"""SELECT canonical_service AS concept_id, min(market_scope) AS concept_type FROM {{knowledge_rows}} WHERE {_ELIGIBLE} GROUP BY 1""",
    df="knowledge_rows",
)(lambda df: kn.seed_concepts(df))
catalog.query(
    "KNW-01-aliases",
    f"""SELECT trim(economic_object_raw) AS expression, canonical_service AS concept_id,
      'frozen.csv:observation_id=' || observation_id AS origin_reference, CAST(observation_id AS BIGINT) AS sort_number
    FROM {{knowledge_rows}} WHERE {_ELIGIBLE}""",
    df="knowledge_rows",
)(lambda df: _aliases(df).select("expression", "concept_id", "origin_reference", "sort_number"))
_SKIP = """CASE WHEN trim(economic_object_raw) = '' THEN 'MISSING_RAW_EXPRESSION' WHEN canonical_service = '' THEN 'MISSING_CANONICAL_SERVICE'
  WHEN semantic_role <> 'SINGLE_SERVICE' THEN 'SEMANTIC_ROLE:' || semantic_role END"""
catalog.query(
    "KNW-02",
    f"""WITH r AS (SELECT *, {_SKIP} AS skip, {_FOLDED} AS folded, trim(economic_object_raw) AS raw FROM {{knowledge_rows}})
    SELECT 'total' AS section, 'total_rows' AS label, count(*) AS value FROM r
    UNION ALL SELECT 'total', 'rows_with_canonical', count(*) FROM r WHERE canonical_service <> ''
    UNION ALL SELECT 'total', 'eligible_alias_rows', count(*) FROM r WHERE skip IS NULL
    UNION ALL SELECT 'total', 'skipped_rows', count(*) FROM r WHERE skip IS NOT NULL
    UNION ALL SELECT 'total', 'unique_aliases', count(DISTINCT folded) FROM r WHERE skip IS NULL
    UNION ALL SELECT 'total', 'unique_concepts', count(DISTINCT canonical_service) FROM r WHERE skip IS NULL
    UNION ALL SELECT 'total', 'duplicate_raw_expressions', count(*) FROM (SELECT raw FROM r WHERE raw <> '' GROUP BY raw HAVING count(*) > 1)
    UNION ALL SELECT 'total', 'duplicate_normalized_expressions', count(*) FROM (SELECT folded FROM r WHERE folded <> '' GROUP BY folded HAVING count(*) > 1)
    UNION ALL SELECT 'total', 'same_expression_multiple_canonical', count(*) FROM (SELECT folded FROM r WHERE folded <> '' AND canonical_service <> '' GROUP BY folded HAVING count(DISTINCT canonical_service) > 1)
    UNION ALL SELECT 'skip_reason', skip, count(*) FROM r WHERE skip IS NOT NULL GROUP BY skip
    UNION ALL SELECT 'role_rows', semantic_role, count(*) FROM r GROUP BY 2
    UNION ALL SELECT 'role_with_canonical', semantic_role, count(*) FILTER (canonical_service <> '') FROM r GROUP BY 2""",
    df="knowledge_rows",
)(lambda df: kn.profile_rows(df))
catalog.query(
    "KNW-03",
    f"""SELECT o.outcome, count(r.outcome) AS n FROM (VALUES ('PARITY'), ('AMBIGUOUS_PRESERVED'), ('MISSING'), ('WRONG_CONCEPT')) o(outcome)
    LEFT JOIN (SELECT CASE WHEN n > 1 THEN 'AMBIGUOUS_PRESERVED' ELSE 'PARITY' END AS outcome
      FROM {{knowledge_rows}} JOIN ({_INDEX}) ON {_FOLDED} = folded WHERE {_ELIGIBLE}) r USING (outcome) GROUP BY 1""",
    df="knowledge_rows",
)(lambda df: kn.parity_audit(df, _aliases(df)))
derive(
    "asked_expressions",
    f"SELECT {LINE_ID} AS id, CASE WHEN l_linenumber = 2 THEN '  ' || UPPER(p_name) ELSE p_name || CASE WHEN l_linenumber = 3 THEN 'x' ELSE '' END END AS expression "
    "FROM {lineitem} JOIN {part} ON l_partkey = p_partkey",
)
catalog.query(
    "KNW-04",
    f"""SELECT id, CASE WHEN n IS NULL THEN 'UNKNOWN' WHEN n = 1 THEN 'RESOLVED' ELSE 'AMBIGUOUS' END AS core_status,
      coalesce(n, 0) AS concepts_n, coalesce(concepts, '') AS concepts
    FROM {{asked_expressions}} LEFT JOIN ({_INDEX}) ON lower(trim(expression)) = folded""",
    asked="asked_expressions",
    df="knowledge_rows",
)(
    lambda asked, df: kn.resolve_expressions(asked, _aliases(df)).select(
        "id", "core_status", "concepts_n", joined(F.col("candidate_concepts")).alias("concepts")
    )
)


catalog.query(
    "KNW-04-candidates",
    f"""SELECT id, canonical_service AS concept_id, trim(economic_object_raw) AS alias_expression,
      'frozen.csv:observation_id=' || observation_id AS origin_reference, 'v4' AS origin_version
    FROM {{asked_expressions}} JOIN {{knowledge_rows}} ON lower(trim(expression)) = {_FOLDED} WHERE {_ELIGIBLE}""",
    asked="asked_expressions",
    df="knowledge_rows",
)(
    lambda asked, df: kn.expression_candidates(
        asked, kn.with_known_concepts(_aliases(df), kn.seed_concepts(df))
    ).select("id", "concept_id", "alias_expression", "origin_reference", "origin_version")
)


@catalog.query(
    "KNW-05",
    f"""SELECT {_FOLDED} AS normalized_expression, canonical_service AS proposed_concept_id, count(*) AS observations_n,
      count(DISTINCT provider) AS providers_n, count(DISTINCT nullif(province, '')) AS provinces_n,
      arg_min(trim(economic_object_raw), (provider, observation_id)) AS expression
    FROM {{knowledge_rows}} WHERE {_ELIGIBLE} GROUP BY 1, 2""",
    df="knowledge_rows",
)
def candidates(df):
    eligible = df.filter(
        (F.trim("economic_object_raw") != "")
        & (F.col("canonical_service") != "")
        & (F.col("semantic_role") == "SINGLE_SERVICE")
    )
    rows = eligible.select(
        F.trim("economic_object_raw").alias("expression"),
        F.lit(kn.PROVIDER_CONTEXT).alias("context"),
        F.col("canonical_service").alias("proposed_concept_id"),
        "observation_id",
        "source",
        "provider",
        "province",
    )
    return kn.aggregate_candidates(rows).drop("context", "status")


derive(
    "shadow_texts",
    """SELECT p_partkey, no, economic_object_raw AS expression, province FROM {new_texts}""",
)
derive(
    "shadow_rows",
    """SELECT CAST(p_partkey AS STRING) AS observation_id, expression AS economic_object_raw, 'SINGLE_SERVICE' AS semantic_role,
      CASE WHEN no = 1 AND p_partkey % 2 = 0 THEN 'FORMATEO_INSTALACION_SO' WHEN no = 2 THEN 'OTHER_CONCEPT'
        WHEN no IN (3, 5) THEN 'C' || CAST(no AS STRING) ELSE '' END AS canonical_service,
      'LOCAL_SERVICE' AS market_scope, 's' AS source, '1' AS price_value, 'ARS' AS currency FROM {shadow_texts}""",
)
catalog.query(
    "KNW-06",
    f"""WITH idx AS (SELECT lower(strip_accents(economic_object_raw)) AS folded, count(DISTINCT canonical_service) AS n, min(canonical_service) AS one
      FROM {{shadow_rows}} WHERE canonical_service <> '' GROUP BY 1),
    t AS (SELECT p_partkey, no, {_SERVICE} AS service, n, one FROM {{shadow_texts}} LEFT JOIN idx ON lower(strip_accents(expression)) = folded)
    SELECT p_partkey, CASE WHEN n > 1 THEN 'CORE_AMBIGUOUS' WHEN no IN (0, 4) THEN 'NOT_COMPARABLE'
      WHEN service <> '' AND n IS NULL THEN 'CORE_UNKNOWN' WHEN service = '' AND n = 1 THEN 'LEGACY_UNKNOWN_CORE_RESOLVED'
      WHEN service <> '' AND service = one THEN 'PARITY' WHEN service <> '' THEN 'LEGACY_RESOLVED_CORE_DIFFERENT' ELSE 'NOT_COMPARABLE' END AS comparison FROM t""",
    texts="shadow_texts",
    rows="shadow_rows",
)(
    lambda texts, rows: kn.shadow_compare(texts, kn.seed_aliases(rows, "seed")).select(
        "p_partkey", "comparison"
    )
)
derive(
    "fresh_rows",
    """SELECT CAST(p_partkey AS STRING) AS observation_id, CASE WHEN p_size < 10 THEN p_name || ' nuevo' WHEN p_size = 50 THEN p_name ELSE p_name END AS economic_object_raw,
      CASE WHEN p_size % 4 = 0 THEN '' WHEN p_size % 4 = 1 THEN 'C_' || p_name ELSE 'Z' END AS canonical_service,
      CASE WHEN p_size % 8 = 0 THEN 'HARDWARE_PRODUCT' ELSE 'SINGLE_SERVICE' END AS semantic_role, '' AS market_scope, p_brand AS source,
      '1' AS price_value, 'ARS' AS currency, p_size, p_name FROM {part}""",
)
catalog.query(
    "KNW-07",
    f"""WITH seed AS (SELECT DISTINCT {_FOLDED} AS folded FROM {{knowledge_rows}} WHERE {_ELIGIBLE}),
    corpus AS (SELECT DISTINCT {_FOLDED} || ' nuevo' AS folded FROM {{knowledge_rows}} WHERE p_size < 5 UNION SELECT folded FROM seed),
    t AS (SELECT f.*, lower(f.economic_object_raw) AS folded, i.n, i.one, s.folded IS NOT NULL AS in_seed, c.folded IS NOT NULL AS in_corpus
      FROM {{fresh_rows}} f LEFT JOIN ({_INDEX}) i ON lower(f.economic_object_raw) = i.folded
      LEFT JOIN seed s ON lower(f.economic_object_raw) = s.folded LEFT JOIN corpus c ON lower(f.economic_object_raw) = c.folded)
    SELECT observation_id, CASE WHEN semantic_role = 'HARDWARE_PRODUCT' AND canonical_service = '' THEN 'NOT_COMPARABLE' WHEN n > 1 THEN 'CORE_AMBIGUOUS'
      WHEN canonical_service <> '' AND n IS NULL THEN CASE WHEN in_corpus AND NOT in_seed THEN 'SEED_SEEN_NON_ALIAS_CORE_UNKNOWN' ELSE 'FRESH_UNSEEN_CANONICAL_CORE_UNKNOWN' END
      WHEN canonical_service = '' AND n = 1 THEN 'CORE_MEMORY_LEGACY_UNKNOWN'
      WHEN canonical_service <> '' AND n = 1 THEN CASE WHEN one <> canonical_service THEN 'SEMANTIC_DISAGREEMENT' WHEN in_seed THEN 'EXACT_MEMORY_REUSE' ELSE 'SHARED_PARITY_ON_FRESH' END
      ELSE 'BOTH_UNKNOWN' END AS reuse_class, in_seed AS seen_seed, in_corpus AS seen_corpus FROM t""",
    fresh="fresh_rows",
    df="knowledge_rows",
)(
    lambda fresh, df: kn.knowledge_reuse(
        fresh,
        _aliases(df),
        _aliases(df).select("expression"),
        _aliases(df)
        .select("expression")
        .union(
            df.filter("p_size < 5").select(F.concat("economic_object_raw", F.lit(" nuevo")))
        ),
    ).select("observation_id", "reuse_class", "seen_seed", "seen_corpus")
)
