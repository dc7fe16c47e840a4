"""Questions derived from orders, parsed, routed and decided.

Each question is one of a set of texts with an amount and a place of its own order; the check
states the expected reading of every text by hand.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from valora.bindings.base import Catalog, derive, dotted, filled, quoted
from valora.functions.rules import joined
from valora.operators import decisions as de
from valora.operators import routes as rt
from valora.operators.questions import parse_questions, several_amounts

catalog = Catalog()

# (text in the question, raw location, province, city)
PLACES = (
    ("rosario", "rosario", "Santa Fe", "Rosario"),
    ("Córdoba", "cordoba", "Córdoba", None),
    ("Mendoza", "mendoza", "Mendoza", None),
    ("la plata", "la plata", "Buenos Aires", "La Plata"),
    ("CABA", "caba", "CABA", None),
)
_U = "UNKNOWN"
# Every value a reading may differ in; the rest of a row is these defaults.
_BASE = dict(
    services="",
    ptype=_U,
    value="NULL",
    low="NULL",
    high="NULL",
    currency=_U,
    approx=False,
    placed=False,
    device=None,
    parts=_U,
    condition=_U,
    side=_U,
    action=_U,
    kind=_U,
    market=_U,
    modality=_U,
    reasons=None,
    several=False,
    confidence=0.95,
    explicit="",
    inferred="",
    derived="",
    need=False,
    question=None,
)
_Q = {
    "several": "Detecté más de un monto en la consulta. ¿Qué importe querés evaluar y a qué unidad de cobro corresponde?",
    "province": "¿En qué provincia se realiza el servicio?",
    "object": "¿Qué servicio o producto tecnológico querés evaluar?",
    "currency": "¿Ese monto está expresado en pesos argentinos o en otra moneda?",
    "need": "Necesito confirmar contexto técnico antes de convertir esto en una decisión económica.",
}
_LOCAL = "canonical_services|market_scope"
_REMOTE = "canonical_services|market_scope|modality"


def _t(text: str, **changes) -> tuple[str, dict]:
    return text, {**_BASE, **changes}


_NEED = dict(
    need=True,
    device="PC",
    reasons="TECHNICAL_NEED_CLARIFICATION_REQUIRED",
    question=_Q["need"],
    confidence=0.8,
    explicit="technical_need.raw_problem",
    derived="technical_need.candidate_routes",
)
TEXTS = (
    _t(
        "me quieren cobrar $ {p} por formatear la notebook en {place}, está bien?",
        services="FORMATEO_INSTALACION_SO", ptype="EXACT", value="p", currency="ARS", placed=True,
        device="NOTEBOOK", side="BUY", action="EVALUATE_PRICE", kind="SERVICE", market="LOCAL",
        explicit="price|geography.raw_location|device_type", inferred="price.currency", derived=_LOCAL,
    ),
    _t(
        "cuánto puedo cobrar por soporte remoto?",
        services="SOPORTE_REMOTO", side="SELL", action="SUGGEST_PRICE", kind="SERVICE",
        market="REMOTE_NATIONAL", modality="REMOTE", derived=_REMOTE,
    ),
    _t(
        "cuanto sale armar una pc en {place}",
        services="ARMADO_PC", placed=True, device="PC", action="MARKET_REFERENCE", kind="SERVICE",
        market="LOCAL", explicit="geography.raw_location|device_type", derived=_LOCAL,
    ),
    _t(
        "me pasaron {k} lucas la hora por desarrollo web",
        services="DESARROLLO_SOFTWARE_HORA", ptype="PER_HOUR", value="k * 1000", currency="ARS", side="BUY",
        action="EVALUATE_PRICE", kind="SERVICE", market="REMOTE_NATIONAL", modality="REMOTE",
        explicit="price", inferred="price.currency", derived=_REMOTE,
    ),
    _t(
        "entre {k} y {k2} lucas por limpieza de notebook en {place}, es caro?",
        services="LIMPIEZA_MANTENIMIENTO", ptype="RANGE", low="k * 1000", high="(k + 5) * 1000", currency="ARS",
        placed=True, device="NOTEBOOK", action="EVALUATE_PRICE", kind="SERVICE", market="LOCAL",
        explicit="price|geography.raw_location|device_type", inferred="price.currency", derived=_LOCAL,
    ),
    _t(
        "me cobran {k} usd por hosting",
        services="HOSTING_ADMINISTRADO", ptype="EXACT", value="k", currency="USD", side="BUY",
        action="EVALUATE_PRICE", kind="SERVICE", market="REMOTE_NATIONAL", modality="REMOTE",
        explicit="price", derived=_REMOTE,
    ),
    _t(
        "cambio de pantalla de notebook {plain} en {place}",
        services="REPARACION_HARDWARE", ptype="EXACT", value="p", placed=True, device="NOTEBOOK", kind="SERVICE",
        market="LOCAL", reasons="UNKNOWN_CURRENCY|UNKNOWN_PARTS_SCOPE", question=_Q["currency"], confidence=0.55,
        explicit="price|geography.raw_location|device_type", derived=_LOCAL,
    ),
    _t(
        "formateo y backup de pc a domicilio",
        services="FORMATEO_INSTALACION_SO|BACKUP_DATOS", device="PC", kind="BUNDLE", market="LOCAL",
        modality="ONSITE", reasons="MISSING_PROVINCE|BUNDLE_REQUIRES_COMPARABLE_SCOPE", question=_Q["province"],
        confidence=0.55, explicit="device_type|modality", derived=_LOCAL,
    ),
    _t(
        "vendo notebook usada con ssd a $ {p}",
        ptype="EXACT", value="p", currency="ARS", device="NOTEBOOK", condition="USED", side="SELL",
        action="EVALUATE_PRICE", kind="HARDWARE", market="GOODS", explicit="price|device_type",
        inferred="price.currency",
    ),
    _t(
        "hola, ¿qué tal?", reasons="UNKNOWN_ECONOMIC_OBJECT", question=_Q["object"], confidence=0.35,
    ),
    _t(
        "me piden $ {p} o {k} lucas por eliminar virus en {place}",
        services="ELIMINACION_MALWARE", ptype="EXACT", value="k * 1000", currency="ARS", placed=True, side="BUY",
        action="EVALUATE_PRICE", kind="SERVICE", market="LOCAL", several=True,
        reasons="MULTIPLE_MONETARY_MENTIONS", question=_Q["several"], confidence=0.70,
        explicit="price|geography.raw_location", inferred="price.currency", derived=_LOCAL,
    ),
    _t(
        "precio de visita técnica en {place}",
        services="VISITA_TECNICA_DOMICILIO", placed=True, action="MARKET_REFERENCE", kind="SERVICE",
        market="LOCAL", explicit="geography.raw_location", derived=_LOCAL,
    ),
    _t(
        "estoy instalando windows 11 y se queda en 35%, qué puede estar pasando? soy de {place}",
        placed=True, **_NEED,
    ),
    _t("quise instalar windows 10 y quedó congelado, por qué?", **_NEED),
    _t(
        "compraré una rtx 4060 nueva, me ofrecieron una por un palo",
        ptype="EXACT", value="1000000", currency="ARS", device="GPU", condition="NEW", side="BUY",
        action="EVALUATE_PRICE", kind="HARDWARE", market="GOODS", explicit="price|device_type",
        inferred="price.currency",
    ),
    _t(
        "comparar soporte remoto por mes",
        services="SOPORTE_REMOTO", action="COMPARE", kind="SERVICE", market="REMOTE_NATIONAL",
        modality="REMOTE", derived=_REMOTE,
    ),
    _t(
        "cambiar el teclado, ya tengo el repuesto, lo llevo al local en {place}, me presupuestaron aprox {k} mil por visita",
        services="REPARACION_HARDWARE", ptype="PER_VISIT", value="k * 1000", currency="ARS", approx=True, placed=True,
        parts="USER_PROVIDED", side="BUY", action="EVALUATE_PRICE", kind="SERVICE", market="LOCAL",
        modality="WORKSHOP", explicit="price|geography.raw_location|modality", inferred="price.currency",
        derived=_LOCAL,
    ),
    _t(
        "necesito 20 cámaras de seguridad en {place}",
        services="CCTV_INSTALACION_MANO_OBRA", placed=True, kind="SERVICE", market="LOCAL", confidence=0.80,
        explicit="geography.raw_location", derived=_LOCAL,
    ),
    _t(
        "me dijeron $ {p} por soporte remoto por hora, fuera de horario",
        services="SOPORTE_REMOTO", ptype="EXACT", value="p", currency="ARS", side="BUY", action="EVALUATE_PRICE",
        kind="SERVICE", market="REMOTE_NATIONAL", modality="REMOTE", explicit="price",
        inferred="price.currency", derived=_REMOTE,
    ),
)
N = len(TEXTS)


def _arms(values) -> str:
    return " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))


_TEXT = _arms(
    filled(t, p=dotted("p"), plain="CAST(p AS STRING)", k="CAST(k AS STRING)", k2="CAST(k + 5 AS STRING)", place="place")
    for t, _ in TEXTS
)
derive(
    "questions",
    f"""SELECT o_orderkey, no, spot, p, k, CASE no {_TEXT} END AS text FROM (
      SELECT o_orderkey, o_orderkey % {N} AS no, o_custkey % {len(PLACES)} AS spot,
        CAST(FLOOR(o_totalprice) AS BIGINT) + 2000 AS p, CAST(FLOOR(o_totalprice / 10000) AS BIGINT) + 10 AS k,
        CASE o_custkey % {len(PLACES)} {_arms(quoted(p[0]) for p in PLACES)} END AS place FROM {{orders}}) q""",
)


def _v(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    return quoted(value) if isinstance(value, str) else str(value)


def _col(name: str, raw: bool = False) -> str:
    return f"CASE no {_arms(e[name] if raw else _v(e[name]) for _, e in TEXTS)} END"


def _place(index: int) -> str:
    return f"CASE WHEN {_col('placed')} THEN CASE spot {_arms(_v(p[index]) for p in PLACES)} END END"


def _check(*columns: str) -> str:
    return f"SELECT o_orderkey, {', '.join(columns)} FROM {{questions}}"


def _parsed(name: str, sql: str):
    def register(columns):
        catalog.query(name, sql, df="questions")(
            lambda df: parse_questions(df).select("o_orderkey", *columns())
        )

    return register


_parsed("QRY-01", _check(f"{_col('services')} AS services"))(
    lambda: [joined(F.col("canonical_services")).alias("services")]
)
_parsed(
    "QRY-02",
    _check(
        f"{_place(1)} AS raw_location",
        f"{_place(2)} AS province",
        f"{_place(3)} AS city",
    ),
)(lambda: ["geography.raw_location", "geography.province", "geography.city"])
_parsed("QRY-03", _check(f"{_col('device')} AS device_type"))(lambda: ["device_type"])
_parsed("QRY-04", _check(f"{_col('parts')} AS parts_scope"))(lambda: ["parts_scope"])
_parsed(
    "QRY-05",
    _check(
        f"{_col('ptype')} AS type",
        f"({_col('value', True)})::DOUBLE AS value",
        f"({_col('low', True)})::DOUBLE AS min",
        f"({_col('high', True)})::DOUBLE AS max",
        f"{_col('currency')} AS currency",
        f"{_col('approx')} AS is_approximate",
    ),
)(lambda: ["price.type", "price.value", "price.min", "price.max", "price.currency", "price.is_approximate"])

# Bare numbers next to units, models and words.
_BARE = (
    ("hace {k} días que espero", False),
    ("tengo {k} GB de datos", False),
    ("una rtx {plain} en buen estado", False),
    ("son {plain} por todo", True),
    ("{plain} en total, {k} horas", True),
    ("ninguno", False),
)
derive(
    "bare_numbers",
    f"""SELECT o_orderkey, no, p, CASE no {_arms(filled(t, plain='CAST(p AS STRING)', k='CAST(k AS STRING)') for t, _ in _BARE)} END AS text
      FROM (SELECT o_orderkey, o_orderkey % {len(_BARE)} AS no, CAST(FLOOR(o_totalprice) AS BIGINT) + 2000 AS p, o_orderkey % 80 + 10 AS k FROM {{orders}}) q""",
)
catalog.query(
    "QRY-06",
    f"SELECT o_orderkey, (CASE WHEN CASE no {_arms(_v(b) for _, b in _BARE)} END THEN p END)::DOUBLE AS value FROM {{bare_numbers}}",
    df="bare_numbers",
)(lambda df: parse_questions(df).select("o_orderkey", "price.value"))
catalog.query(
    "QRY-07", _check(f"{_col('several')} AS several"), df="questions"
)(lambda df: df.select("o_orderkey", several_amounts(F.col("text")).alias("several")))
_parsed(
    "QRY-08", _check(f"{_col('side')} AS intent_side", f"{_col('action')} AS intent_action")
)(lambda: ["intent_side", "intent_action"])
_parsed(
    "QRY-09",
    _check(
        f"{_col('kind')} AS economic_object_kind",
        f"{_col('market')} AS market_scope",
        f"{_col('modality')} AS modality",
        f"{_col('condition')} AS condition",
    ),
)(lambda: ["economic_object_kind", "market_scope", "modality", "condition"])
_BLOCKED = f"{_col('question')} IS NOT NULL"
_parsed(
    "QRY-10",
    _check(
        f"{_col('reasons')} AS clarification_reason",
        f"{_col('question')} AS clarification_question",
        f"{_BLOCKED} AS clarification_required",
        f"({_col('confidence')})::DOUBLE AS confidence",
    ),
)(
    lambda: [
        "clarification_reason",
        "clarification_question",
        "clarification_required",
        "confidence",
    ]
)
_parsed(
    "QRY-11",
    _check(
        f"CASE WHEN {_col('need')} THEN 'TECHNICAL_NEED' ELSE 'ECONOMIC_QUERY' END AS query_kind",
        f"CASE WHEN {_col('need')} THEN 'DIAGNOSTIC_SERVICE|OS_INSTALLATION_SERVICE|HARDWARE_DIAGNOSTIC' END AS routes",
    ),
)(lambda: ["query_kind", joined(F.col("technical_need.candidate_routes")).alias("routes")])
_CITY = f"{_place(3)} IS NOT NULL AND NOT {_col('need')}"
_parsed(
    "QRY-12",
    _check(
        f"{_col('explicit')} AS explicit_fields",
        f"{_col('inferred')} || CASE WHEN {_CITY} THEN CASE WHEN {_col('inferred')} = '' THEN '' ELSE '|' END || 'geography.province' ELSE '' END AS inferred_fields",
        f"{_col('derived')} AS derived_fields",
    ),
)(
    lambda: [
        joined(F.col(c)).alias(c) for c in ("explicit_fields", "inferred_fields", "derived_fields")
    ]
)

# --- routes ---------------------------------------------------------------------------------

_NEEDS = f"(SELECT *, {_place(2)} AS province FROM {{questions}} WHERE {_col('need')})"
_ROUTES = f"""SELECT o_orderkey, province, route, CASE route WHEN 'DIAGNOSTIC_SERVICE' THEN 'DIAGNOSTICO_REVISION'
    WHEN 'OS_INSTALLATION_SERVICE' THEN 'FORMATEO_INSTALACION_SO' END AS service
  FROM {_NEEDS}, (VALUES ('DIAGNOSTIC_SERVICE'), ('OS_INSTALLATION_SERVICE'), ('HARDWARE_DIAGNOSTIC')) r(route)"""
catalog.query(
    "QRY-13",
    f"""SELECT o_orderkey, route, CASE WHEN service IS NULL THEN 'UNRESOLVED' ELSE 'RESOLVED' END AS route_status,
      service AS canonical_service, CASE WHEN service IS NOT NULL THEN province END AS market,
      CASE WHEN service IS NULL THEN 'UNRESOLVED' WHEN province IS NULL THEN 'MISSING_PROVINCE' ELSE 'READY' END AS market_status,
      CASE WHEN service IS NOT NULL AND province IS NOT NULL THEN province || '::' || service END AS market_key
    FROM ({_ROUTES})""",
    df="questions",
)(
    lambda df: rt.technical_routes(parse_questions(df)).select(
        "o_orderkey",
        "route",
        "route_status",
        "canonical_service",
        "market",
        "market_status",
        "market_key",
    )
)
_READY = "service IS NOT NULL AND province IS NOT NULL"
_READINESS = f"CASE WHEN service IS NULL THEN 'UNRESOLVED_ROUTE' WHEN province IS NULL THEN 'MISSING_PROVINCE' ELSE 'READY_FOR_PRICING' END"
catalog.query(
    "QRY-14",
    f"SELECT o_orderkey, route, {_READY} AS ready, {_READINESS} AS readiness_status FROM ({_ROUTES})",
    df="questions",
)(
    lambda df: rt.pricing_readiness(rt.technical_routes(parse_questions(df))).select(
        "o_orderkey", "route", "ready", "readiness_status"
    )
)

# Cohorts for every (province, service) asked about, built from the customers of a nation.
_MARKETS = ("Santa Fe", "Córdoba", "Mendoza", "Buenos Aires", "AR")
_SERVICES = (
    "FORMATEO_INSTALACION_SO",
    "DIAGNOSTICO_REVISION",
    "ARMADO_PC",
    "SOPORTE_REMOTO",
    "DESARROLLO_SOFTWARE_HORA",
    "VISITA_TECNICA_DOMICILIO",
    "LIMPIEZA_MANTENIMIENTO",
    "REPARACION_HARDWARE",
)
derive(
    "question_cohorts",
    f"""SELECT market_scope, market, canonical_service, price_scope, 'STANDARD' AS commercial_context, COUNT(*) AS observations_n, COUNT(*) AS providers_n,
      MIN(b) AS min_ars, MIN(b) + (MAX(b) - MIN(b)) * 0.25 AS q1_ars, MIN(b) + (MAX(b) - MIN(b)) * 0.5 AS median_ars,
      MIN(b) + (MAX(b) - MIN(b)) * 0.75 AS q3_ars, MAX(b) AS max_ars, MAX(g) AS grade,
      CASE WHEN MAX(g) = 0 THEN 'MEDIUM' WHEN MAX(g) = 1 THEN 'LOW' ELSE 'INSUFFICIENT' END AS evidence_confidence,
      MAX(g) = 0 AS decision_ready, MAX(g) < 2 AS range_ready
    FROM (SELECT CASE c_nationkey % 5 {_arms(quoted(m) for m in _MARKETS)} END AS market,
        CASE WHEN c_nationkey % 5 = 4 THEN 'REMOTE_NATIONAL_SERVICE' ELSE 'LOCAL_SERVICE' END AS market_scope,
        CASE c_custkey % 8 {_arms(quoted(s) for s in _SERVICES)} END AS canonical_service,
        CASE c_custkey % 8 WHEN 3 THEN 'PER_MONTH' WHEN 4 THEN 'PER_HOUR' WHEN 7 THEN 'PER_VISIT' ELSE 'UNKNOWN' END AS price_scope,
        CAST(FLOOR(c_acctbal) AS BIGINT) * 30 + 40000.0 AS b, (c_nationkey + c_custkey % 8) % 5 % 3 AS g FROM {{customer}}) x
    GROUP BY market_scope, market, canonical_service, price_scope""",
)
catalog.query(
    "QRY-15",
    f"""SELECT o_orderkey, route, CASE WHEN NOT ({_READY}) THEN 'NOT_PROBED' WHEN c.range_ready THEN 'EVIDENCE_AVAILABLE'
        WHEN c.market IS NOT NULL THEN 'INSUFFICIENT_EVIDENCE' ELSE 'NO_EVIDENCE' END AS probe_status,
      CASE WHEN NOT ({_READY}) THEN {_READINESS} WHEN c.range_ready THEN 'RANGE_READY' WHEN c.market IS NOT NULL THEN 'INSUFFICIENT_EVIDENCE' ELSE 'NO_EVIDENCE' END AS probe_reason,
      coalesce(c.observations_n, 0) AS observations_n, c.median_ars
    FROM ({_ROUTES}) r LEFT JOIN {{question_cohorts}} c ON {_READY} AND c.market = province AND c.canonical_service = service
      AND c.market_scope = 'LOCAL_SERVICE' AND c.price_scope = 'UNKNOWN'""",
    df="questions",
    cohorts="question_cohorts",
)(
    lambda df, cohorts: rt.probe_evidence(
        rt.pricing_readiness(rt.technical_routes(parse_questions(df))), cohorts
    ).select("o_orderkey", "route", "probe_status", "probe_reason", "observations_n", "median_ars")
)

# --- decisions ---------------------------------------------------------------------------------

_SCOPE = f"""CASE WHEN {_col('ptype')} LIKE 'PER_%' THEN {_col('ptype')} WHEN no = 15 THEN 'PER_MONTH' WHEN no = 18 THEN 'PER_HOUR' ELSE 'UNKNOWN' END"""
_RESOLVED = f"""WITH q AS (SELECT o_orderkey, no, {_col('need')} AS need, {_BLOCKED} AS blocked, {_col('services')} AS service, {_col('kind')} AS kind,
    {_col('market')} AS scope, CASE WHEN {_col('market')} = 'LOCAL' THEN {_place(2)} WHEN {_col('market')} = 'REMOTE_NATIONAL' THEN 'AR' END AS place,
    CASE WHEN {_col('market')} = 'LOCAL' THEN 'LOCAL_SERVICE' ELSE 'REMOTE_NATIONAL_SERVICE' END AS cohort_scope, {_SCOPE} AS price_scope,
    CASE WHEN no = 18 THEN 'URGENCY' ELSE 'STANDARD' END AS ctx, {_col('action')} AS action, {_col('currency')} AS currency,
    CASE WHEN {_col('action')} = 'EVALUATE_PRICE' THEN {_col('value', True)} END AS price, {_place(2)} AS province, {_col('reasons')} AS reasons, {_col('question')} AS question
    FROM {{questions}}),
  j AS (SELECT q.*, c.* EXCLUDE (market_scope, market, canonical_service, price_scope, commercial_context),
      EXISTS (SELECT 1 FROM {{question_cohorts}} k WHERE k.market_scope = q.cohort_scope AND k.market = q.place AND k.canonical_service = q.service
        AND k.commercial_context = q.ctx AND k.price_scope <> 'UNKNOWN') AS cadences
    FROM q LEFT JOIN {{question_cohorts}} c ON c.market_scope = q.cohort_scope AND c.market = q.place AND c.canonical_service = q.service
      AND c.price_scope = q.price_scope AND c.commercial_context = q.ctx),
  s AS (SELECT *, CASE WHEN need THEN 'TECHNICAL_NEED_ROUTED' WHEN blocked THEN 'CLARIFICATION_REQUIRED'
      WHEN service = '' OR service LIKE '%|%' OR kind <> 'SERVICE' THEN 'UNSUPPORTED_QUERY'
      WHEN price_scope = 'UNKNOWN' AND cadences THEN 'CLARIFICATION_REQUIRED'
      WHEN action = 'EVALUATE_PRICE' AND (currency <> 'ARS' OR price IS NULL) THEN 'UNSUPPORTED_QUERY'
      WHEN action NOT IN ('EVALUATE_PRICE', 'SUGGEST_PRICE', 'MARKET_REFERENCE') THEN 'UNSUPPORTED_QUERY'
      WHEN range_ready IS NULL THEN 'NO_EVIDENCE' WHEN NOT range_ready THEN 'INSUFFICIENT_EVIDENCE'
      WHEN NOT decision_ready OR price IS NULL THEN 'RANGE_READY' ELSE 'DECISION_READY' END AS status,
    CASE WHEN need OR blocked THEN NULL WHEN service = '' OR service LIKE '%|%' THEN 'SINGLE_CANONICAL_SERVICE_REQUIRED'
      WHEN price_scope = 'UNKNOWN' AND cadences THEN NULL WHEN action = 'EVALUATE_PRICE' AND currency <> 'ARS' THEN 'ARS_ONLY_V1'
      WHEN action = 'EVALUATE_PRICE' AND price IS NULL THEN 'EXACT_PRICE_REQUIRED_FOR_EVALUATION'
      WHEN action NOT IN ('EVALUATE_PRICE', 'SUGGEST_PRICE', 'MARKET_REFERENCE') THEN 'UNSUPPORTED_INTENT' END AS refusal,
    CASE WHEN need AND province IS NULL THEN 'MISSING_PROVINCE_FOR_LOCAL_MARKET' WHEN need OR blocked THEN reasons
      WHEN service <> '' AND price_scope = 'UNKNOWN' AND cadences THEN 'PRICE_SCOPE_REQUIRED' END AS clarification,
    CASE WHEN decision_ready AND price IS NOT NULL THEN CASE WHEN price < q1_ars THEN 'BAJO' WHEN price > q3_ars THEN 'ALTO' ELSE 'RAZONABLE' END END AS label
    FROM j)"""
_ANSWERED = "status IN ('NO_EVIDENCE', 'INSUFFICIENT_EVIDENCE', 'RANGE_READY', 'DECISION_READY')"


def _resolved(df, cohorts):
    return rt.resolve_questions(parse_questions(df), cohorts)


catalog.query(
    "DEC-02",
    f"""{_RESOLVED} SELECT o_orderkey, status, refusal AS unsupported_reason, clarification AS clarification_reason,
      CASE WHEN {_ANSWERED} THEN label END AS decision_label, CASE WHEN {_ANSWERED} THEN place END AS market,
      CASE WHEN {_ANSWERED} THEN median_ars END AS median_ars FROM s""",
    df="questions",
    cohorts="question_cohorts",
)(
    lambda df, cohorts: _resolved(df, cohorts).select(
        "o_orderkey",
        "status",
        "unsupported_reason",
        "clarification_reason",
        "decision_label",
        "market",
        "median_ars",
    )
)


def _money(column: str) -> str:
    return f"'$' || ({dotted(f'CAST(round_even({column}, 0) AS BIGINT)')})"


catalog.query(
    "DEC-03",
    f"""{_RESOLVED} SELECT o_orderkey, CASE status WHEN 'CLARIFICATION_REQUIRED' THEN 'Necesito una aclaración' WHEN 'UNSUPPORTED_QUERY' THEN 'Todavía no puedo comparar esta consulta'
        WHEN 'RANGE_READY' THEN 'Rango de mercado disponible' WHEN 'INSUFFICIENT_EVIDENCE' THEN 'Evidencia insuficiente' WHEN 'NO_EVIDENCE' THEN 'Sin evidencia comparable'
        WHEN 'DECISION_READY' THEN label ELSE 'Sin evidencia disponible' END AS headline,
      CASE WHEN status IN ('RANGE_READY', 'DECISION_READY', 'INSUFFICIENT_EVIDENCE') THEN 'Rango observado ' || {_money('min_ars')} || '–' || {_money('max_ars')} || '; mediana ' ||
        {_money('median_ars')} || '; ' || CAST(observations_n AS VARCHAR) || ' precios de ' || CAST(providers_n AS VARCHAR) || ' proveedores.' END AS evidence_line,
      CASE status WHEN 'CLARIFICATION_REQUIRED' THEN clarification WHEN 'UNSUPPORTED_QUERY' THEN refusal
        WHEN 'INSUFFICIENT_EVIDENCE' THEN 'La decisión se retiene en lugar de sobreinterpretar la muestra.'
        WHEN 'RANGE_READY' THEN 'Confianza de evidencia: ' || evidence_confidence || '.' WHEN 'DECISION_READY' THEN 'Confianza de evidencia: ' || evidence_confidence || '.' END AS caveat
    FROM s""",
    df="questions",
    cohorts="question_cohorts",
)(
    lambda df, cohorts: _resolved(df, cohorts)
    .withColumns(de.explain_decision())
    .select("o_orderkey", "headline", "evidence_line", "caveat")
)

# --- audit --------------------------------------------------------------------------------------

# Adjudicated cases: some are wrong on purpose so that every outcome occurs.
derive(
    "adjudicated",
    f"""SELECT o_orderkey AS case_key, CASE WHEN no IN (6, 7, 10) THEN 'CLARIFICATION' WHEN no IN (8, 14, 15) THEN 'SAFE_UNSUPPORTED' ELSE 'PARSE' END AS expected_behavior,
      CAST(NULL AS STRING) AS expected_status, spot <> 1 AS allow_decision, CASE WHEN no = 6 THEN 'SELL' WHEN no = 10 THEN 'BUY' END AS expected_intent_side
    FROM {{questions}}""",
)
catalog.query(
    "AGG-21",
    f"""{_RESOLVED}, o AS (SELECT CASE WHEN status = 'DECISION_READY' AND NOT allow_decision THEN 'UNSAFE_DECISION'
      WHEN expected_behavior = 'CLARIFICATION' AND status <> 'CLARIFICATION_REQUIRED' THEN 'WRONG_INTERPRETATION'
      WHEN expected_behavior = 'SAFE_UNSUPPORTED' AND status <> 'UNSUPPORTED_QUERY' THEN 'WRONG_INTERPRETATION'
      WHEN expected_behavior = 'PARSE' AND status IN ('CLARIFICATION_REQUIRED', 'UNSUPPORTED_QUERY') THEN 'WRONG_INTERPRETATION'
      WHEN no = 6 THEN 'WRONG_INTERPRETATION' WHEN expected_behavior = 'CLARIFICATION' THEN 'CLARIFICATION_CORRECT'
      WHEN expected_behavior = 'SAFE_UNSUPPORTED' THEN 'SAFE_UNSUPPORTED' ELSE 'PARSE_CORRECT' END AS audit_outcome
      FROM s JOIN {{adjudicated}} ON o_orderkey = case_key)
    SELECT audit_outcome, count(*) AS n FROM o GROUP BY 1""",
    df="questions",
    cohorts="question_cohorts",
    expected="adjudicated",
)(
    lambda df, cohorts, expected: rt.audit_questions(
        _resolved(df, cohorts), expected.withColumnRenamed("case_key", "o_orderkey"), "o_orderkey"
    )
    .groupBy("audit_outcome")
    .agg(F.count(F.lit(1)).alias("n"))
)
