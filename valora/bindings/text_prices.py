"""Text and price functions over documents, names and price literals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valora.bindings.base import Catalog, cadence_sql, context_sql, derive, dotted
from valora.functions import price as pr
from valora.functions import text as tx

catalog = Catalog()

# --- text --------------------------------------------------------------------------------------

_FOLD = "lower(strip_accents(text))"
catalog.query(
    "TXT-01",
    f"""SELECT doc_id, sha256(trim(regexp_replace({_FOLD}, '\\s+', ' ', 'g'))) AS folded,
      sha256(trim(regexp_replace({_FOLD}, '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), ' ' || chr(9) || chr(10) || chr(13))) AS folded_plain
    FROM documents""",
    df="documents",
)(
    lambda df: df.select(
        "doc_id",
        F.sha2(tx.fold(F.col("text")), 256).alias("folded"),
        F.sha2(tx.fold_plain(F.col("text")), 256).alias("folded_plain"),
    )
)

derive(
    "badged",
    "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Más Popular ' || text "
    "ELSE text || '  MAS  POPULAR' END AS text FROM {documents}",
)
catalog.query(
    "TXT-02",
    f"""SELECT doc_id, sha256(trim(regexp_replace(regexp_replace({_FOLD},
      '\\bmas\\s+popular\\b', ' ', 'g'), '\\s+', ' ', 'g'))) AS clean FROM {{badged}}""",
    df="badged",
)(lambda df: df.select("doc_id", F.sha2(tx.without_badges(F.col("text")), 256).alias("clean")))

derive(
    "companies",
    """SELECT s_suppkey, CASE s_suppkey % 6
      WHEN 0 THEN 'SUPPLIER ' || CAST(s_suppkey AS STRING) || ' S.A.'
      WHEN 1 THEN '  informática álvarez ' || CAST(s_suppkey AS STRING) || ' S.R.L.'
      WHEN 2 THEN 'TecnoPlus IT ' || CAST(s_suppkey AS STRING) || 'x'
      WHEN 3 THEN 'soluciones it SAS'
      WHEN 4 THEN 'Grupo "Norte", IT'
      ELSE s_name END AS company_raw,
    CASE s_suppkey % 4 WHEN 0 THEN ' CORDOBA ' WHEN 1 THEN 'Cordoba Capital' WHEN 2 THEN n_name
      ELSE 'Salta ' END AS province_raw,
    CASE s_suppkey % 4 WHEN 0 THEN 'CBA.' WHEN 1 THEN 'ciudad de córdoba' WHEN 2 THEN n_name
      ELSE ' Rosario' END AS city_raw
    FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey""",
)
COMPANY_SQL = """CASE s_suppkey % 6
      WHEN 0 THEN 'Supplier ' || CAST(s_suppkey AS VARCHAR)
      WHEN 1 THEN 'Informatica Alvarez ' || CAST(s_suppkey AS VARCHAR)
      WHEN 2 THEN 'TecnoPlus IT ' || upper(left(CAST(s_suppkey AS VARCHAR), 1)) || substr(CAST(s_suppkey AS VARCHAR), 2) || 'x'
      WHEN 3 THEN 'Soluciones It'
      WHEN 4 THEN 'Grupo Norte IT'
      ELSE replace(company_raw, '#', '') END"""
PROVINCE_SQL = "CASE WHEN s_suppkey % 4 < 2 THEN 'Córdoba' ELSE trim(province_raw) END"
CITY_SQL = "CASE WHEN s_suppkey % 4 < 2 THEN 'Córdoba' ELSE trim(city_raw) END"
catalog.query(
    "TXT-03",
    f"SELECT s_suppkey, {COMPANY_SQL} AS company FROM {{companies}}",
    df="companies",
)(lambda df: df.select("s_suppkey", tx.company_name(F.col("company_raw")).alias("company")))
catalog.query(
    "TXT-04",
    f"SELECT s_suppkey, {PROVINCE_SQL} AS province, {CITY_SQL} AS city FROM {{companies}}",
    df="companies",
)(
    lambda df: df.select(
        "s_suppkey",
        tx.province_name(F.col("province_raw")).alias("province"),
        tx.city_name(F.col("city_raw")).alias("city"),
    )
)

SERVICE_TEXTS = (
    ("'Formateo e instalación de SO'", "formateo"),
    ("'Limpieza de virus ' || p_name", "malware"),
    ("'Mantenimiento PC ' || p_name", "mantenimiento"),
    ("'Configurar ROUTER ' || p_name", "soporte_redes"),
    ("'Mesa de ayuda ' || p_name", "soporte_tecnico"),
    ("p_name", "DESCONOCIDO"),
    ("'Instalar Windows 11 y antivirus'", "malware"),
    ("'Asistencia tecnica'", "soporte_tecnico"),
)
_ARMS = " ".join(f"WHEN {i} THEN {t}" for i, (t, _) in enumerate(SERVICE_TEXTS))
derive(
    "service_texts",
    f"SELECT p_partkey, p_partkey % 8 AS kind, CASE p_partkey % 8 {_ARMS} END AS text FROM {{part}}",
)
SERVICE_SQL = "CASE kind " + " ".join(
    f"WHEN {i} THEN '{s}'" for i, (_, s) in enumerate(SERVICE_TEXTS)
) + " END"
catalog.query(
    "TXT-05",
    f"SELECT p_partkey, {SERVICE_SQL} AS service FROM {{service_texts}}",
    df="service_texts",
)(lambda df: df.select("p_partkey", tx.catalog_service(F.col("text")).alias("service")))
catalog.query(
    "TXT-06",
    f"""SELECT p_partkey, CASE WHEN kind = 5 THEN 'desconocido' ELSE 'soporte_tecnico' END AS category,
      CASE WHEN kind = 5 THEN 'desconocido' ELSE {SERVICE_SQL} END AS subcategory,
      CASE kind WHEN 0 THEN 'Formateo e instalación de SO' WHEN 2 THEN 'Mantenimiento preventivo'
        WHEN 3 THEN 'Diagnóstico y soporte de redes' WHEN 5 THEN text
        WHEN 4 THEN 'Soporte Técnico Informático' WHEN 7 THEN 'Soporte Técnico Informático'
        ELSE 'Eliminación de Malware y Virus' END AS name,
      CASE WHEN kind = 5 THEN 0.0 ELSE 0.95 END::DOUBLE AS confidence FROM {{service_texts}}""",
    df="service_texts",
)(lambda df: df.select("p_partkey", tx.catalog_detail(F.col("text")).alias("d")).select("p_partkey", "d.*"))
catalog.query(
    "TXT-07",
    """SELECT p_partkey, kind IN (0, 7) OR (kind = 5 AND p_partkey % 16 = 5)
         OR (kind NOT IN (0, 5, 7) AND kind IN (1, 6)) AS same FROM {service_texts}""",
    df="service_texts",
)(
    lambda df: df.select(
        "p_partkey",
        tx.same_service(
            F.col("text"),
            F.when(F.col("kind") == 0, "FORMATEO")
            .when(F.col("kind") == 7, "¡Asistencia, Técnica!")
            .when((F.col("kind") == 5) & (F.col("p_partkey") % 16 == 5), F.initcap("text"))
            .otherwise("spyware"),
        ).alias("same"),
    )
)

# --- prices ------------------------------------------------------------------------------------

_L = "{price_literals}"
_REASON = """CASE WHEN raw = '' THEN 'PRECIO_AUSENTE' WHEN style = 11 THEN 'PRECIO_CERO_LITERAL'
  WHEN style = 10 THEN CASE WHEN amount % 1000 = 0 THEN 'PRECIO_CERO_LITERAL' ELSE 'PRECIO_AMBIGUO' END
  WHEN style = 16 THEN 'PRECIO_AMBIGUO' WHEN style IN (7, 8, 9, 17) THEN 'PRECIO_NO_REPRESENTABLE' END"""
catalog.query(
    "PRC-01", f"SELECT line_id, {_REASON} AS reason FROM {_L}", df="price_literals"
)(lambda df: df.select("line_id", pr.literal_reject_reason(F.col("raw")).alias("reason")))
catalog.query(
    "PRC-02",
    f"""SELECT line_id,
      CASE WHEN r IS NULL OR r = 'PRECIO_CERO_LITERAL' THEN CASE WHEN style = 6 THEN amount * 100
        WHEN style = 15 THEN amount * 100 + 50 WHEN style IN (10, 11) THEN 0 ELSE amount END END AS value,
      CASE WHEN r IS NULL OR r = 'PRECIO_CERO_LITERAL' THEN
        CASE WHEN style IN (3, 4) THEN 'USD' ELSE 'ARS' END END AS currency,
      CASE WHEN style = 13 THEN 'mensual' END AS period
    FROM (SELECT *, {_REASON} AS r FROM {_L})""",
    df="price_literals",
)(
    lambda df: df.select("line_id", pr.literal_price(F.col("raw")).alias("p")).select(
        "line_id", "p.value", "p.currency", "p.period"
    )
)
derive(
    "amounts",
    f"""SELECT o_orderkey, o_orderkey % 7 AS style, amount, CASE o_orderkey % 7
      WHEN 0 THEN {dotted('amount')} WHEN 1 THEN {dotted('amount')} || ',25'
      WHEN 2 THEN CAST(CAST(FLOOR(amount / 1000) AS BIGINT) AS STRING) || ',' || LPAD(CAST(amount % 1000 AS STRING), 3, '0') || '.5'
      WHEN 3 THEN CAST(amount AS STRING) || ',5' WHEN 4 THEN CAST(amount AS STRING) || '.75'
      WHEN 5 THEN CAST(amount AS STRING) ELSE '' END AS raw,
      CASE o_orderkey % 3 WHEN 0 THEN CAST(amount AS STRING)
        WHEN 1 THEN CAST(amount % 100 AS STRING) || ',5' ELSE '1.' || CAST(amount % 100 + 10 AS STRING) || '.5' END AS scalar_raw
    FROM (SELECT o_orderkey, CAST(FLOOR(o_totalprice) AS BIGINT) % 900000 + 1000 AS amount FROM {{orders}})""",
)
catalog.query(
    "PRC-03",
    """SELECT o_orderkey, CASE style WHEN 0 THEN amount WHEN 1 THEN amount + 0.25 WHEN 2 THEN amount + 0.5
      WHEN 3 THEN amount + 0.5 WHEN 4 THEN amount + 0.75 WHEN 5 THEN amount END::DOUBLE AS value FROM {amounts}""",
    df="amounts",
)(lambda df: df.select("o_orderkey", pr.money_amount(F.col("raw")).alias("value")))
catalog.query(
    "PRC-04",
    """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN amount::DOUBLE WHEN 1 THEN amount % 100 + 0.5
      ELSE CAST('1.' || CAST(amount % 100 + 10 AS VARCHAR) || '5' AS DOUBLE) END AS value FROM {amounts}""",
    df="amounts",
)(lambda df: df.select("o_orderkey", pr.scalar_amount(F.col("scalar_raw")).alias("value")))
catalog.query(
    "PRC-05",
    f"""SELECT line_id, CASE WHEN style IN (0, 1, 4, 5, 6, 7, 8, 13, 17, 18) THEN amount
        WHEN style = 10 AND amount % 1000 > 0 THEN amount % 1000 WHEN style = 16 THEN 40 END AS value,
      CASE WHEN style IN (0, 1, 4, 5, 6, 7, 8, 13, 17, 18) OR (style = 10 AND amount % 1000 > 0) OR style = 16
        THEN 'ARS' END AS currency FROM {_L}""",
    df="price_literals",
)(
    lambda df: pr.with_web_price(df, "raw").select(
        "line_id", "web_price.value", "web_price.currency"
    )
)
catalog.query(
    "PRC-06",
    f"""SELECT line_id, (CASE WHEN style IN (9, 12) THEN NULL WHEN style = 10 THEN amount % 1000
      WHEN style = 11 THEN 0 WHEN style = 15 THEN amount + 0.5 WHEN style = 16 THEN 40
      ELSE amount END)::DOUBLE AS value FROM {_L}""",
    df="price_literals",
)(lambda df: df.select("line_id", pr.possible_number(F.col("raw")).alias("value")))


def _meaning(df: DataFrame, mode: str) -> DataFrame:
    return df.select("line_id", pr.price_meaning(F.col("raw"), mode).alias("m")).select(
        "line_id", "m.kind", "m.value", "m.low", "m.high", "m.is_floor"
    )


catalog.query(
    "PRC-07",
    f"""SELECT line_id, CASE WHEN style IN (0, 1) THEN 'numerico_inequivoco' WHEN style = 12 THEN 'sin_precio'
        WHEN style IN (7, 8, 9) THEN 'texto_especial'
        WHEN style IN (10, 11, 16) THEN 'numerico_potencialmente_ambiguo' ELSE 'invalido' END AS kind,
      CASE WHEN style IN (0, 1, 7) THEN amount END AS value,
      CASE WHEN style IN (7, 8) THEN amount END AS low, CASE WHEN style = 8 THEN amount + 500 END AS high,
      style = 7 AS is_floor FROM {_L}""",
    df="price_literals",
)(lambda df: _meaning(df, "catalog"))
catalog.query(
    "PRC-07-product",
    f"""SELECT line_id, CASE WHEN style = 12 THEN 'ausencia' WHEN style = 7 THEN 'desde'
        WHEN style IN (8, 16) THEN 'rango' WHEN style = 9 THEN 'consultar'
        WHEN style = 11 OR (style = 10 AND amount % 1000 = 0) THEN 'cero' WHEN style = 10 THEN 'ambiguo'
        WHEN style = 17 THEN 'otro' ELSE 'exacto' END AS kind,
      CASE WHEN style IN (0, 1, 2, 3, 4, 5, 13, 14, 18) THEN amount WHEN style = 6 THEN amount * 100
        WHEN style = 15 THEN amount * 100 + 50 END AS value,
      NULL::BIGINT AS low, NULL::BIGINT AS high, FALSE AS is_floor FROM {_L}""",
    df="price_literals",
)(lambda df: _meaning(df, "product"))
catalog.query(
    "PRC-07-list",
    f"""SELECT line_id, CASE WHEN style = 12 THEN 'sin_precio' WHEN style = 7 THEN 'desde'
        WHEN style IN (8, 16) THEN 'rango' WHEN style = 9 THEN 'consultar'
        WHEN style = 10 AND amount % 1000 > 0 THEN 'ambiguo' WHEN style IN (10, 11, 17) THEN 'otro'
        ELSE 'exacto' END AS kind,
      CASE WHEN style IN (0, 1, 2, 3, 4, 5, 13, 14, 18) THEN amount WHEN style = 6 THEN amount * 100
        WHEN style = 15 THEN amount * 100 + 50 END AS value,
      NULL::BIGINT AS low, NULL::BIGINT AS high, FALSE AS is_floor FROM {_L}""",
    df="price_literals",
)(lambda df: _meaning(df, "list"))



def _folded(df: DataFrame) -> DataFrame:
    return df.withColumn("folded", tx.fold(F.col("economic_object_raw"), collapse=False))


catalog.query(
    "PRC-08",
    f"SELECT observation_id, {cadence_sql()} AS price_scope FROM {{observations}}",
    df="observations",
)(
    lambda df: _folded(df).select(
        "observation_id", pr.offer_cadence(F.col("folded")).alias("price_scope")
    )
)
catalog.query(
    "PRC-09",
    f"SELECT observation_id, {context_sql()} AS commercial_context FROM {{observations}}",
    df="observations",
)(
    lambda df: _folded(df).select(
        "observation_id",
        pr.commercial_context(F.col("folded")).alias("commercial_context"),
    )
)
catalog.query(
    "PRC-10",
    """SELECT observation_id, CASE text_no WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN 'PER_HOUR' WHEN 2 THEN 'PER_MONTH'
      WHEN 3 THEN 'PER_VISIT' ELSE 'UNKNOWN' END AS price_scope FROM {observations}""",
    df="observations",
)(
    lambda df: _folded(df).select(
        "observation_id",
        pr.question_cadence(F.col("folded"), F.lit("EXACT")).alias("price_scope"),
    )
)
catalog.query(
    "PRC-11",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
      CASE WHEN l_quantity = floor(l_quantity) THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) ELSE CAST(l_quantity AS VARCHAR) END AS quantity_key,
      CASE WHEN l_extendedprice = floor(l_extendedprice) THEN CAST(CAST(l_extendedprice AS BIGINT) AS VARCHAR)
        ELSE CAST(l_extendedprice AS VARCHAR) END AS price_key FROM lineitem""",
    df="lineitem",
)(
    lambda df: df.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        pr.number_key(F.col("l_quantity")).alias("quantity_key"),
        pr.number_key(F.col("l_extendedprice")).alias("price_key"),
    )
)
catalog.query(
    "PRC-12",
    """SELECT observation_id, 'generic:' || CAST(l_linenumber AS VARCHAR) || ':' ||
      regexp_replace(regexp_replace(lower(economic_object_raw), '\\s+', '-', 'g'), '[^a-z0-9áéíóúüñ\\-]+', '', 'g')
      || ':' || CAST(CAST(floor(price) AS BIGINT) AS VARCHAR) AS slug FROM {observations}""",
    df="observations",
)(
    lambda df: df.select(
        "observation_id",
        pr.observation_slug(
            F.col("l_linenumber"), F.col("economic_object_raw"), F.floor("price").cast("bigint")
        ).alias("slug"),
    )
)
catalog.query(
    "PRC-13",
    f"SELECT o_orderkey, '$' || {dotted('amount')} AS money FROM {{amounts}}",
    df="amounts",
)(lambda df: df.select("o_orderkey", pr.pesos(F.col("amount")).alias("money")))
