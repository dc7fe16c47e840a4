"""Purchase orders, notices and awards as JSON documents, and their consistency."""

from __future__ import annotations

from pyspark.sql import functions as F

from valora.bindings.base import Catalog, LINE_ID, derive
from valora.operators import procurement as pc
from valora.operators import readouts as ro

catalog = Catalog()

_T = "CAST(FLOOR(o_totalprice) AS BIGINT)"
_OB, _CB = "CHR(123)", "CHR(125)"


def _item(code: str, qty: str, net: str, total: str, extra: str = "''") -> str:
    return (
        f"{_OB} || '\"CodigoCategoria\": ' || {code} || ', \"Producto\": \"' || o_orderpriority || '\", \"Cantidad\": ' || {qty} || "
        f"', \"PrecioNeto\": ' || {net} || ', \"Total\": ' || {total} || {extra} || {_CB}"
    )


# no: 0 broken, 1 not an object, 2 without code, 3 no items, 4 one matching line, 5 two lines,
# 6 a zero line total, 7 an empty item next to a good one, 8 without currency.
_GOOD = _item("'43211503'", "'2'", f"CAST({_T} AS STRING)", f"CAST({_T} * 2 AS STRING)", "', \"Unidad\": \"u\"'")
_OTHER = _item("'72101500'", "'1'", "'5'", "'5'")
_ZERO = _item("'0'", "'3'", "'7'", "'0'")
_LISTS = {
    3: "''",
    4: _GOOD,
    5: f"{_GOOD} || ', ' || {_OTHER}",
    6: _ZERO,
    7: f"{_GOOD} || ', ' || {_OB} || {_CB}",
    8: _GOOD,
}
_LIST = "CASE o_orderkey % 9 " + " ".join(f"WHEN {i} THEN {t}" for i, t in _LISTS.items()) + " ELSE '' END"
_TOTAL = f"CASE o_orderkey % 9 WHEN 4 THEN {_T} * 2 WHEN 5 THEN {_T} * 2 + 5 WHEN 6 THEN 21 ELSE {_T} END"
derive(
    "order_documents",
    f"""SELECT o_orderkey, o_orderkey AS raw_document_id, 'orders' AS source, 'u' AS source_url, o_orderkey % 9 AS no, {_T} AS amount, o_orderpriority, o_orderstatus,
      CASE o_orderkey % 9 WHEN 4 THEN 1 WHEN 5 THEN 2 WHEN 6 THEN 1 WHEN 7 THEN 2 WHEN 8 THEN 1 ELSE 0 END AS items_n,
      CASE WHEN o_orderkey % 9 IN (4, 5, 7, 8) THEN 1 ELSE 0 END AS units_n,
      CASE o_orderkey % 9 WHEN 0 THEN {_OB} || '"Codigo":' WHEN 1 THEN '[1]' ELSE
        {_OB} || CASE WHEN o_orderkey % 9 = 2 THEN '"Codigo": ""' ELSE '"Codigo": "OC-' || CAST(o_orderkey AS STRING) || '"' END || ', "Nombre": "' || o_orderpriority
        || '", "Descripcion": "", "CodigoEstado": "' || o_orderstatus || '", "Comprador": ' || {_OB} || '"RegionUnidad": "R"' || {_CB} || ', "Proveedor": ' || {_OB} || '"Comuna": "C"' || {_CB}
        || CASE WHEN o_orderkey % 9 = 8 THEN '' ELSE ', "TipoMoneda": "CLP"' END || ', "Total": ' || CAST({_TOTAL} AS STRING)
        || ', "Items": ' || {_OB} || '"Listado": [' || {_LIST} || ']' || {_CB} || {_CB} END AS raw_content FROM {{orders}}""",
)
_STATUS = "CASE WHEN no <= 2 THEN 'REJECTED' WHEN no IN (3, 7, 8) THEN 'PARTIAL' ELSE 'EXTRACTED' END"
catalog.query(
    "PRO-01",
    f"""SELECT raw_document_id, CASE WHEN no <= 2 THEN 'UNKNOWN' ELSE 'OC-' || o_orderkey END AS source_record_id, {_STATUS} AS status,
      CASE no WHEN 0 THEN 'invalid raw JSON' WHEN 1 THEN 'raw content must be a JSON object' WHEN 2 THEN 'missing purchase order Codigo' END AS reject_reason,
      CASE WHEN no <= 1 THEN 'UNKNOWN' ELSE o_orderpriority END AS description_raw, CASE WHEN no <= 1 THEN 'UNKNOWN' ELSE o_orderstatus END AS status_raw,
      CASE WHEN no <= 1 OR no = 8 THEN 'UNKNOWN' ELSE 'CLP' END AS currency_raw, CASE WHEN no <= 1 THEN 'UNKNOWN' ELSE 'R' END AS buyer_region_raw,
      CASE WHEN no <= 1 THEN 'UNKNOWN' ELSE 'C' END AS supplier_comuna_raw, CASE WHEN no = 7 THEN 'empty item' ELSE '' END AS line_reject_reasons
    FROM {{order_documents}}""",
    df="order_documents",
)(
    lambda df: pc.extract_orders(df).select(
        "raw_document_id",
        "source_record_id",
        "status",
        "reject_reason",
        "description_raw",
        "status_raw",
        "currency_raw",
        "buyer_region_raw",
        "supplier_comuna_raw",
        "line_reject_reasons",
    )
)
_LINES = """SELECT o_orderkey, no, amount, 0 AS line_index, CASE WHEN no = 6 THEN '0' ELSE '43211503' END AS code, CASE WHEN no = 6 THEN 3 ELSE 2 END AS q,
    CASE WHEN no = 6 THEN 7 ELSE amount END AS net, CASE WHEN no = 6 THEN 0 ELSE amount * 2 END AS total, o_orderpriority FROM {order_documents} WHERE no BETWEEN 4 AND 8
  UNION ALL SELECT o_orderkey, no, amount, 1, '72101500', 1, 5, 5, o_orderpriority FROM {order_documents} WHERE no = 5
  UNION ALL SELECT o_orderkey, no, amount, 1, 'UNKNOWN', NULL, NULL, NULL, NULL FROM {order_documents} WHERE no = 7"""
catalog.query(
    "PRO-02",
    f"""SELECT 'OC-' || o_orderkey || ':LINE:' || line_index AS source_record_id, line_index, CASE WHEN q IS NULL THEN 'REJECTED' ELSE 'EXTRACTED' END AS status,
      CASE WHEN q IS NULL THEN 'empty item' END AS reject_reason, coalesce(o_orderpriority, 'UNKNOWN') AS description_raw, code AS category_code_raw,
      coalesce(CAST(q AS VARCHAR), 'UNKNOWN') AS quantity_raw, coalesce(CAST(total AS VARCHAR), 'UNKNOWN') AS total_raw,
      CASE WHEN no = 8 THEN 'UNKNOWN' ELSE 'CLP' END AS currency_raw, 'INDEX:' || line_index AS stable_id FROM ({_LINES})""",
    df="order_documents",
)(
    lambda df: pc.order_lines(pc.extract_orders(df)).select(
        "source_record_id",
        "line_index",
        "status",
        "reject_reason",
        "description_raw",
        "category_code_raw",
        "quantity_raw",
        "total_raw",
        "currency_raw",
        "stable_id",
    )
)
catalog.query(
    "PRO-03",
    """SELECT count(*) AS orders_processed, count(*) FILTER (no IN (4, 5, 6)) AS orders_extracted, count(*) FILTER (no IN (3, 7, 8)) AS orders_partial,
      count(*) FILTER (no <= 2) AS orders_rejected, 0 AS duplicate, sum(CASE WHEN no > 2 THEN items_n ELSE 0 END)::BIGINT AS items_seen,
      sum(CASE WHEN no > 2 THEN items_n - CASE WHEN no = 7 THEN 1 ELSE 0 END ELSE 0 END)::BIGINT AS items_extracted, 0 AS items_partial,
      count(*) FILTER (no = 7) AS items_rejected FROM {order_documents}""",
    df="order_documents",
)(lambda df: pc.order_counters(pc.extract_orders(df)))
catalog.query(
    "PRO-04",
    """SELECT o_orderkey AS raw_document_id, CASE WHEN no = 3 THEN 'NOT_EVALUABLE' WHEN no IN (4, 5) THEN 'MATCH' ELSE 'MISMATCH' END AS lines_vs_total,
      CASE no WHEN 3 THEN '' WHEN 5 THEN 'MATCH|MATCH' WHEN 6 THEN 'MISMATCH' WHEN 7 THEN 'MATCH|NOT_EVALUABLE' ELSE 'MATCH' END AS line_flags
      FROM {order_documents} WHERE no > 2""",
    df="order_documents",
)(
    lambda df: pc.extract_orders(df)
    .filter(F.col("reject_reason").isNull())
    .select(
        "raw_document_id",
        "lines_vs_total",
        F.array_join(F.transform("lines", lambda x: x["consistency"]), "|").alias("line_flags"),
    )
)

# --- lines and orders as tables --------------------------------------------------------------------

derive(
    "purchase_lines",
    f"""SELECT {LINE_ID} AS line_id, l_orderkey, p_type, CASE p_type WHEN 'ECONOMY' THEN '43211503' WHEN 'STANDARD' THEN '81111500.0' WHEN 'SMALL' THEN '0'
        WHEN 'LARGE' THEN '' WHEN 'MEDIUM' THEN '72101500' ELSE 'abc' END AS code,
      CASE WHEN l_tax = 0.01 THEN 'UNKNOWN' ELSE CAST(CAST(l_quantity AS BIGINT) AS STRING) END AS quantity,
      CAST(CAST(FLOOR(l_extendedprice) AS BIGINT) AS STRING) AS net,
      CASE WHEN l_tax = 0.02 THEN '0' WHEN l_tax = 0.03 THEN '5.5' ELSE CAST(CAST(l_quantity AS BIGINT) * CAST(FLOOR(l_extendedprice) AS BIGINT) AS STRING) END AS total,
      CAST(l_quantity AS BIGINT) * CAST(FLOOR(l_extendedprice) AS BIGINT) AS expected, l_tax
    FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey""",
)
_SCOPE = "CASE p_type WHEN 'ECONOMY' THEN 'TECH_RELEVANT' WHEN 'STANDARD' THEN 'TECH_RELEVANT' WHEN 'SMALL' THEN 'UNKNOWN' WHEN 'LARGE' THEN 'UNKNOWN' ELSE 'NON_TECH' END"
_SCOPE_REASON = """CASE p_type WHEN 'ECONOMY' THEN 'UNSPSC_43_IT_BROADCAST_TELECOM' WHEN 'STANDARD' THEN 'UNSPSC_8111_COMPUTER_SERVICES'
  WHEN 'SMALL' THEN 'MISSING_OR_UNKNOWN_OFFICIAL_CLASSIFICATION' WHEN 'LARGE' THEN 'MISSING_OR_UNKNOWN_OFFICIAL_CLASSIFICATION' ELSE 'UNSPSC_STRUCTURED_NON_TECH' END"""
catalog.query(
    "PRO-05",
    f"SELECT line_id, {_SCOPE} AS status, {_SCOPE_REASON} AS reason FROM {{purchase_lines}}",
    df="purchase_lines",
)(lambda df: df.select("line_id", pc.technology_scope(F.col("code")).alias("s")).select("line_id", "s.*"))
_LINE_STATUS = "CASE WHEN l_tax = 0.01 THEN 'NOT_EVALUABLE' WHEN l_tax IN (0.02, 0.03) THEN 'MISMATCH' ELSE 'MATCH' END"
_LINE_REASON = """CASE l_tax WHEN 0.01 THEN 'MISSING_OR_NON_NUMERIC_LINE_ECONOMICS' WHEN 0.02 THEN 'LINE_TOTAL_ZERO_BUT_QUANTITY_X_NET_PRICE_POSITIVE'
  WHEN 0.03 THEN 'LINE_TOTAL_DIFFERS_FROM_QUANTITY_X_NET_PRICE' ELSE 'QUANTITY_X_NET_PRICE_MATCHES_LINE_TOTAL' END"""
catalog.query(
    "PRO-06",
    f"""SELECT line_id, {_LINE_STATUS} AS status, {_LINE_REASON} AS reason, CASE WHEN l_tax <> 0.01 THEN expected END::DOUBLE AS expected,
      CASE WHEN l_tax = 0.02 THEN 0 WHEN l_tax = 0.03 THEN 5.5 ELSE expected END::DOUBLE AS observed FROM {{purchase_lines}}""",
    df="purchase_lines",
)(
    lambda df: df.select(
        "line_id",
        pc.explain_line(F.col("quantity"), F.col("net"), F.col("total")).alias("e"),
    ).select("line_id", "e.status", "e.reason", "e.expected", "e.observed")
)
derive(
    "purchase_orders",
    """SELECT o_orderkey, o_orderkey % 5 AS no, s, CASE o_orderkey % 5 WHEN 0 THEN s WHEN 1 THEN s + 19 WHEN 2 THEN s + 500 WHEN 3 THEN NULL ELSE s END AS total,
      CASE WHEN o_orderkey % 5 = 1 THEN s + 10 END AS net, 9 AS tax, CASE WHEN o_orderkey % 5 = 1 THEN 5 END AS charges, CASE WHEN o_orderkey % 5 = 1 THEN 5 END AS discounts
    FROM {orders} JOIN (SELECT l_orderkey, SUM(CAST(FLOOR(l_extendedprice) AS BIGINT)) AS s FROM {lineitem} GROUP BY l_orderkey) x ON o_orderkey = l_orderkey""",
)
_ORDER_STATUS = "CASE WHEN no IN (0, 4) THEN 'MATCH' WHEN no = 3 THEN 'NOT_EVALUABLE' ELSE 'MISMATCH' END"
_ORDER_REASON = """CASE no WHEN 1 THEN 'ORDER_TOTAL_MATCHES_HEADER_NET_TAX_CHARGES_DISCOUNTS_NOT_LINE_TOTALS' WHEN 2 THEN 'ORDER_TOTAL_DIFFERS_FROM_SUM_LINE_TOTAL'
  WHEN 3 THEN 'MISSING_OR_NON_NUMERIC_ORDER_TOTALS' ELSE 'SUM_LINE_TOTAL_MATCHES_ORDER_TOTAL' END"""


def _explained_orders(df):
    columns = [F.col(c) for c in ("total", "net", "tax", "charges", "discounts", "s")]
    return df.select("o_orderkey", pc.explain_order(*columns).alias("e")).select("o_orderkey", "e.*")


catalog.query(
    "PRO-07",
    f"""SELECT o_orderkey, {_ORDER_STATUS} AS status, {_ORDER_REASON} AS reason, CASE WHEN no IN (0, 4) THEN s WHEN no = 1 THEN s + 19 END::DOUBLE AS expected,
      total::DOUBLE AS observed, s::DOUBLE AS lines FROM {{purchase_orders}}""",
    df="purchase_orders",
)(_explained_orders)


@catalog.query(
    "AGG-16",
    f"""SELECT 'scope' AS section, {_SCOPE} AS label, count(*) AS n FROM {{purchase_lines}} GROUP BY 2
      UNION ALL SELECT 'scope_reason', {_SCOPE_REASON}, count(*) FROM {{purchase_lines}} GROUP BY 2
      UNION ALL SELECT 'prefix', CASE WHEN code = '' THEN 'UNKNOWN' ELSE left(code, 2) END, count(*) FROM {{purchase_lines}} GROUP BY 2
      UNION ALL SELECT 'line', {_LINE_STATUS}, count(*) FROM {{purchase_lines}} GROUP BY 2
      UNION ALL SELECT 'line_reason', {_LINE_REASON}, count(*) FROM {{purchase_lines}} GROUP BY 2
      UNION ALL SELECT 'order', {_ORDER_STATUS}, count(*) FROM {{purchase_orders}} GROUP BY 2
      UNION ALL SELECT 'order_reason', {_ORDER_REASON}, count(*) FROM {{purchase_orders}} GROUP BY 2""",
    lines="purchase_lines",
    orders="purchase_orders",
)
def order_report(lines, orders):
    """Every section of the report from one scan of the lines and one of the orders."""
    line = lines.select(
        pc.technology_scope(F.col("code")).alias("s"),
        pc.category_prefix(F.col("code")).alias("prefix"),
        pc.explain_line(F.col("quantity"), F.col("net"), F.col("total")).alias("e"),
    )

    def cells(**labels):
        rows = [F.struct(F.lit(k).alias("section"), F.col(c).alias("label")) for k, c in labels.items()]
        return F.inline(F.array(*rows))

    long = line.select(
        cells(
            scope="s.status", scope_reason="s.reason", prefix="prefix", line="e.status", line_reason="e.reason"
        )
    ).unionByName(_explained_orders(orders).select(cells(order="status", order_reason="reason")))
    return long.groupBy("section", "label").agg(F.count(F.lit(1)).alias("n"))


catalog.query(
    "AGG-16-examples",
    f"""SELECT line_id, {_SCOPE_REASON} AS reason FROM {{purchase_lines}} WHERE {_SCOPE} = 'TECH_RELEVANT' ORDER BY line_id LIMIT 10""",
    df="purchase_lines",
)(
    lambda df: df.withColumn("s", pc.technology_scope(F.col("code")))
    .filter("s.status = 'TECH_RELEVANT'")
    .orderBy("line_id")
    .limit(10)
    .select("line_id", "s.reason")
)
catalog.query(
    "AGG-17",
    """SELECT count(*) FILTER (n = 1) AS single_item_orders, count(*) FILTER (n > 1) AS multi_item_orders, min(n) AS min_lines_per_order,
      max(n) AS max_lines_per_order, median(n)::DOUBLE AS median_lines_per_order FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)""",
    df="lineitem",
)(lambda df: ro.line_distribution(df, ["l_orderkey"]))

# --- notices --------------------------------------------------------------------------------------

_BODY = f"""'"publication-number": "' || CAST(p_partkey AS STRING) || '", "notice-title": ' || {_OB} || '"spa": ["t ' || p_name || '"], "eng": ["e ' || p_name || '"]' || {_CB}
  || ', "classification-cpv": ["' || p_type || '"], "buyer-name": ' || {_OB} || '"deu": ["' || p_brand || '"]' || {_CB} || ', "publication-date": "2024"'
  || CASE WHEN p_partkey % 4 = 0 THEN '' ELSE ', "buyer-country": ["X"]' END
  || CASE p_partkey % 6 WHEN 0 THEN ', "estimated-value-lot": 10, "estimated-value-lot-currency": "EUR", "contract-value": 7' WHEN 1 THEN ', "awarded-value": 5, "currency": "USD"'
     WHEN 2 THEN ', "contract-value": "3", "contract-value-cur": "GBP"' WHEN 3 THEN ', "framework-value": 1' WHEN 4 THEN ', "winner-name": "W"' ELSE ', "estimated-value-notice": ""' END"""
derive(
    "notice_documents",
    f"""SELECT p_partkey AS raw_document_id, p_partkey, 'n' AS source, 'u' AS source_url, p_name, p_type, p_brand,
      CASE WHEN p_partkey % 10 = 9 THEN '"text"' WHEN p_partkey % 10 = 8 THEN {_OB} || '"id": ""' || {_CB} ELSE {_OB} || {_BODY} || {_CB} END AS raw_content FROM {{part}}""",
)
_NREJ = "CASE p_partkey % 10 WHEN 9 THEN 'raw content must be a JSON object' WHEN 8 THEN 'missing publication number' END"
_SEM = "CASE WHEN p_partkey % 10 >= 8 THEN 'unknown_value_semantics' ELSE CASE p_partkey % 6 WHEN 0 THEN 'estimated_value' WHEN 1 THEN 'award_value' WHEN 2 THEN 'contract_value' WHEN 3 THEN 'framework_value' ELSE 'unknown_value_semantics' END END"
_NVAL = "CASE WHEN p_partkey % 10 >= 8 THEN 'UNKNOWN' ELSE CASE p_partkey % 6 WHEN 0 THEN '10' WHEN 1 THEN '5' WHEN 2 THEN '3' WHEN 3 THEN '1' ELSE 'UNKNOWN' END END"
_NCUR = "CASE WHEN p_partkey % 10 >= 8 THEN 'UNKNOWN' ELSE CASE p_partkey % 6 WHEN 0 THEN 'EUR' WHEN 1 THEN 'USD' WHEN 2 THEN 'GBP' ELSE 'UNKNOWN' END END"
_NSTAT = "CASE WHEN p_partkey % 10 >= 8 THEN 'REJECTED' WHEN p_partkey % 4 = 0 THEN 'PARTIAL' ELSE 'EXTRACTED' END"
_NCOLS = ("raw_document_id", "status", "reject_reason", "value_semantics", "value_raw", "currency_raw", "supplier_raw", "classification_raw")
catalog.query(
    "PRO-08",
    f"""SELECT raw_document_id, {_NSTAT} AS status, {_NREJ} AS reject_reason, {_SEM} AS value_semantics, {_NVAL} AS value_raw, {_NCUR} AS currency_raw,
      CASE WHEN p_partkey % 10 < 8 AND p_partkey % 6 = 4 THEN 'W' ELSE 'UNKNOWN' END AS supplier_raw,
      CASE WHEN p_partkey % 10 < 8 THEN '["' || p_type || '"]' ELSE 'UNKNOWN' END AS classification_raw FROM {{notice_documents}}""",
    df="notice_documents",
)(lambda df: pc.extract_notices(df).select(*_NCOLS))
catalog.query(
    "PRO-09",
    f"""SELECT count(*) AS processed, count(*) FILTER ({_NSTAT} = 'EXTRACTED') AS extracted, count(*) FILTER ({_NSTAT} = 'PARTIAL') AS partial,
      count(*) FILTER ({_NSTAT} = 'REJECTED') AS rejected, 0 AS duplicate FROM {{notice_documents}}""",
    df="notice_documents",
)(lambda df: pc.extraction_counters(pc.extract_notices(df)))


@catalog.query(
    "AGG-19",
    f"""SELECT 'with_any_value' AS label, count(*) FILTER ({_NVAL} <> 'UNKNOWN') AS n FROM {{notice_documents}}
      UNION ALL SELECT 'with_currency', count(*) FILTER ({_NCUR} <> 'UNKNOWN') FROM {{notice_documents}}
      UNION ALL SELECT 'without_value', count(*) FILTER ({_NVAL} = 'UNKNOWN') FROM {{notice_documents}}
      UNION ALL SELECT 'semantics=' || {_SEM}, count(*) FROM {{notice_documents}} GROUP BY 1""",
    df="notice_documents",
)
def value_coverage(df):
    notices = pc.extract_notices(df)
    names = ["with_any_value", "with_currency", "without_value"]
    coverage = ro.value_coverage(notices, F.col("value_raw"), F.col("currency_raw"))
    return coverage.unpivot([], names, "label", "n").unionByName(
        ro.histogram(notices, F.concat(F.lit("semantics="), F.col("value_semantics")))
    )


catalog.query(
    "PRO-13",
    """SELECT raw_document_id, CASE WHEN p_partkey % 10 < 8 THEN 'e ' || p_name ELSE 'UNKNOWN' END AS title, CASE WHEN p_partkey % 10 < 8 THEN p_brand ELSE 'UNKNOWN' END AS buyer
      FROM {notice_documents}""",
    df="notice_documents",
)(
    lambda df: pc.extract_notices(df).select(
        "raw_document_id",
        pc.display_text(F.col("title_raw")).alias("title"),
        pc.display_text(F.col("buyer_raw")).alias("buyer"),
    )
)

# --- awards -------------------------------------------------------------------------------------

catalog.query(
    "PRO-10",
    """SELECT arrival AS raw_document_id, CASE WHEN arrival % 9 = 6 THEN CAST(arrival AS VARCHAR) WHEN arrival % 9 < 6 THEN 'A' || arrival ELSE 'UNKNOWN' END AS source_record_id,
      CASE WHEN arrival % 9 < 7 THEN 'EXTRACTED' ELSE 'REJECTED' END AS status,
      CASE arrival % 9 WHEN 8 THEN 'raw content must be a JSON object' WHEN 7 THEN 'missing stable award identity' END AS reject_reason,
      CASE WHEN arrival % 9 = 8 THEN 'UNKNOWN' ELSE c_name END AS recipient_raw, 'USD' AS currency_raw,
      CASE WHEN arrival % 9 < 8 AND arrival % 2 = 0 THEN c_mktsegment ELSE 'UNKNOWN' END AS description_raw FROM {landed_awards}""",
    df="landed_awards",
)(
    lambda df: pc.extract_awards(
        df.select(
            F.col("arrival").alias("raw_document_id"),
            F.lit("a").alias("source"),
            F.lit("u").alias("source_url"),
            F.col("payload").alias("raw_content"),
        )
    ).select(
        "raw_document_id",
        "source_record_id",
        "status",
        "reject_reason",
        "recipient_raw",
        "currency_raw",
        "description_raw",
    )
)
derive(
    "line_awards",
    "SELECT l_orderkey AS process, CASE WHEN l_returnflag = 'R' THEN 'INFORMATICA; SOFTWARE' ELSE 'LIMPIEZA' END AS rubros FROM {lineitem}",
)
derive("calls", "SELECT o_orderkey AS process FROM {orders} WHERE o_orderstatus <> 'P'")
catalog.query(
    "PRO-11",
    """SELECT count(*) AS awards, count(o.o_orderkey) AS matched, count(DISTINCT l_orderkey) AS processes FROM lineitem LEFT JOIN orders o
      ON l_orderkey = o_orderkey AND o_orderstatus <> 'P' WHERE l_returnflag = 'R'""",
    awards="line_awards",
    calls="calls",
)(
    lambda awards, calls: pc.call_coverage(
        awards.filter(F.col("rubros").contains("INFORMATICA;")), calls, "process"
    )
)
