"""Evidence intake: registry, raw documents, JSON lines, price observations, bulk rows, feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from valora.bindings.base import Catalog, derive
from valora.operators import readouts as ro
from valora.operators.dedup import only_new, with_children
from valora.session import new_shared_folder
from valora.sources import commit as cm
from valora.sources import evidence as ev
from valora.sources import files as fi
from valora.sources.records import quoted_records, record_cells
from valora.sources import registry as rg

catalog = Catalog()

# --- registry -------------------------------------------------------------------------------

derive(
    "registry_rows",
    """SELECT s_suppkey + 2 AS row_number, CASE s_suppkey % 10 WHEN 9 THEN '' WHEN 8 THEN 'dup' ELSE ' src' || CAST(s_suppkey AS STRING) || ' ' END AS source,
      s_name AS provider, 'https://x.example/' || CAST(s_suppkey AS STRING) AS url, n_name AS province, n_name AS city,
      CASE s_suppkey % 10 WHEN 7 THEN 'bad' WHEN 6 THEN 'Rejected' ELSE 'verified' END AS discovery_status,
      CASE s_suppkey % 4 WHEN 0 THEN 'NO_PRICE_VISIBLE' ELSE 'price_visible' END AS price_visibility,
      CASE s_suppkey % 7 WHEN 0 THEN 'AGGREGATOR' ELSE 'PROVIDER' END AS source_kind
    FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey""",
)
_FIRST = "(SELECT min(row_number) FROM {registry_rows} WHERE source = 'dup')"
_REASON = f"""CASE WHEN source = '' THEN 'Campo obligatorio faltante ''source'' en fila ' || row_number
  WHEN source = 'dup' AND row_number <> {_FIRST} THEN 'source duplicado: dup'
  WHEN discovery_status = 'bad' THEN 'Valor inválido para ''discovery_status'' en fila ' || row_number END"""
catalog.query(
    "SRC-01",
    f"SELECT row_number, trim(source) AS source, upper(discovery_status) AS discovery_status, {_REASON} AS reject_reason FROM {{registry_rows}}",
    df="registry_rows",
)(
    lambda df: rg.validate_registry(df).select(
        "row_number", "source", "discovery_status", "reject_reason"
    )
)
_GOOD = f"(SELECT * FROM {{registry_rows}} WHERE {_REASON} IS NULL)"
_FIT = "discovery_status = 'verified' AND price_visibility = 'price_visible' AND source_kind = 'PROVIDER'"


def _valid(df):
    return rg.validate_registry(df).filter(F.col("reject_reason").isNull())


catalog.query(
    "SRC-02",
    f"SELECT trim(source) AS source, provider, url, province, city FROM {_GOOD} WHERE {_FIT}",
    df="registry_rows",
)(lambda df: rg.select_sources(_valid(df)))
catalog.query(
    "AGG-23",
    f"SELECT province, count(*) AS candidates, count(*) FILTER ({_FIT}) AS eligible FROM {_GOOD} GROUP BY province",
    df="registry_rows",
)(lambda df: ro.registry_coverage(_valid(df), rg.acquisition_eligible()))

# --- raw documents ---------------------------------------------------------------------------

# Copies of one text under one source are re-deliveries; English documents are already stored.
derive(
    "deliveries",
    "SELECT doc_id AS arrival, source, lang AS source_record_id, text AS raw_content, lang FROM {documents}",
)
catalog.query(
    "SRC-03",
    """SELECT arrival, sha256(raw_content) AS content_hash,
      CASE WHEN lang <> 'en' AND row_number() OVER (PARTITION BY source, source_record_id, sha256(raw_content) ORDER BY arrival) = 1
        THEN 'ACQUIRED' ELSE 'DUPLICATE' END AS outcome FROM {deliveries}""",
    df="deliveries",
)(
    lambda df: ev.append_raw_documents(df, df.filter(F.col("lang") == "en"), "arrival").select(
        "arrival", "content_hash", "outcome"
    )
)

# Ten arrivals make a chain in which neighbours share a key, by turns the document and the object.
# Chains arrive in their order, backwards, or mixed; of every sixth the first link is stored.
_CHAIN, _AT = "CAST(FLOOR(event_id / 10) AS BIGINT)", "event_id % 10"
_LINK = f"CASE {_CHAIN} % 3 WHEN 0 THEN {_AT} WHEN 1 THEN 9 - {_AT} ELSE {_AT} * 7 % 10 END"
_TEXTS_OF_PRICES = """'ARS' AS currency_raw, '' AS scope_raw, '' AS device_type_raw, '' AS operating_system_raw,
  '' AS backup_raw, '' AS drivers_raw, '' AS programs_raw, '' AS license_raw, '' AS modality_raw, 'INDETERMINATE' AS comparable_status"""
derive(
    "price_arrivals",
    f"""SELECT event_id AS arrival, {_CHAIN} AS chain, {_LINK} AS link, CAST(FLOOR({_LINK} / 2) AS BIGINT) AS raw_document_id, 'v3' AS extractor_version, 's' AS source,
      'r' || CAST({_CHAIN} AS STRING) AS source_record_id, 'o' || CAST(CAST(FLOOR(({_LINK} + 1) / 2) AS BIGINT) AS STRING) AS economic_object_raw,
      CAST({_CHAIN} % 40 AS STRING) AS price_value, {_TEXTS_OF_PRICES} FROM {{events}}""",
)
derive("stored_prices", "SELECT * FROM {price_arrivals} WHERE chain % 6 = 0 AND link = 0")


@catalog.query(
    "SRC-04",
    """SELECT arrival, source_record_id, raw_document_id, economic_object_raw, price_value FROM {price_arrivals}
      WHERE CASE chain % 3 WHEN 0 THEN link % 2 = 0 AND NOT (chain % 6 = 0 AND link = 0)
        WHEN 1 THEN link % 2 = 1 ELSE link IN (0, 2, 4, 7, 9) END""",
    df="price_arrivals",
    stored="stored_prices",
)
def kept_observations(df, stored):
    """Greedy along each chain: every second link, as the order of arrival has it."""
    return ev.append_price_observations(df, stored, "arrival").select(
        "arrival", "source_record_id", "raw_document_id", "economic_object_raw", "price_value"
    )


# --- JSON lines -------------------------------------------------------------------------------

derive(
    "language_lines",
    """SELECT event_id + 1 AS line_number, event_id % 9 AS no, user_id, CASE event_id % 9
      WHEN 0 THEN '{{broken' WHEN 1 THEN '[1, 2]' WHEN 8 THEN '  '
      ELSE '{{"raw_text": "' || CASE event_id % 9 WHEN 2 THEN '' ELSE event_type END || '", "source": "log", "source_url": "https://x.example/' || CAST(user_id AS STRING)
        || '", "language": "es", "observed_at": "' || CASE event_id % 9 WHEN 3 THEN 'yesterday' ELSE '2024-01-02T03:04:05Z' END || '"'
        || CASE event_id % 9 WHEN 4 THEN ', "metadata": [1]' WHEN 5 THEN ', "metadata": ' || props ELSE '' END
        || CASE event_id % 9 WHEN 6 THEN ', "source_id": "id' || CAST(user_id AS STRING) || '"' ELSE '' END || '}}' END AS line,
      event_type FROM {events}""".replace("{{", "' || CHR(123) || '").replace("}}", "' || CHR(125) || '"),
)
# Every seventh user's evidence was stored by an earlier run.
derive(
    "stored_language",
    "SELECT DISTINCT 'log' AS source, 'id' || CAST(user_id AS STRING) AS source_id FROM {events} WHERE user_id % 7 = 0",
)
_LANG_REASON = """CASE no WHEN 0 THEN 'invalid JSON' WHEN 1 THEN 'line must be a JSON object' WHEN 2 THEN 'raw_text es obligatorio'
  WHEN 3 THEN 'invalid time: yesterday' WHEN 4 THEN 'metadata debe ser un objeto' END"""
_LANG_ID = "CASE WHEN no = 6 THEN 'id' || user_id ELSE 'sha256:' || sha256('log' || chr(0) || 'https://x.example/' || user_id || chr(0) || event_type) END"
catalog.query(
    "SRC-05",
    f"""SELECT line_number, {_LANG_REASON} AS reject_reason, CASE WHEN no >= 5 THEN {_LANG_ID} END AS source_id,
      CASE WHEN no < 5 THEN 'REJECTED' WHEN no = 6 AND user_id % 7 = 0 THEN 'DUPLICATE' WHEN row_number() OVER (PARTITION BY no < 5, {_LANG_ID} ORDER BY line_number) = 1 THEN 'ACCEPTED' ELSE 'DUPLICATE' END AS outcome
    FROM {{language_lines}} WHERE no <> 8""",
    lines="language_lines",
    stored="stored_language",
)(
    lambda lines, stored: ev.import_language(lines, stored).select(
        "line_number",
        "reject_reason",
        F.when(F.col("outcome") != "REJECTED", F.col("source_id")).alias("source_id"),
        "outcome",
    )
)
derive(
    "candidate_lines",
    """SELECT s_suppkey + 1 AS line_number, s_suppkey, CASE WHEN s_suppkey % 6 = 0 THEN 'not json'
      ELSE CHR(123) || '"name": "' || s_name || '", "url": "https://x.example/' || CAST(s_suppkey % 40 AS STRING) || '", "source_type": "' || CASE WHEN s_suppkey % 6 = 1 THEN '' ELSE 'page' END
        || '", "acquisition_method": "http"' || CASE WHEN s_suppkey % 6 = 2 THEN ', "status": "ACTIVE"' ELSE '' END || CHR(125) END AS line FROM {supplier}""",
)
derive(
    "stored_candidates",
    """SELECT DISTINCT 'https://x.example/' || CAST(s_suppkey % 40 AS STRING) AS url, 'page' AS source_type
      FROM {supplier} WHERE s_suppkey % 40 IN (2, 3, 4)""",
)
catalog.query(
    "SRC-06",
    """SELECT line_number, CASE s_suppkey % 6 WHEN 0 THEN 'invalid JSON' WHEN 1 THEN 'source_type es obligatorio' END AS reject_reason,
      CASE WHEN s_suppkey % 6 = 2 THEN 'ACTIVE' ELSE 'CANDIDATE' END AS status,
      CASE WHEN s_suppkey % 6 < 2 THEN 'REJECTED' WHEN s_suppkey % 40 IN (2, 3, 4) THEN 'DUPLICATE' WHEN row_number() OVER (PARTITION BY s_suppkey % 6 < 2, s_suppkey % 40 ORDER BY line_number) = 1 THEN 'ACCEPTED' ELSE 'DUPLICATE' END AS outcome
    FROM {candidate_lines}""",
    lines="candidate_lines",
    stored="stored_candidates",
)(lambda lines, stored: ev.import_candidates(lines, stored).select("line_number", "reject_reason", "status", "outcome"))

# --- bulk rows ----------------------------------------------------------------------------------

derive(
    "bulk_cells",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_suppkey % 5 AS kind, l_linenumber + 1 AS row_number,
      'R' || CAST(l_suppkey % 5 AS STRING) AS resource_id,
      CASE l_suppkey % 5 WHEN 0 THEN 'Adjudicaciones 2016 - 2026' WHEN 1 THEN 'Convocatorias 2015' WHEN 2 THEN 'SIPRO 2016-2026' WHEN 3 THEN 'Catalogo SIByS' ELSE 'Otros' END AS resource_name,
      CASE WHEN l_quantity < 3 THEN '' ELSE 'P' || CAST(l_orderkey AS STRING) END AS process, CASE WHEN l_quantity < 5 THEN '' ELSE 'C' || CAST(l_suppkey AS STRING) END AS cuit,
      CASE WHEN l_tax = 0.0 THEN ' ' ELSE CAST(l_partkey AS STRING) END AS codigo, l_discount = 0.1 AS has_extra_columns FROM {lineitem}""",
)
_ID = """CASE kind WHEN 0 THEN trim(process || '||' || cuit, '|') WHEN 1 THEN process WHEN 2 THEN cuit WHEN 3 THEN trim(codigo) ELSE 'ROW:' || row_number END"""
_BULK = f"""SELECT *, CASE WHEN {_ID} = '' THEN 'UNKNOWN' ELSE {_ID} END AS stable_id FROM {{bulk_cells}}
  WHERE has_extra_columns OR trim(process || cuit || codigo) <> ''"""
_BULK_REASON = "CASE WHEN has_extra_columns THEN 'extra columns beyond header' WHEN stable_id = 'UNKNOWN' THEN 'missing stable row identity' END"


def _bulk(df):
    cells = F.create_map(
        F.lit("Numero_Proceso"), F.col("process"), F.lit("Documento_Contractual"), F.lit(""),
        F.lit("CUIT"), F.col("cuit"), F.lit("CUIT_NIT"), F.col("cuit"), F.lit("codigo"), F.col("codigo"),
    )
    return fi.classify_bulk_rows(df.withColumn("row_raw", cells))


catalog.query(
    "SRC-07",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, stable_id, {_BULK_REASON} AS reject_reason FROM ({_BULK})""",
    df="bulk_cells",
)(
    lambda df: _bulk(df).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "stable_id", "reject_reason"
    )
)
catalog.query(
    "SRC-07-counters",
    f"""SELECT ['adjudicaciones', 'convocatorias', 'sipro', 'sibys', 'other'][kind + 1] AS resource_type, count(*) AS rows_seen,
      count(*) FILTER ({_BULK_REASON} IS NULL) AS rows_accepted, count(*) FILTER ({_BULK_REASON} IS NOT NULL) AS rows_rejected FROM ({_BULK}) GROUP BY 1""",
    df="bulk_cells",
)(lambda df: fi.bulk_counters(_bulk(df)))
#: Lines of 40 files as hex, by delimiter, encoding and use of quotes.
derive(
    "bulk_lines",
    """SELECT p_partkey % 40 AS file, p_partkey AS line_no, '61' || sep || HEX(p_name) || sep || CASE
        WHEN p_partkey % 5 = 2 THEN special || '22' WHEN p_partkey % 5 = 3 THEN '22' || special || '2222' || sep || '22'
        WHEN p_partkey % 5 = 4 AND p_partkey % 3 = 0 THEN '22' || special ELSE special END AS bytes
      FROM (SELECT p_partkey, p_name, CASE p_partkey % 4 WHEN 0 THEN '2C' WHEN 1 THEN '3B' WHEN 2 THEN '09' ELSE '7C' END AS sep,
        CASE WHEN p_partkey % 40 < 13 THEN 'C3A9' WHEN p_partkey % 40 < 26 THEN 'E980' ELSE 'E981' END AS special FROM {part}) s""",
)
catalog.query(
    "SRC-07-profile",
    """SELECT file, CASE WHEN file < 13 THEN 'utf-8' WHEN file < 26 THEN 'cp1252' ELSE 'latin-1' END AS encoding,
      CASE file % 4 WHEN 0 THEN ',' WHEN 1 THEN ';' WHEN 2 THEN CHR(9) ELSE '|' END AS delimiter,
      bool_or(file % 5 = 4 AND line_no % 3 = 0) AS quoted_breaks FROM {bulk_lines} GROUP BY file""",
    df="bulk_lines",
)(lambda df: fi.line_profiles(df.select("file", F.unhex("bytes").cast("string").alias("value"), F.col("line_no").alias("_id"))))
#: Lines of 5 files; records by kind: plain, over two lines, with quotes and delimiters in quotes,
#: with CRLF and an empty line in quotes, followed by a blank line, with a quote in a plain field.
derive(
    "record_lines",
    """SELECT p_partkey % 5 AS file, p_partkey % 6 AS kind, p_partkey, 0 AS k, CAST(p_partkey AS STRING) || CASE p_partkey % 6 WHEN 0 THEN ';' || p_name || ';x'
        WHEN 1 THEN ';"' || p_name WHEN 2 THEN ';"' || p_name || '""q"";";"a;""b""' || CHR(34) WHEN 3 THEN ';"' || p_name || CHR(13) WHEN 4 THEN ';' || p_name || ';'
        ELSE ';5" ' || p_name || ';"x"' END AS value FROM {part}
      UNION ALL SELECT p_partkey % 5, p_partkey % 6, p_partkey, 1, CASE p_partkey % 6 WHEN 1 THEN 'second";x' ELSE '' END FROM {part} WHERE p_partkey % 6 IN (1, 3, 4)
      UNION ALL SELECT p_partkey % 5, p_partkey % 6, p_partkey, 2, 'end" tail;x' || CHR(13) FROM {part} WHERE p_partkey % 6 = 3""",
)
catalog.query(
    "SRC-07-multiline",
    """SELECT file, row_number() OVER (PARTITION BY file ORDER BY p_partkey) - 1 AS record_no, CAST(p_partkey AS STRING) AS cell_0,
      CASE p_partkey % 6 WHEN 1 THEN p_name || CHR(10) || 'second' WHEN 2 THEN p_name || '"q";' WHEN 3 THEN p_name || CHR(13) || CHR(10) || CHR(10) || 'end tail'
        WHEN 5 THEN '5" ' || p_name ELSE p_name END AS cell_1,
      CASE p_partkey % 6 WHEN 2 THEN 'a;"b"' WHEN 4 THEN '' ELSE 'x' END AS cell_2, 3 AS n_cells
    FROM (SELECT *, p_partkey % 5 AS file FROM {part}) s""",
    lines="record_lines",
)(
    lambda lines: record_cells(
        quoted_records(
            lines.select("file", "value", (F.col("p_partkey") * 4 + F.col("k")).alias("_id"), F.lit(";").alias("delimiter")), 6
        )
    ).select("file", "record_no", *[F.get("cells", F.lit(k)).alias(f"cell_{k}") for k in range(3)], F.size("cells").alias("n_cells"))
)
catalog.query(
    "PRO-12",
    """SELECT DISTINCT resource_name, ['adjudicaciones', 'convocatorias', 'sipro', 'sibys', 'other'][kind + 1] AS resource_type,
      ['P0_ECONOMIC', 'P2_HISTORICAL', 'P1_SUPPLIER_INTELLIGENCE', 'P1_TAXONOMY', 'P2_HISTORICAL'][kind + 1] AS value_class FROM {bulk_cells}""",
    df="bulk_cells",
)(lambda df: _bulk(df.withColumn("process", F.lit("x"))).select("resource_name", "resource_type", "value_class").distinct())

# --- landed search results -------------------------------------------------------------------------


def obj(body: str) -> str:
    """SQL text of a JSON object around ``body`` (an SQL string expression)."""
    return f"CHR(123) || {body} || CHR(125)"


derive(
    "landed_notices",
    f"""SELECT p_partkey AS arrival, p_partkey, CASE WHEN p_partkey % 7 = 6 THEN 'oops' ELSE {obj('''
        '"notice-title": "' || p_name || '"' || CASE WHEN p_partkey % 7 = 5 THEN '' ELSE ', "publication-number": "' || CAST(p_partkey AS STRING) || '-2024"' END
        || CASE p_partkey % 3 WHEN 0 THEN ', "links": ' || CHR(123) || '"xml": ' || CHR(123) || '"ENG": "x/eng", "MUL": "x/mul"' || CHR(125) || CHR(125)
             WHEN 1 THEN ', "links": ' || CHR(123) || '"html": ' || CHR(123) || '"SPA": "h/spa"' || CHR(125) || CHR(125) ELSE '' END''')} END AS payload FROM {{part}}""",
)
catalog.query(
    "SRC-08",
    """SELECT arrival, CASE WHEN p_partkey % 7 < 5 THEN CAST(p_partkey AS VARCHAR) || '-2024' END AS source_record_id,
      CASE WHEN p_partkey % 7 = 6 THEN 'UNKNOWN' WHEN p_partkey % 3 = 0 THEN 'x/mul' WHEN p_partkey % 3 = 1 THEN 'h/spa'
        WHEN p_partkey % 7 = 5 THEN 'UNKNOWN' ELSE 'https://notices.example/' || CAST(p_partkey AS VARCHAR) || '-2024/xml' END AS source_url,
      CASE p_partkey % 7 WHEN 6 THEN 'invalid raw JSON' WHEN 5 THEN 'missing source_record_id' END AS reject_reason,
      CASE WHEN p_partkey % 7 = 6 THEN 'UNKNOWN' ELSE (SELECT p_name FROM part p WHERE p.p_partkey = n.p_partkey) END AS title_raw FROM {landed_notices} n""",
    df="landed_notices",
)(
    lambda df: ev.notice_documents(df, "https://notices.example/%s/xml").select(
        "arrival", "source_record_id", "source_url", "reject_reason", "title_raw"
    )
)
derive(
    "landed_awards",
    f"""SELECT c_custkey AS arrival, CASE WHEN c_custkey % 9 = 8 THEN '[]' ELSE {obj('''
        CASE WHEN c_custkey % 9 = 7 THEN '' WHEN c_custkey % 9 = 6 THEN '"internal_id": ' || CAST(c_custkey AS STRING) || ', ' ELSE '"generated_internal_id": "A' || CAST(c_custkey AS STRING) || '", ' END
        || '"Recipient Name": "' || c_name || '", "Award Amount": ' || CAST(CAST(FLOOR(c_acctbal) AS BIGINT) AS STRING)
        || CASE WHEN c_custkey % 2 = 0 THEN ', "Contract Description": "' || c_mktsegment || '"' ELSE '' END''')} END AS payload,
      c_name, c_mktsegment, c_acctbal FROM {{customer}}""",
)
_AID = "CASE WHEN arrival % 9 = 6 THEN CAST(arrival AS VARCHAR) WHEN arrival % 9 < 6 THEN 'A' || arrival END"
catalog.query(
    "SRC-09",
    f"""SELECT arrival, {_AID} AS source_record_id, 'https://awards.example/' || {_AID} AS source_url,
      CASE arrival % 9 WHEN 8 THEN 'raw content must be a JSON object' WHEN 7 THEN 'missing generated_internal_id' END AS reject_reason,
      CASE WHEN arrival % 9 < 8 AND arrival % 2 = 0 THEN c_mktsegment ELSE 'UNKNOWN' END AS description_raw,
      CASE WHEN arrival % 9 < 8 THEN CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) ELSE 'UNKNOWN' END AS award_amount_raw FROM {{landed_awards}}""",
    df="landed_awards",
)(
    lambda df: ev.award_documents(df, "https://awards.example/%s").select(
        "arrival",
        "source_record_id",
        F.when(F.col("source_record_id").isNotNull(), F.col("source_url")).alias("source_url"),
        "reject_reason",
        "description_raw",
        "award_amount_raw",
    )
)
catalog.query(
    "SRC-10",
    """SELECT o_orderkey AS arrival, CASE WHEN no NOT IN (0, 1, 2) THEN 'PURCHASE_ORDER:OC-' || o_orderkey END AS source_record_id,
      CASE no WHEN 0 THEN 'invalid raw JSON' WHEN 1 THEN 'raw content must be a JSON object' WHEN 2 THEN 'missing Codigo' END AS reject_reason,
      items_n AS items_count, items_n > 1 AS has_several_items, items_n - CASE WHEN no = 7 THEN 1 ELSE 0 END AS quantity_fields_present, units_n AS unit_fields_present
    FROM {order_documents}""",
    df="order_documents",
)(
    lambda df: ev.order_documents(
        df.select(F.col("o_orderkey").alias("arrival"), F.col("raw_content").alias("payload")),
        "https://orders.example/?codigo=%s",
    ).select(
        "arrival",
        "source_record_id",
        "reject_reason",
        "items_count",
        "has_several_items",
        "quantity_fields_present",
        "unit_fields_present",
    )
)
# Keys out of order, a repeated key, numbers in several spellings, escapes, characters beyond ASCII, odd spaces.
derive(
    "landed_records",
    f"""SELECT p_partkey AS arrival, p_name, CAST(FLOOR(p_retailprice) AS BIGINT) AS whole, {obj('''
        '"z" : ' || CAST(CAST(FLOOR(p_retailprice) AS BIGINT) AS STRING) || '.50,"publication-number":"' || CAST(p_partkey AS STRING) || '-2024", "generated_internal_id": "A' || CAST(p_partkey AS STRING)
        || '", "Codigo": "OC-' || CAST(p_partkey AS STRING) || '", "a":[1,2.0E1 , ' || CHR(123) || '"y":null,"b": true, "Ñ": "x"' || CHR(125) || ' ,[]], "n": "old",  "n": "' || p_name || ' \\u00e1\\/ñ"' ''')} AS payload FROM {{part}}""",
)
_CANONICAL = obj("""'"Codigo": "OC-' || arrival || '", "a": [1, 20.0, ' || CHR(123) || '"b": true, "y": null, "Ñ": "x"' || CHR(125)
  || ', []], "generated_internal_id": "A' || arrival || '", "n": "' || p_name || ' á/ñ", "publication-number": "' || arrival || '-2024", "z": ' || whole || '.5'""")


@catalog.query(
    "SRC-08-content",
    f"""SELECT arrival, source, {_CANONICAL} AS raw_content, sha256({_CANONICAL}) AS content_hash
    FROM {{landed_records}}, (SELECT unnest(['notices', 'awards', 'orders']) AS source) s""",
    df="landed_records",
)
def landed_content(df):
    made = (
        ev.notice_documents(df, "n/%s"),
        ev.award_documents(df, "a/%s"),
        ev.order_documents(df, "o/%s"),
    )
    names = ("notices", "awards", "orders")
    rows = [m.select("arrival", F.lit(n).alias("source"), "raw_content", "content_hash") for m, n in zip(made, names)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


derive("full_notice_documents", "SELECT page_id AS arrival, 'N' || CAST(page_id AS STRING) AS source_record_id FROM {pages}")
derive(
    "full_notice_responses",
    """SELECT 'N' || CAST(page_id AS STRING) AS source_record_id, page_id % 6 AS no,
      CASE page_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 202 WHEN 2 THEN 404 ELSE 200 END AS status_code,
      CASE WHEN page_id % 6 = 3 THEN 'image/png' ELSE 'text/html' END AS content_type,
      CASE WHEN page_id % 6 IN (1, 2) THEN '' WHEN page_id % 6 = 3 THEN 'binary' ELSE html END AS body,
      CASE WHEN page_id % 12 = 1 THEN 'challenge' ELSE '' END AS waf_action, 'timed out' AS error FROM {pages}""",
)
catalog.query(
    "SRC-11",
    """SELECT arrival, CASE no WHEN 0 THEN 'FAILED' WHEN 1 THEN 'NOT_AVAILABLE' WHEN 2 THEN 'NOT_AVAILABLE' WHEN 3 THEN 'REJECTED' ELSE 'ACCEPTED' END AS outcome,
      CASE no WHEN 0 THEN 'timed out' WHEN 1 THEN 'ted_direct_link_not_available: status=202 ' || CASE WHEN arrival % 12 = 1 THEN 'waf_action=challenge' ELSE 'empty body' END
        WHEN 2 THEN 'ted_direct_link_not_available: status=404 body_length=0' WHEN 3 THEN 'unexpected content_type=image/png' END AS reason
    FROM {full_notice_documents} JOIN {full_notice_responses} USING (source_record_id)""",
    docs="full_notice_documents",
    responses="full_notice_responses",
)(lambda docs, responses: ev.enrich_full_notices(docs, responses).select("arrival", "outcome", "reason"))

# --- run log ---------------------------------------------------------------------------------

derive(
    "acquisition_log",
    """SELECT event_id, CASE WHEN event_type <> 'error' THEN NULL ELSE CASE user_id % 5 WHEN 0 THEN 'SSLError: certificate verify failed' WHEN 1 THEN 'ReadTimeout: timed out'
        WHEN 2 THEN 'HTTPError: 404 Client Error' WHEN 3 THEN 'ConnectionError: Failed to resolve host' ELSE 'ConnectionError: refused' END END AS error, user_id,
      CASE WHEN value < 5 THEN 'DUPLICATE' ELSE 'ACQUIRED' END AS raw_outcome, CAST(FLOOR(value) AS BIGINT) AS observations_new,
      user_id % 3 AS observations_duplicate, CAST(FLOOR(value) AS BIGINT) + user_id % 3 AS exact_prices, event_type FROM {events}""",
)
catalog.query(
    "SRC-12",
    """SELECT event_id, CASE WHEN error IS NOT NULL THEN ['TLS_CERTIFICATE_ERROR', 'TIMEOUT', 'HTTP_ERROR', 'DNS_ERROR', 'CONNECTION_ERROR'][CAST(user_id % 5 + 1 AS INTEGER)] END AS error_type
      FROM {acquisition_log}""",
    log="acquisition_log",
)(lambda log: log.select("event_id", ev.acquisition_failure(F.col("error")).alias("error_type")))
catalog.query(
    "SRC-13",
    """SELECT count(*) AS sources_attempted, count(*) FILTER (error IS NULL) AS sources_succeeded, count(error) AS sources_failed,
      count(*) FILTER (error IS NULL AND raw_outcome = 'ACQUIRED') AS raw_docs_acquired, count(*) FILTER (error IS NULL AND raw_outcome = 'DUPLICATE') AS raw_docs_duplicate,
      sum(observations_new) FILTER (error IS NULL)::BIGINT AS observations_extracted, sum(observations_duplicate) FILTER (error IS NULL)::BIGINT AS observations_duplicate,
      sum(exact_prices) FILTER (error IS NULL)::BIGINT AS exact_prices FROM {acquisition_log}""",
    log="acquisition_log",
)(ev.acquisition_counters)
catalog.query(
    "SRC-14",
    """SELECT source, count(*) AS exact_prices, count(*) FILTER (currency = 'USD') AS comparable_core, count(*) FILTER (currency = 'ARS') AS indeterminate
      FROM {observations} GROUP BY source""",
    df="observations",
)(
    lambda df: ev.page_summary(
        df.select(
            "source",
            F.col("price").alias("price_value"),
            F.when(F.col("currency") == "USD", "COMPARABLE_CORE")
            .otherwise("INDETERMINATE")
            .alias("comparable_status"),
        )
    )
)
catalog.query(
    "SRC-15",
    "SELECT doc_id, lang, source FROM documents WHERE lang = 'es' ORDER BY doc_id LIMIT 50",
    df="documents",
)(lambda df: fi.list_evidence(df, {"lang": "es"}, "doc_id", 50).select("doc_id", "lang", "source"))
catalog.query(
    "SRC-16",
    "SELECT count(*) AS n FROM documents WHERE lang = 'es' AND source = 'src3'",
    df="documents",
)(lambda df: fi.count_evidence(df, {"lang": "es", "source": "src3", "n_chars": None}))

# --- feeds and orders ---------------------------------------------------------------------------

_ITEM = """CHR(123) || '"id_producto": 1, "nombre": "' || {name} || '", "precioEspecial": ' || {special} || ', "precioLista": ' || {list} || CHR(125)"""


def _item(name: str, special: str, listed: str) -> str:
    return _ITEM.format(name=name, special=special, list=listed)


derive(
    "feeds",
    f"""SELECT p_partkey AS feed_id, p_partkey % 3 AS no, CAST(FLOOR(p_retailprice) AS BIGINT) AS amount, p_name,
      '[' || {_item("p_name", "'0'", "CAST(CAST(FLOOR(p_retailprice) AS BIGINT) AS STRING) || '.7'")} || ', '
        || {_item("' ' || p_name || ' '", "'55'", "'60'")} || ', 7, ' || CHR(123) || '"nombre": "sin id", "precioLista": 5' || CHR(125) || ', '
        || {_item("'caro'", "CASE WHEN p_partkey % 3 = 0 THEN '\"x\"' ELSE '99.9' END", "'1'")} || ', '
        || CHR(123) || '"id_producto": 2, "nombre": 12, "precioLista": 5' || CHR(125) || ']' AS payload FROM {{part}}""",
)
catalog.query(
    "SRC-20",
    """SELECT feed_id, 0 AS position, p_name AS service_raw, CAST(amount AS VARCHAR) || '.7' AS price_raw, amount AS price FROM {feeds}
      UNION ALL SELECT feed_id, 4, 'caro', '99.9', 99 FROM {feeds} WHERE no <> 0""",
    df="feeds",
)(lambda df: ev.feed_offers(df))


@catalog.query(
    "SRC-22",
    """WITH o AS (SELECT o_orderkey % 9000 AS doc, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderkey % 9000 >= 500 GROUP BY 1)
    SELECT l_orderkey AS raw_order, count(*) AS lines FROM lineitem JOIN o ON l_orderkey = o.o_orderkey GROUP BY 1""",
    orders="orders",
    lines="lineitem",
)
def orders_with_lines(orders, lines):
    keyed = orders.select(
        (F.col("o_orderkey") % 9000).alias("doc"),
        F.lit("v1").alias("extractor_version"),
        F.col("o_orderkey").alias("raw_document_id"),
    )

    stored = keyed.where("doc < 500").select("doc", "extractor_version")  # an earlier run's
    new = only_new(keyed, ("doc", "extractor_version"), "raw_document_id", stored)
    kept = with_children(new, lines.withColumn("raw_document_id", F.col("l_orderkey")), ("raw_document_id",))
    return kept.groupBy(F.col("l_orderkey").alias("raw_order")).agg(F.count(F.lit(1)).alias("lines"))


# Three deliveries: every third order, the others, and all of them again.
@catalog.query(
    "SRC-22-committed",
    """WITH o AS (SELECT o_orderkey % 9000 AS doc, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 2 END AS version FROM orders),
      f AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY version, o_orderkey) AS place FROM o)
    SELECT doc, o_orderkey AS raw_order, version, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS lines FROM f WHERE place = 1""",
    orders="orders",
    lines="lineitem",
)
def committed_orders(orders, lines):
    spark, root = orders.sparkSession, new_shared_folder(orders.sparkSession, "orders")
    keyed = orders.select(
        (F.col("o_orderkey") % 9000).alias("doc"),
        F.lit("v1").alias("extractor_version"),
        F.col("o_orderkey").alias("raw_document_id"),
    )
    items = lines.select(F.col("l_orderkey").alias("raw_document_id"), "l_linenumber")
    third = F.col("raw_document_id") % 3 == 0
    for version, part in enumerate((third, ~third, F.lit(True)), 1):
        cm.commit_orders(
            spark,
            root,
            keyed.filter(part).withColumn("version", F.lit(version)),
            items.filter(part),
            "raw_document_id",
            key=("doc", "extractor_version"),
        )
    counted = cm.read_committed(spark, root, "lines").groupBy("raw_document_id").agg(F.count(F.lit(1)).alias("lines"))
    return (
        cm.read_committed(spark, root, "orders")
        .join(counted, "raw_document_id", "left")
        .select("doc", F.col("raw_document_id").alias("raw_order"), "version", F.coalesce("lines", F.lit(0)).alias("lines"))
    )
