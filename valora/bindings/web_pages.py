"""Pages with prices and structured data, derived by adding content to the given pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from valora.bindings.base import Catalog, derive, dotted
from valora.functions.rules import joined
from valora.operators import pages as pg
from valora.plans.pricing_job import live_pricing

catalog = Catalog()

_A = "(page_id * 37 + 1500)"
_ADDED = f"""CASE page_id % 6
  WHEN 0 THEN '<table><tr><td>Formateo ' || CAST(page_id AS STRING) || '</td><td><b>$ ' || {dotted(_A)} || '</b></td></tr><tr><td>Formateo ' || CAST(page_id AS STRING) || '</td><td>$ ' || {dotted(_A)} || '</td></tr></table>'
  WHEN 1 THEN '<div><h3>Servicio ' || CAST(page_id AS STRING) || '</h3><span>' || CAST({_A} AS STRING) || ' ARS</span></div>'
  WHEN 2 THEN '<div class="product-item"><p>Soporte remoto</p><p>$ ' || CAST({_A} AS STRING) || '<sup>,50</sup></p></div>'
  WHEN 3 THEN '<ul><li>Limpieza ' || CAST(page_id AS STRING) || ' <strong>$ ' || {dotted(_A)} || '</strong></li></ul><a href="/producto/' || CAST(page_id AS STRING) || '">ver</a>'
  WHEN 4 THEN '<div>Consultar precio $ 0</div>' ELSE '' END"""
derive(
    "priced_pages",
    f"""SELECT page_id, url, page_id % 6 AS no, {_A} AS amount, REPLACE(html, '</article>', {_ADDED} || '</article>') AS html FROM {{pages}}""",
)
_SHOWN = "CASE no WHEN 0 THEN 'Formateo ' || page_id WHEN 1 THEN 'Servicio ' || page_id WHEN 3 THEN 'Limpieza ' || page_id END"
catalog.query(
    "WEB-01",
    f"""SELECT page_id, 0 AS ordinal, {_SHOWN} AS economic_object_raw, amount AS price_value, 'ARS' AS currency_raw FROM {{priced_pages}} WHERE no IN (0, 1, 3)""",
    df="priced_pages",
)(
    lambda df: pg.page_prices(df).select(
        "page_id", "ordinal", "economic_object_raw", "price_value", "currency_raw"
    )
)
_TAG = "length(regexp_replace(lower(html), '{0}', chr(1), 'g')) - length(replace(regexp_replace(lower(html), '{0}', chr(1), 'g'), chr(1), ''))"


def _tags(pattern: str) -> str:
    return _TAG.format(pattern)


catalog.query(
    "WEB-02",
    f"""SELECT page_id, strlen(html) AS bytes_n, {_tags('<table')} AS tables_n, {_tags('<script')} AS scripts_n, {_tags('<article')} + CASE WHEN no = 2 THEN 1 ELSE 0 END AS items_n,
      0 AS json_ld_n, CASE no WHEN 0 THEN '$ ' || {dotted('amount')} WHEN 2 THEN '$ ' || amount || ' ,50' WHEN 3 THEN '$ ' || {dotted('amount')} WHEN 4 THEN '$ 0' ELSE '' END AS prices,
      'HTTP_STATIC' AS strategy, 'A' AS difficulty, CASE WHEN no IN (1, 5) THEN 'sin precios detectables' ELSE '' END AS problems FROM {{priced_pages}}""",
    df="priced_pages",
)(
    lambda df: pg.page_signals(df).select(
        "page_id",
        "bytes_n",
        "tables_n",
        "scripts_n",
        "items_n",
        "json_ld_n",
        joined(F.col("prices")).alias("prices"),
        "strategy",
        "difficulty",
        joined(F.col("problems")).alias("problems"),
    )
)
_O, _C = "CHR(123)", "CHR(125)"
_OFFER = f"{_O} || '\"@type\": \"Offer\", \"price\": \"' || CAST({_A} AS STRING) || ',50\", \"priceCurrency\": \"ARS\"' || {_C}"
_PRODUCT = f"{_O} || '\"@type\": [\"Product\", \"Thing\"], \"name\": \"P' || CAST(page_id AS STRING) || '\", \"sku\": \"' || CAST(page_id AS STRING) || '\", \"offers\": ' || {_OFFER} || {_C}"
_UNIT = f"{_O} || '\"@type\": \"Offer\", \"itemOffered\": ' || {_O} || '\"@type\": \"Service\", \"name\": \"S\"' || {_C}"
_CATALOG = f"""{_O} || '"@graph": [' || {_O} || '"@type": "WebSite"' || {_C} || ', ' || {_O} || '"@type": ["LocalBusiness", "Store"], "name": "B' || CAST(page_id AS STRING)
  || '", "hasOfferCatalog": ' || {_O} || '"name": "C", "itemListElement": [' || {_UNIT} || ', "price": ' || CAST({_A} AS STRING) || {_C} || ', ' || {_UNIT} || {_C} || ']' || {_C} || {_C} || ']' || {_C}"""
derive(
    "structured_pages",
    f"""SELECT page_id, url, page_id % 3 AS no, {_A} AS amount, REPLACE(html, '</head>', '<script type="application/ld+json">' || CASE page_id % 3 WHEN 0 THEN {_PRODUCT}
      WHEN 1 THEN {_CATALOG} ELSE '{_O}broken' END || '</script></head>') AS html FROM {{pages}}""",
)
catalog.query(
    "WEB-03",
    """SELECT page_id, 'Product|Thing' AS types, 'P' || page_id AS name_raw, amount || ',50' AS price_raw, 'ARS' AS currency, amount + 0.5 AS possible_price, CAST(page_id AS VARCHAR) AS external_id FROM {structured_pages} WHERE no = 0
      UNION ALL SELECT page_id, 'Offer', NULL, amount || ',50', 'ARS', amount + 0.5, NULL FROM {structured_pages} WHERE no = 0
      UNION ALL SELECT page_id, 'Offer', NULL, CAST(amount AS VARCHAR), NULL, amount, NULL FROM {structured_pages} WHERE no = 1
      UNION ALL SELECT page_id, 'Offer', NULL, NULL, NULL, NULL, NULL FROM {structured_pages} WHERE no = 1
      UNION ALL SELECT page_id, 'Service', 'S', NULL, NULL, NULL, NULL FROM {structured_pages}, range(2) WHERE no = 1""",
    df="structured_pages",
)(
    lambda df: pg.json_ld_candidates(df).select(
        "page_id", "types", "name_raw", "price_raw", "currency", "possible_price", "external_id"
    )
)
catalog.query(
    "WEB-04",
    f"""SELECT url, strlen(r.html) - strlen(p.html) AS bytes_extra, CASE WHEN no = 2 THEN 1 ELSE 0 END AS items_extra, CASE WHEN no IN (0, 2, 3, 4) THEN 1 ELSE 0 END AS prices_extra,
      CASE no WHEN 0 THEN '$ ' || {dotted('amount')} WHEN 2 THEN '$ ' || amount || ' ,50' WHEN 3 THEN '$ ' || {dotted('amount')} WHEN 4 THEN '$ 0' ELSE '' END AS new_prices,
      CASE WHEN no = 3 THEN regexp_extract(url, '^(\\w+://[^/?#]+)', 1) || '/producto/' || page_id ELSE '' END AS detail_links_extra
    FROM {{priced_pages}} r JOIN pages p USING (page_id, url)""",
    rendered="priced_pages",
    plain="pages",
)(
    lambda rendered, plain: pg.compare_captures(
        pg.page_signals(plain), pg.page_signals(rendered), ["page_id", "url"]
    ).drop("page_id", "json_ld_extra")
)
catalog.query(
    "WEB-05",
    """SELECT page_id, 'B' || page_id AS provider_raw, 2 AS units_n, 1 AS prices_n, 1 AS offers_without_price_n FROM {structured_pages} WHERE no = 1""",
    df="structured_pages",
)(lambda df: pg.catalog_counts(pg.offer_catalogs(df)))

# --- whole job -----------------------------------------------------------------------------------

derive(
    "fetched_pages",
    """SELECT page_id AS arrival, 'site' || CAST(page_id % 7 AS STRING) AS source, url AS source_record_id, 'Salta' AS province, '' AS city, html AS raw_content,
      CASE WHEN no = 5 THEN 'timeout' ELSE NULL END AS error, no, amount, page_id FROM {priced_pages}""",
)
derive(
    "job_baseline",
    """SELECT source, 'Formateo ' || CAST(page_id AS STRING) AS economic_object_raw, CAST(amount AS STRING) AS price_value, 'ARS' AS currency, page_id AS row_number,
      CAST(page_id AS STRING) AS observation_id, 'Salta' AS province, '' AS city, 'SINGLE_SERVICE' AS semantic_role, 'LOCAL_SERVICE' AS market_scope,
      'FORMATEO' AS matched_services, 'FORMATEO' AS canonical_service, 'Salta::FORMATEO' AS comparability_key, 'X' AS original_comparable_status, 'v0' AS extractor_version
    FROM {fetched_pages}""",
)


@catalog.query(
    "DEC-04",
    """SELECT 'Salta' AS market, 'FORMATEO' AS canonical_service, count(*) AS observations_n, count(DISTINCT source) AS providers_n, min(amount)::DOUBLE AS min_ars,
      quantile_cont(amount, 0.25) AS q1_ars, quantile_cont(amount, 0.5) AS median_ars, max(amount)::DOUBLE AS max_ars FROM {fetched_pages} WHERE no = 0""",
    fetched="fetched_pages",
    baseline="job_baseline",
)
def live_job(fetched, baseline):
    return live_pricing(fetched, baseline)["cohorts"].select(
        "market", "canonical_service", "observations_n", "providers_n", "min_ars", "q1_ars", "median_ars", "max_ars"
    )


# The same job over markets: pages and baseline of one source lie in one province.
_PROVINCE = "CASE page_id % 5 WHEN 0 THEN 'Salta' WHEN 1 THEN 'Jujuy' WHEN 2 THEN 'Mendoza' WHEN 3 THEN 'Chaco' ELSE 'Formosa' END"
derive(
    "market_pages",
    f"""SELECT arrival, source, source_record_id, {_PROVINCE} AS province, city, raw_content, error, no, amount, page_id FROM {{fetched_pages}}""",
)
derive(
    "market_baseline",
    f"""SELECT source, economic_object_raw, price_value, currency, row_number, observation_id, {_PROVINCE.replace("page_id", "row_number")} AS province, city, semantic_role, market_scope,
      matched_services, canonical_service, comparability_key, original_comparable_status, extractor_version FROM {{job_baseline}}""",
)


@catalog.query(
    "DEC-04-markets",
    """SELECT province AS market, 'FORMATEO' AS canonical_service, count(*) AS observations_n, count(DISTINCT source) AS providers_n, min(amount)::DOUBLE AS min_ars,
      quantile_cont(amount, 0.25) AS q1_ars, quantile_cont(amount, 0.5) AS median_ars, max(amount)::DOUBLE AS max_ars FROM {market_pages} WHERE no = 0 GROUP BY province""",
    fetched="market_pages",
    baseline="market_baseline",
)
def live_job_of_markets(fetched, baseline):
    return live_job(fetched, baseline)
