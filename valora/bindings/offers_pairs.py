"""Offers from two-price lists, comparability and service summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from valora.bindings.base import Catalog, LINE_ID, derive
from valora.bindings.text_prices import CITY_SQL, COMPANY_SQL, PROVINCE_SQL, SERVICE_SQL, SERVICE_TEXTS
from valora.operators import comparability as cm
from valora.operators import offers as of
from valora.operators.semantic import cohort_contract
from valora.plans.pricing_job import run_offer_sources
from valora.operators.dedup import only_new

catalog = Catalog()

_ARMS = " ".join(f"WHEN {i} THEN {t}" for i, (t, _) in enumerate(SERVICE_TEXTS))
_A = "(CAST(FLOOR(l_extendedprice) AS BIGINT) + 1000)"
derive(
    "offer_dtos",
    f"""SELECT {LINE_ID} AS offer_id, l_orderkey, s_suppkey, company_raw, province_raw, city_raw,
      'src' || CAST(s_suppkey % 7 AS STRING) AS source, p_partkey % 8 AS kind,
      CASE WHEN p_size = 5 THEN '' ELSE CASE p_partkey % 8 {_ARMS} END END AS service_raw,
      {_A} AS amount, l_linenumber % 7 AS shape,
      CASE l_linenumber % 7 WHEN 0 THEN {_A} WHEN 1 THEN 0 ELSE NULL END AS price,
      'ARS' AS currency, CAST(l_shipdate AS STRING) AS observed_on,
      CASE l_linenumber % 7 WHEN 1 THEN '$ 5000' WHEN 2 THEN 'USD ' || CAST({_A} AS STRING)
        WHEN 3 THEN '$ ' || CAST({_A} AS STRING) || ' / MES' WHEN 4 THEN 'Consultar' ELSE NULL END AS price_raw,
      CASE WHEN l_linenumber % 7 IN (5, 6) THEN '$ ' || CAST({_A} AS STRING) ELSE NULL END AS price_freelance_raw,
      CASE l_linenumber % 7 WHEN 5 THEN '$' || CAST({_A} + 700 AS STRING) WHEN 6 THEN '$ 15' ELSE '' END AS price_local_raw,
      CASE WHEN l_returnflag = 'R' THEN 'timeout' ELSE NULL END AS load_error
    FROM {{lineitem}} JOIN {{companies}} ON l_suppkey = s_suppkey JOIN {{part}} ON l_partkey = p_partkey""",
)
_NORMAL = f"{COMPANY_SQL} AS company, {PROVINCE_SQL} AS province, {CITY_SQL} AS city"

catalog.query(
    "OFR-01",
    f"SELECT offer_id, company_raw, {_NORMAL} FROM {{offer_dtos}}",
    df="offer_dtos",
)(
    lambda df: of.normalize_offers(df).select("offer_id", "company_raw", "company", "province", "city")
)
_CELLS = """SELECT *, NULL AS modality, NULL AS modality_raw FROM {offer_dtos} WHERE shape < 5
  UNION ALL SELECT *, 'freelance', price_freelance_raw FROM {offer_dtos} WHERE shape >= 5
  UNION ALL SELECT *, 'local', price_local_raw FROM {offer_dtos} WHERE shape >= 5"""
catalog.query(
    "OFR-02",
    f"SELECT offer_id, modality, modality_raw FROM ({_CELLS})",
    df="offer_dtos",
)(lambda df: of.fan_out_modalities(df).select("offer_id", "modality", "modality_raw"))

_BUILT = f"""SELECT *, {SERVICE_SQL} AS service, {_NORMAL},
  CASE WHEN shape = 1 THEN 'PRECIO_NO_REPRESENTABLE: precio=0'
    WHEN shape = 4 THEN 'PRECIO_NO_REPRESENTABLE: precio_raw=''Consultar'''
    WHEN shape = 6 AND modality = 'local' THEN 'PRECIO_AMBIGUO: modalidad=local, precio_raw=''$ 15''' END AS reason
  FROM ({_CELLS})"""
catalog.query(
    "OFR-03",
    f"SELECT source, reason FROM ({_BUILT}) WHERE service_raw <> '' AND reason IS NOT NULL",
    df="offer_dtos",
)(lambda df: of.rejects_only(of.build_offers(df)))
OFFERS_SQL = f"""SELECT offer_id, company, province, city, source, service, service_raw, modality,
    CASE WHEN modality = 'local' THEN amount + 700 ELSE amount END AS price_value,
    CASE WHEN shape = 2 THEN 'USD' ELSE 'ARS' END AS currency, CASE WHEN shape = 3 THEN 'mensual' END AS period
  FROM ({_BUILT}) WHERE service_raw <> '' AND reason IS NULL"""
_OFFER = ("offer_id", "company", "province", "city", "source", "service", "service_raw", "modality")
_OFFER += ("price_value", "currency", "period")
catalog.query("OFR-04", OFFERS_SQL, df="offer_dtos")(
    lambda df: of.offers_only(of.build_offers(df)).select(*_OFFER)
)
catalog.query(
    "OFR-05",
    """SELECT source, max(load_error) IS NULL AS ok, count(*) FILTER (load_error IS NULL) AS rows_read
      FROM {offer_dtos} GROUP BY source""",
    df="offer_dtos",
)(
    lambda df: run_offer_sources(df)["runs"].select(
        "source", (F.col("status") == "SUCCESS").alias("ok"), "rows_read"
    )
)
derive(
    "price_lists",
    f"""SELECT {LINE_ID} AS offer_id, CASE WHEN l_linenumber = 4 THEN ' ' ELSE p_name END AS service_raw,
      'list' AS source, CASE WHEN l_quantity < 10 THEN 'consultar' ELSE '$ ' || CAST(CAST(FLOOR(l_extendedprice) AS BIGINT) AS STRING) END AS price_freelance_raw,
      CASE WHEN l_quantity < 5 THEN '' ELSE '$ ' || CAST(CAST(FLOOR(l_extendedprice) AS BIGINT) * 2 AS STRING) END AS price_local_raw,
      CAST(FLOOR(l_extendedprice) AS BIGINT) AS amount, l_quantity, l_linenumber
    FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey""",
)
catalog.query(
    "OFR-06",
    """SELECT offer_id, CASE WHEN l_linenumber = 4 THEN 'sin servicio' WHEN l_quantity < 5 THEN 'sin ningún precio válido' END AS reject_reason,
      CASE WHEN l_linenumber <> 4 AND l_quantity >= 5 THEN CASE WHEN l_quantity < 10 THEN amount * 2 ELSE amount END END AS price
    FROM {price_lists}""",
    df="price_lists",
)(lambda df: of.price_list_rows(df).select("offer_id", "reject_reason", "price"))

# --- idempotent offers ----------------------------------------------------------------------------



@catalog.query(
    "SRC-21",
    f"""SELECT company, source, service_raw, count(*) AS offers FROM (
      SELECT DISTINCT company, source, province, city, service_raw, price_id, currency, period, observed_on, modality FROM (
        SELECT *, CASE WHEN modality = 'local' THEN price_local_raw WHEN modality = 'freelance' THEN price_freelance_raw
          WHEN price_raw IS NOT NULL THEN price_raw ELSE CAST(amount AS VARCHAR) END AS price_id,
          CASE WHEN shape = 3 THEN 'mensual' END AS period
        FROM ({_BUILT}) WHERE service_raw <> '' AND reason IS NULL AND source <> 'src0')) GROUP BY ALL""",
    df="offer_dtos",
)
def stored_offers(df):
    offers = of.with_identity(of.offers_only(of.build_offers(df)))
    stored = offers.where("source = 'src0'")  # an earlier run took this source
    counted = ("company", "source", "service_raw")
    new = only_new(offers, of.OFFER_IDENTITY, "offer_id", stored, counted)
    return new.groupBy(*counted).agg(F.count(F.lit(1)).alias("offers"))


# --- summaries -------------------------------------------------------------------------------------


@catalog.query(
    "AGG-05",
    f"""SELECT round(avg(price_value), 4) AS avg_price, min(price_value)::DOUBLE AS min_price, max(price_value)::DOUBLE AS max_price
      FROM ({OFFERS_SQL}) WHERE period IS NULL""",
    df="offer_dtos",
)
def one_off_prices(df):
    stats = of.one_off_statistics(of.offers_only(of.build_offers(df)))
    return stats.withColumn("avg_price", F.round("avg_price", 4))


@catalog.query(
    "AGG-06",
    f"""SELECT service, round(avg(price_value), 4) AS avg_price FROM ({OFFERS_SQL}) WHERE period IS NULL GROUP BY service""",
    df="offer_dtos",
)
def service_averages(df):
    stats = of.one_off_statistics(of.offers_only(of.build_offers(df)), ["service"])
    return stats.select("service", F.round("avg_price", 4).alias("avg_price"))


@catalog.query(
    "AGG-07",
    f"""SELECT service, count(*) AS offers_n, count(DISTINCT (company, province, city, source)) AS companies_n,
      round(avg(price_value) FILTER (period IS NULL), 4) AS avg_price, min(price_value) FILTER (period IS NULL)::DOUBLE AS min_price,
      max(price_value) FILTER (period IS NULL)::DOUBLE AS max_price FROM ({OFFERS_SQL}) GROUP BY service""",
    df="offer_dtos",
)
def service_summaries(df):
    out = of.service_summary(of.offers_only(of.build_offers(df)))
    return out.withColumn("avg_price", F.round("avg_price", 4))


catalog.query(
    "AGG-07-prices",
    f"SELECT service, company, modality, price_value, currency, period FROM ({OFFERS_SQL})",
    df="offer_dtos",
)(lambda df: of.company_prices(of.offers_only(of.build_offers(df))))


@catalog.query(
    "AGG-08",
    f"""SELECT 'formateo' AS requested, count(*) AS offers_n, count(DISTINCT (company, province, city, source)) AS companies_n,
      min(price_value) FILTER (period IS NULL)::DOUBLE AS min_price, max(price_value) FILTER (period IS NULL)::DOUBLE AS max_price,
      array_to_string(list_sort(list(DISTINCT city)), '|') AS cities, array_to_string(list_sort(list(DISTINCT province)), '|') AS provinces
    FROM ({OFFERS_SQL}) WHERE service = 'formateo' AND lower(province) = 'córdoba'""",
    df="offer_dtos",
)
def service_lookup(df):
    out = of.lookup_service(of.offers_only(of.build_offers(df)), "formateo", province="CÓRDOBA")
    return out.select(
        "requested",
        "offers_n",
        "companies_n",
        "min_price",
        "max_price",
        F.array_join("cities", "|").alias("cities"),
        F.array_join("provinces", "|").alias("provinces"),
    )


catalog.query(
    "AGG-08-companies",
    f"""SELECT service, company, province, city, source, modality, price_value, currency, period
    FROM ({OFFERS_SQL}) WHERE service = 'formateo' AND lower(province) = 'córdoba'""",
    df="offer_dtos",
)(lambda df: of.service_companies(of.offers_only(of.build_offers(df)), "formateo", province="CÓRDOBA"))

# --- comparability -----------------------------------------------------------------------------

derive(
    "comparable_offers",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {LINE_ID} AS offer_id, p_brand, 's' || CAST(l_suppkey % 20 AS STRING) AS source,
      CASE p_size % 5 WHEN 0 THEN p_name || ' con EQUIPO' WHEN 1 THEN p_name || ' hardware e insumo' ELSE p_name END AS service_raw,
      CASE WHEN l_returnflag = 'A' THEN 'mensual' ELSE NULL END AS period, l_linestatus = 'O' AS period_known,
      CASE WHEN l_tax = 0.0 THEN 'Orientativo $ 10' ELSE '$ 10' END AS price_raw, p_size
    FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey""",
)
_SIG = """SELECT *, source <> 's3' AS fit, CASE p_size % 5 WHEN 0 THEN 1 WHEN 1 THEN 6 ELSE 0 END AS sc,
  CASE WHEN period_known THEN coalesce(period, 'puntual') END AS per, price_raw LIKE 'Orient%' AS ind FROM {comparable_offers}"""
_CAUSE = """CASE WHEN NOT (l.fit AND r.fit) THEN 'fuente_no_apta' WHEN l.sc <> r.sc THEN 'scope_material_distinto'
  WHEN (l.per IS NULL) <> (r.per IS NULL) THEN 'periodicidad_desconocida' WHEN l.per <> r.per THEN 'periodicidad_incompatible'
  WHEN l.per <> 'puntual' THEN 'unidad_economica_desconocida' END"""


def _state(cause: str) -> str:
    return f"""CASE WHEN {cause} IS NULL THEN 'potencialmente_comparable'
      WHEN {cause} IN ('scope_material_distinto', 'periodicidad_incompatible') THEN 'no_comparable' ELSE 'indeterminado' END"""


derive(
    "next_lines",
    """SELECT a.offer_id AS left_id, b.offer_id AS right_id FROM {comparable_offers} a
    JOIN {comparable_offers} b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber + 1 = b.l_linenumber""",
)
_PAIRED = f"""SELECT left_id, right_id, {_CAUSE} AS cause, CASE WHEN l.ind OR r.ind THEN 'precio_orientativo' END AS w
  FROM {{next_lines}} JOIN ({_SIG}) l ON left_id = l.offer_id JOIN ({_SIG}) r ON right_id = r.offer_id"""


def _pairs(offers, pairs):
    return cm.compare_pairs(offers, pairs, ("s3",))


catalog.query(
    "CMP-01",
    f"SELECT left_id, right_id, {_state('cause')} AS state, cause FROM ({_PAIRED})",
    offers="comparable_offers",
    pairs="next_lines",
)(lambda offers, pairs: _pairs(offers, pairs).select("left_id", "right_id", "state", "cause"))
catalog.query(
    "CMP-02",
    f"SELECT left_id, right_id, CASE WHEN cause IS NULL THEN w END AS warning FROM ({_PAIRED})",
    offers="comparable_offers",
    pairs="next_lines",
)(lambda offers, pairs: _pairs(offers, pairs).select("left_id", "right_id", "warning"))
catalog.query(
    "CMP-01-counts",
    f"""SELECT p_brand, {_state('cause')} AS state, cause, warning, sum(n)::BIGINT AS pairs FROM (
      SELECT p_brand, cause, CASE WHEN cause IS NULL THEN w END AS warning, n FROM (
        SELECT l.p_brand, {_CAUSE} AS cause, CASE WHEN l.ind OR r.ind THEN 'precio_orientativo' END AS w,
          CASE WHEN (l.fit, l.sc, coalesce(l.per, '?'), l.ind) = (r.fit, r.sc, coalesce(r.per, '?'), r.ind) THEN l.n * (l.n - 1) // 2 ELSE l.n * r.n END AS n
        FROM (SELECT p_brand, fit, sc, per, ind, count(*) AS n FROM ({_SIG}) GROUP BY ALL) l
        JOIN (SELECT p_brand, fit, sc, per, ind, count(*) AS n FROM ({_SIG}) GROUP BY ALL) r
          ON l.p_brand = r.p_brand AND (l.fit, l.sc, coalesce(l.per, '?'), l.ind) <= (r.fit, r.sc, coalesce(r.per, '?'), r.ind)))
      GROUP BY p_brand, cause, warning HAVING sum(n) > 0""",
    offers="comparable_offers",
)(lambda offers: cm.pair_verdict_counts(offers, ["p_brand"], ("s3",)))
catalog.query(
    "CMP-03",
    "SELECT offer_id FROM {comparable_offers} WHERE period IS NULL",
    offers="comparable_offers",
)(lambda offers: offers.filter(cm.is_one_off(F.col("period"))).select("offer_id"))
derive(
    "os_offers",
    """SELECT p_partkey, p_partkey % 5 AS shape, CASE p_partkey % 5
      WHEN 0 THEN 'Instalación de Sistema Operativo sin backup ' || p_name
      WHEN 1 THEN 'Sistema operativo con backup ' || p_name
      WHEN 2 THEN 'Sistema operativo SIN  BACKUP + limpieza ' || p_name
      WHEN 3 THEN 'SISTEMA OPERATIVO sin' || CHR(10) || 'Backup ' || p_name ELSE p_name END AS text FROM {part}""",
)
catalog.query(
    "CMP-04",
    "SELECT p_partkey, CASE WHEN shape IN (0, 3) THEN 'COMPARABLE_CORE' ELSE 'INDETERMINATE' END AS status FROM {os_offers}",
    df="os_offers",
)(lambda df: df.select("p_partkey", cohort_contract(F.col("text")).alias("status")))
