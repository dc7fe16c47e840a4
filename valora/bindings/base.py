"""Business tables derived from the given tables.

Each derivation is one SQL text that both Spark and the checking engine can run, so a query
and its check start from the same rows. A derivation shapes input, and may select the rows that
an input is made of; it never runs an operator.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from valora.session import SCAN_PARTITIONS

TABLES = (
    "region nation customer supplier part orders lineitem events documents pages labels "
    "conversations"
).split()

LINE_ID = (
    "CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || "
    "CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING)"
)


def dotted(value: str) -> str:
    """Argentine thousands of a whole number below ten million."""
    thousands = f"CAST(FLOOR({value} / 1000) AS BIGINT)"
    return (
        f"CASE WHEN {value} < 1000 THEN CAST({value} AS STRING) "
        f"WHEN {value} < 1000000 THEN CAST({thousands} AS STRING) || '.' || "
        f"LPAD(CAST({value} % 1000 AS STRING), 3, '0') "
        f"ELSE CAST(CAST(FLOOR({value} / 1000000) AS BIGINT) AS STRING) || '.' || "
        f"LPAD(CAST({thousands} % 1000 AS STRING), 3, '0') || '.' || "
        f"LPAD(CAST({value} % 1000 AS STRING), 3, '0') END"
    )


def case(selector: str, texts: list[str]) -> str:
    """SQL CASE over 0..n-1; every entry is an SQL expression."""
    arms = " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(texts))
    return f"CASE {selector} {arms} END"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def filled(template: str, **parts: str) -> str:
    """SQL concatenation of a text with {name} holes."""
    pieces = re.split(r"(\{\w+\})", template)
    out = [parts[p[1:-1]] if re.fullmatch(r"\{\w+\}", p) else quoted(p) for p in pieces if p]
    return " || ".join(f"({o})" for o in out)


DERIVED: dict[str, str] = {}


def derive(name: str, sql: str) -> None:
    """Register ``sql``; other tables are named in braces."""
    DERIVED[name] = sql


def _needs(name: str) -> list[str]:
    return re.findall(r"\{(\w+)\}", DERIVED[name])


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or a derived one built lazily from given tables."""
    if name not in DERIVED:
        table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        dealt = spark.conf.get(SCAN_PARTITIONS, None)
        return table.repartition(int(dealt)) if dealt else table
    parts = {n: load(spark, sf_dir, n) for n in set(_needs(name))}
    return spark.sql(DERIVED[name], **parts)


def with_tables(sql: str) -> str:
    """The checking SQL with the derived tables it names in braces as CTEs."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in DERIVED and name not in order:
            for n in _needs(name):
                visit(n)
            order.append(name)

    for name in re.findall(r"\{(\w+)\}", sql):
        visit(name)
    ctes = ",\n".join(f"{n} AS ({_plain(DERIVED[n])})" for n in order)
    body = _plain(sql).strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def _plain(sql: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", sql)


class Catalog:
    """Queries and their checks, registered side by side."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self._sql: dict[str, str] = {}

    def add(self, name: str, query: Callable, sql: str | None = None) -> None:
        if name in self.queries:
            raise ValueError(f"{name} is registered twice")
        self.queries[name] = query
        if sql is not None:
            self._sql[name] = sql

    @property
    def checks(self) -> dict[str, str]:
        """Check SQL with its derived tables; built late, when all of them are registered."""
        return {name: with_tables(sql) for name, sql in self._sql.items()}

    def query(self, name: str, sql: str | None = None, **tables: str):
        """Decorator: the function receives the named tables as keyword DataFrames."""

        def register(build: Callable):
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return build(**{k: load(spark, sf_dir, v) for k, v in tables.items()})

            run.__name__ = build.__name__
            run.__doc__ = build.__doc__
            self.add(name, run, sql)
            return build

        return register


# --- price literals -------------------------------------------------------------------------------

_P = "(CAST(FLOOR(l_extendedprice) AS BIGINT) + 1000)"
_LITERALS = [
    f"'$ ' || {dotted(_P)}",
    f"'$' || CAST({_P} AS STRING)",
    f"CAST({_P} AS STRING)",
    f"'USD ' || CAST({_P} AS STRING)",
    f"'US$ ' || {dotted(_P)}",
    f"CAST({_P} AS STRING) || ' ARS'",
    f"'$ ' || {dotted(_P)} || ',00'",
    f"'Desde $ ' || {dotted(_P)}",
    f"'$ ' || {dotted(_P)} || ' - $ ' || {dotted('(' + _P + ' + 500)')}",
    "'Consultar precio'",
    f"'$ ' || CAST({_P} % 1000 AS STRING)",
    "'$ 0'",
    "''",
    f"'$ ' || {dotted(_P)} || ' / MES'",
    f"'U$S ' || CAST({_P} AS STRING)",
    f"'$ ' || {dotted(_P)} || ',50'",
    "'$ 40 - 60K'",
    f"'precio orientativo $ ' || {dotted(_P)}",
    f"'$ ' || CAST(FLOOR({_P} / 1000) AS BIGINT) || ',' || LPAD(CAST({_P} % 1000 AS STRING), 3, '0')",
]
N_LITERALS = len(_LITERALS)
_STYLE = f"(l_orderkey + l_linenumber) % {N_LITERALS}"
derive(
    "price_literals",
    f"SELECT {LINE_ID} AS line_id, CAST({_STYLE} AS BIGINT) AS style, {_P} AS amount, "
    f"{case(_STYLE, _LITERALS)} AS raw FROM {{lineitem}}",
)

# --- priced observations ---------------------------------------------------------------------------

# One text per part, so that an object keeps its meaning: (text, cadence, context).
OFFER_TEXTS = (
    ("Soporte remoto x 1 hora {name}", "PER_HOUR", "STANDARD"),
    ("Soporte Técnico por hora, urgencias {name}", "PER_HOUR", "URGENCY"),
    ("Abono mensual {name}", "PER_MONTH", "STANDARD"),
    ("Visita {name} cada visita fin de semana", "PER_VISIT", "URGENCY"),
    ("Instalación de cámara por cámara {name}", "PER_UNIT", "STANDARD"),
    ("Backup {name} cada 100 GB", "PER_UNIT", "STANDARD"),
    ("Formateo {name} Windows 11", "UNKNOWN", "STANDARD"),
    ("{name} fuera de horario", "UNKNOWN", "URGENCY"),
)
_TEXT_NO = f"(l_partkey % {len(OFFER_TEXTS)})"
_OFFER_TEXT = case(_TEXT_NO, [filled(t, name="p_name") for t, _, _ in OFFER_TEXTS])
derive(
    "observations",
    f"""SELECT {LINE_ID} AS observation_id, s_name AS source, n_name AS province, n_name AS city,
  CAST({_TEXT_NO} AS BIGINT) AS text_no, {_OFFER_TEXT} AS economic_object_raw,
  CASE WHEN p_type IN ('ECONOMY', 'STANDARD', 'LARGE') THEN p_retailprice
       WHEN p_type = 'SMALL' THEN p_retailprice + CAST(FLOOR(l_quantity) AS BIGINT) * 20
       ELSE l_extendedprice END AS price,
  CASE WHEN l_tax = 0.08 THEN 'USD' ELSE 'ARS' END AS currency,
  CASE WHEN p_size = 7 THEN 'UNMAPPED' ELSE 'SINGLE_SERVICE' END AS semantic_role,
  CASE WHEN p_size < 40 THEN 'LOCAL_SERVICE' ELSE 'REMOTE_NATIONAL_SERVICE' END AS market_scope,
  p_type AS canonical_service, p_brand AS brand, l_partkey, l_suppkey, l_orderkey, l_linenumber,
  l_discount, l_tax, p_name
FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey
JOIN {{supplier}} ON l_suppkey = s_suppkey JOIN {{nation}} ON s_nationkey = n_nationkey""",
)


def cadence_sql(column: str = "text_no") -> str:
    return case(column, [quoted(c) for _, c, _ in OFFER_TEXTS])


def context_sql(column: str = "text_no") -> str:
    return case(column, [quoted(c) for _, _, c in OFFER_TEXTS])
