"""Literal cases of text, price and question rules."""

import pytest
from pyspark.sql import functions as F

from valora.functions import price as pr
from valora.functions import text as tx
from valora.functions.rules import one_of
from valora.operators import semantic as se
from valora.operators.questions import parse_questions, several_amounts


def apply(spark, values, column):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, t string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("t"))).collect()]


def test_fold(spark):
    values = ["  Más   POPULAR ", "Ñandú ﬁn…", None, "x½", "ÀÉÎÕÜ"]
    assert apply(spark, values, tx.fold) == ["mas popular", "nandu fin...", "", "x1⁄2", "aeiou"]
    assert apply(spark, ["¡Hola,  Mundo!"], tx.fold_plain) == ["hola  mundo"]


def test_alternation_keeps_meaning():
    import re

    pattern = one_of([r"\bhora\b(?!s\b)|\bmes\b", r"a|[b|c]d"])
    for text, hit in (("hora", True), ("ahora x", True), ("mes", True), ("xmes", False), ("cd", True)):
        assert bool(re.search(pattern, text)) is hit


@pytest.mark.parametrize(
    "raw, want",
    [
        ("Informática SAS", "Informatica"),
        ("TECNO S.R.L.", "Tecno"),
        ("compuMundo", "compuMundo"),
        ("Soluciones IT", "Soluciones IT"),
        ("Soluciones IT S.A.", "Soluciones It"),
        (None, ""),
    ],
)
def test_company(spark, raw, want):
    assert apply(spark, [raw], tx.company_name) == [want]


def test_literal_guard(spark):
    values = ["$ 42.120,00", "$ 40", "$ 40 - 60K", "$ 0", "", None, "Consultar", "USD 100 / MES", "U$S 50"]
    reasons = apply(spark, values, pr.literal_reject_reason)
    assert reasons == [
        None,
        "PRECIO_AMBIGUO",
        "PRECIO_AMBIGUO",
        "PRECIO_CERO_LITERAL",
        "PRECIO_AUSENTE",
        "PRECIO_AUSENTE",
        "PRECIO_NO_REPRESENTABLE",
        None,
        None,
    ]
    prices = apply(spark, values, pr.literal_price)
    assert (prices[0].value, prices[0].currency) == (4212000, "ARS")
    assert (prices[7].value, prices[7].currency, prices[7].period) == (100, "USD", "mensual")
    assert prices[8].currency == "ARS" and prices[1] is None


def test_amounts(spark):
    values = ["12.500", "12.500,50", "1,234.5", "1,234", "12,5", "1.234.567", "12.5", ""]
    assert apply(spark, values, pr.money_amount) == [
        12500.0, 12500.5, 1234.5, 1234.0, 12.5, 1234567.0, 12.5, None,
    ]
    assert apply(spark, ["80", "1,5", "1.500.000"], pr.scalar_amount) == [80.0, 1.5, 1.5]
    assert apply(spark, ["35000.0", "1234.5", "12345678.9", None, "x"], pr.number_key) == [
        "35000", "1234.5", "12345678.9", "", "x",
    ]


def test_web_price(spark):
    values = ["a $ 1.234", "1.234,00 ARS", "$ 1.234,50", "$ 0", "ars 99", "1,234,567 ars", "nada"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    out = pr.with_web_price(df, "t").orderBy("i").select("web_price.value").collect()
    assert [r[0] for r in out] == [1234, 1234, None, None, 99, 1234567, None]


def test_cohort_contract(spark):
    values = ["Sistema operativo SIN backup", "Sistema operativo sin backup + SSD", "Backup"]
    assert apply(spark, values, se.cohort_contract) == [
        "COMPARABLE_CORE", "INDETERMINATE", "INDETERMINATE",
    ]


QUESTIONS = [
    (
        "me quieren cobrar 80 lucas por formatear la notebook en Córdoba, está bien?",
        dict(intent_action="EVALUATE_PRICE", intent_side="BUY", clarification_required=False),
        ("EXACT", 80000.0, "ARS"),
    ),
    (
        "quiero cobrar 60 lucas por limpiar notebook y cambiar pasta, está bien o me bajo?",
        dict(intent_side="SELL", clarification_reason="UNKNOWN_ECONOMIC_OBJECT"),
        ("EXACT", 60000.0, "ARS"),
    ),
    ("soporte remoto cuanto se esta cobrando la hora", dict(intent_action="MARKET_REFERENCE"), ("UNKNOWN", None, "UNKNOWN")),
    ("hace 45 días que no anda la impresora", dict(device_type="IMPRESORA"), ("UNKNOWN", None, "UNKNOWN")),
    ("me cobran 30 usd por mes por hosting", dict(market_scope="REMOTE_NATIONAL"), ("PER_MONTH", 30.0, "USD")),
]


@pytest.mark.parametrize("text, fields, price", QUESTIONS)
def test_questions(spark, text, fields, price):
    row = parse_questions(spark.createDataFrame([(text,)], "text string")).first()
    assert {k: row[k] for k in fields} == fields
    assert (row.price.type, row.price.value, row.price.currency) == price


def test_several_amounts(spark):
    values = ["$ 10 y $ 20", "entre 10 y 20 lucas", "$ 10 lucas", "10k y un palo", "10 usd o 5 mil", "nada"]
    assert apply(spark, values, several_amounts) == [True, False, False, True, True, False]
