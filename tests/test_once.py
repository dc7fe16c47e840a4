"""Values that a rule names many times are worked out once per row."""

import time

import pytest
from pyspark.sql import functions as F

from valora.functions import price as pr
from valora.functions.rules import one_of, once
from valora.operators import knowledge as kn
from valora.operators import procurement as pc
from valora.operators import semantic as se
from valora.operators.questions import price_mention


def named(df, function: str) -> int:
    """How often a function stands in the plan, that is how often a row may call it."""
    return df._jdf.queryExecution().optimizedPlan().toString().count(function + "(")


def texts(spark, tmp_path, *values):
    path = str(tmp_path / "texts")
    spark.createDataFrame([(v,) for v in values], "t string").write.parquet(path)
    return spark.read.parquet(path)


def test_once(spark):
    df = spark.createDataFrame([("ab",), (None,)], "t string")
    doubled = once(F.upper("t"), lambda u: F.concat(u, u))
    assert [r[0] for r in df.select(doubled).collect()] == ["ABAB", None]


def test_word_starts():
    import re

    assert one_of([r"\bmes\b", r"\b(?:un |el )dia\b"]).startswith(r"(?:(?=[emu])\b")
    for patterns, text, hit in (
        ([r"\b(?:un |el )?dia\b"], "dia", True),
        ([r"\bx?dia\b"], "dia", True),
        ([r"\b(?:un |el )dia\b", r"\bmes"], "el dia", True),
        ([r"\b(?:un |el )dia\b", r"\bmes"], "al dia, xmes", False),
    ):
        assert bool(re.search(one_of(patterns), text)) is hit


def test_literal_guard_folds_once(spark, tmp_path):
    df = texts(spark, tmp_path, "$ 42.120,00", "$ 40", None)
    reason = pr.literal_reject_reason(F.col("t")).alias("reason")
    assert named(df.select(reason), "regexp_replace") <= 2


@pytest.mark.parametrize("mode", ["product", "list"])
def test_price_meaning_folds_once(spark, tmp_path, mode):
    df = texts(spark, tmp_path, "$ 42.120,00")
    kind = pr.price_meaning(F.col("t"), mode)["kind"].alias("kind")
    assert named(df.select(kind), "regexp_replace") <= 8


def test_bare_number_is_sought_once(spark, tmp_path):
    long_word = "x" * 100_000  # each place of it was tried, and from each place the rest of it
    df = texts(spark, tmp_path, long_word, "rtx 4060 usada", "son 2000 por todo", "hace 20 días")
    mention = df.select(F.substring("t", 1, 3).alias("t"), price_mention(F.col("t")).alias("m"))
    start = time.monotonic()
    got = {r.t: r.m["value"] for r in mention.collect()}
    assert time.monotonic() - start < 20
    assert got == {"xxx": None, "rtx": None, "son": 2000.0, "hac": None}


def test_items_are_read_once(spark, tmp_path):
    df = texts(spark, tmp_path, '{"Codigo": "1", "Items": {"Listado": [{"Cantidad": 1}]}}').select(
        F.lit(1).alias("raw_document_id"),
        F.lit("s").alias("source"),
        F.lit("u").alias("source_url"),
        F.col("t").alias("raw_content"),
    )
    lines = pc.order_lines(pc.extract_orders(df))
    assert named(lines, "from_json") <= 6
    assert lines.count() == 1


@pytest.mark.parametrize(
    "meaning, tables", [(se.scope_meaning, 20), (se.hardware_meaning, 40), (se.logistics_meaning, 20)]
)
def test_meanings_match_once(spark, tmp_path, meaning, tables):
    df = texts(spark, tmp_path, "envio a domicilio por moto")
    plan = df.select(meaning(F.col("t")).alias("m"))._jdf.queryExecution().optimizedPlan()
    assert plan.toString().count("RLIKE") <= tables


def test_profile_counts_equal_rows_before_it_groups(spark, tmp_path):
    names = "observation_id economic_object_raw canonical_service semantic_role market_scope source price_value currency"
    df = texts(spark, tmp_path, *["x"] * 50).select(*[F.col("t").alias(n) for n in names.split()])
    profile = kn.profile_rows(df)
    lines = profile._jdf.queryExecution().optimizedPlan().toString().splitlines()
    expand = next(i for i, line in enumerate(lines) if "Expand" in line)
    assert "Aggregate" in lines[expand + 1]
    assert {(r.label, r.value) for r in profile.collect()} >= {("total_rows", 50), ("duplicate_raw_expressions", 1)}
