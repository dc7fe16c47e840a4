"""Rules on an object's text run once per distinct text where texts repeat."""

from valora.bindings import cohort_stats
from valora.bindings.base import load
from valora.operators import cohorts as co

SCHEMA = (
    "semantic_role string, market_scope string, currency string, province string, "
    "economic_object_raw string, canonical_service string, price_value string, source string"
)
TEXTS = ("Soporte Técnico por hora, urgencias", "Abono mensual", "", None, "Backup cada 100 GB")


def test_rows_are_those_of_each_text(spark):
    data = [
        ("SINGLE_SERVICE", "LOCAL_SERVICE", "ARS", "Salta", TEXTS[k % 5], "A", str(100 + k), f"s{k % 7}")
        for k in range(60)
    ]
    rows = spark.createDataFrame(data, SCHEMA)
    once = co.cohort_input(rows, texts_repeat=True)
    each = co.cohort_input(rows)
    assert once.columns == each.columns and once.count() == 60
    assert once.exceptAll(each).count() == 0


def test_rules_are_not_run_on_rows(spark, sf_dir):
    rows = cohort_stats.semantic_rows(load(spark, sf_dir, "observations"))
    for df in (cohort_stats.cohort_table(rows), cohort_stats.cohorts_by_scope(rows)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "RLIKE" not in plan and "translate(" not in plan
