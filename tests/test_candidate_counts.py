import pytest

from valora.operators import knowledge as kn


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("null", [None, ""])
def test_candidates_are_counted_without_copies(spark, null):
    """observations are not copied per distinct count."""
    rows = [("Á", "c", "k", "2", "s", "q", null), ("a ", "c", "k", "1", "s", "p", "x"), ("a", "c", "k", "0", "s", "q", "x")]
    names = "expression string, context string, proposed_concept_id string, observation_id string, source string, provider string, province string"
    found = kn.aggregate_candidates(spark.createDataFrame(rows, names))
    assert "Expand" not in plan(found).split("Aggregate")[-1]
    assert [tuple(r) for r in found.collect()] == [("a", "c", "k", "a ", "OBSERVED", 3, 2, 1)]
