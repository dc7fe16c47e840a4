from pyspark.sql import functions as F

from valora.operators.dedup import mark_new, only_new


def test_new_rows_are_read_once(spark, tmp_path):
    """the rows themselves are aggregated, not joined with their keys, and are the same."""
    rows = [("a", 1, "x", "long"), ("a", 1, "y", "text"), ("a", 0, "z", None), ("b", 2, "x", "t"), ("c", None, "x", "t"), ("d", 5, None, "t")]
    path = str(tmp_path / "rows")
    spark.createDataFrame(rows, "k string, at int, v string, w string").write.parquet(path)
    df = spark.read.parquet(path)
    stored = df.where("k = 'b'")
    for known in (None, stored):
        marked = mark_new(df, ["k"], "at", known).filter("outcome = 'ACQUIRED'").drop("outcome")
        new = only_new(df, ["k"], "at", known)
        assert new.columns == df.columns
        assert sorted(map(repr, new.collect())) == sorted(map(repr, marked.collect()))
    few = only_new(df, ["k"], "at", None, ["v"])
    assert few.columns == ["v"]
    assert few._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    tie = df.where("k = 'a' and at = 1")
    assert only_new(tie, ["k"], "at").collect() == mark_new(tie, ["k"], "at").filter("outcome = 'ACQUIRED'").drop("outcome").collect()


def test_marking_shuffles_no_column_that_is_not_asked_for(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(20).select(F.col("id").alias("at"), (F.col("id") % 3).alias("k"), F.repeat(F.lit("x"), 50).alias("text")).write.parquet(path)
    plan = mark_new(spark.read.parquet(path), ["k"], "at").select("at", "outcome")._jdf.queryExecution().optimizedPlan().toString()
    assert "text#" not in plan.split("Join")[0]
