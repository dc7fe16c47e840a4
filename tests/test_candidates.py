from pyspark.sql import functions as F

from valora.operators.knowledge import expression_candidates


def test_rows_of_one_expression_are_spread(spark):
    """rows of a common expression are joined in more than one task, and all of them."""
    asked = spark.range(400).coalesce(1).select("id", F.lit("Mesa ").alias("expression"))
    aliases = spark.range(3).select(
        F.lit("mesa").alias("folded"), F.lit("PROVIDER_OBSERVATION").alias("context"),
        F.concat(F.lit("C"), "id").alias("concept_id"), F.lit("Mesa").alias("expression"),
        F.lit("t").alias("origin_type"), F.lit("r").alias("origin_reference"), F.lit("v").alias("origin_version"),
    )
    found = expression_candidates(asked, aliases)
    assert found.select("id", "concept_id").distinct().count() == found.count() == 1200
    assert found.select(F.spark_partition_id()).distinct().count() > 1
