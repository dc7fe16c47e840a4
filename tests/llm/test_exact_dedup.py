"""Exact dedup against plain grouping, also with a digest that is the same for other texts."""

import hashlib

import pytest
from pyspark.sql import functions as F

from valora.llm.exact_dedup import exact_dedup, sha256_bytes

ROWS = [
    (1, "a"), (2, "a"), (3, "b"), (4, None), (5, ""), (6, "a "), (7, "A"), (7, "A"), (None, "a"),
    (None, "only"), (8, "x" * 100_000), (9, "x" * 100_000), (10, "x" * 99_999),
]


def want(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i is not None and i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("digest", [sha256_bytes, lambda t: F.encode(F.substring(t, 1, 1), "utf-8")])
def test_groups(spark, digest):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    docs = docs.withColumn("keep_id", F.lit("x")).withColumn("digest", F.lit(1)).repartition(5)
    got = exact_dedup(docs, digest=digest).collect()
    assert sorted((tuple(r) for r in got), key=repr) == want(ROWS)


def test_empty(spark):
    assert exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_hot_group(spark):
    docs = spark.range(5000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"),
    )
    out = exact_dedup(docs)
    assert out.where("kept").count() == 5000 - 1667 + 1
    assert out.where("group_size = 1667 and keep_id = 4998").count() == 1667
