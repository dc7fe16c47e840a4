"""Exact dedup: copies are combined locally, then per salted digest, then over the salts.

Every grouping has the whole text among its keys, so equal digests of different texts never
merge; the digest only decides where rows meet.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valora.llm.common import keyed_join, partitions, salt_of, staged


def sha256_bytes(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256_bytes,
) -> DataFrame:
    """One row per row of ``docs``: which document of its group of equal texts stays.

    Columns: ``doc_id``, ``keep_id`` (largest id of the group), ``group_size``, ``kept``,
    ``text_sha256``. Null text counts as empty. Rows with a null id count and never stay; a
    group of only such rows has a null ``keep_id``. Repeated rows of one id are all kept or
    all dropped. Other columns of ``docs`` are not read. An empty table gives no rows.

    1. Rows are grouped by (digest, salt of the id, text): Spark combines the copies inside
       each task before it sends one row per text and task.
    2. The winners of the salts are grouped by (digest, text).
    3. If some digest stands for two texts, its rows find their group by text as well;
       otherwise the digest alone is proven to name the text, and only ids and digests
       travel back to the rows.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    ).withColumn("digest", digest(F.col("text")))
    salted = rows.withColumn("salt", salt_of("doc_id", partitions(spark)))
    local = salted.groupBy("digest", "salt", "text").agg(
        F.max("doc_id").alias("top"), F.count(F.lit(1)).alias("n")
    )
    texts = local.groupBy("digest", "text").agg(
        F.max("top").alias("keep_id"), F.sum("n").alias("group_size")
    )
    names = staged(
        texts.select(
            "digest", "keep_id", "group_size", F.sha2("text", 256).alias("text_sha256")
        ).withColumn("sha", F.unhex("text_sha256")),
        "exact-dedup",
    )
    shared = names.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1")
    found = ("keep_id", "group_size", "text_sha256")
    if shared.isEmpty():
        narrow = rows.select("doc_id", "digest")
        out = keyed_join(narrow, names.select("digest", *found), ["digest"], "doc_id")
    else:
        whole = texts.select("digest", "text", "keep_id", "group_size")
        out = keyed_join(rows, whole, ["digest", "text"], "doc_id").withColumn(
            "text_sha256", F.sha2("text", 256)
        )
    return out.select(
        "doc_id",
        "keep_id",
        F.col("group_size").cast("long"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    ).withColumn("kept", F.col("kept") & F.col("doc_id").isNotNull())


SQL = """SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""
