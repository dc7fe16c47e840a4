"""Streaming form of document intake and of observation classification."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from valora.operators.dedup import only_new
from valora.operators.semantic import classify_observations
from valora.sources.evidence import RAW_KEY


def stream_raw_documents(
    incoming: DataFrame, store: str, checkpoint: str, schema: str
) -> StreamingQuery:
    """Append only unseen documents of each micro-batch to ``store``.

    The store keeps the content hash and is partitioned by its first two digits and by the
    batch that wrote: a batch reads the key columns of the parts that it touches, not the
    texts, and leaves out what it has written itself, so a replayed batch writes the same
    files again. ``schema`` is the stored schema with ``content_hash``; an absent store is
    created empty.
    """
    session = incoming.sparkSession
    layout = ("part", "writer")
    whole = f"{schema}, part string, writer string"
    session.createDataFrame([], whole).write.mode("ignore").partitionBy(*layout).parquet(store)
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def append(batch: DataFrame, batch_id: int) -> None:
        spark: SparkSession = batch.sparkSession
        writer = f"w{run}-{batch_id}"
        digest = F.sha2(F.col("raw_content"), 256)
        hashed = batch.withColumn("content_hash", digest).withColumn(
            "part", F.concat(F.lit("h"), F.substring("content_hash", 1, 2))
        )
        hashed.persist()
        try:
            touched = [r[0] for r in hashed.select("part").distinct().collect()]  # 256 at most
            stored = (
                spark.read.schema(whole)
                .parquet(store)
                .where(F.col("part").isin(touched) & (F.col("writer") != writer))
                .select(*RAW_KEY)
            )
            new = only_new(hashed, RAW_KEY, "arrival", stored).withColumn("writer", F.lit(writer))
            (
                new.repartition("part")
                .write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic")
                .partitionBy(*layout)
                .parquet(store)
            )
        finally:
            hashed.unpersist()

    return (
        incoming.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def classify_stream(incoming: DataFrame) -> DataFrame:
    """Stateless classification; the same columns as the batch operator."""
    return classify_observations(incoming)
