"""Idempotent ingest: first arrival wins, stored keys win over arrivals.

No operator here brings a whole key group into one task. "First per key" is a partial
aggregate on the key followed by an equi-join on key *and* arrival order, so the copies of a
hot key spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from valora.session import cut_lineage

NEW, DUPLICATE = "ACQUIRED", "DUPLICATE"


def key_digest(columns: Sequence[str | Column]) -> Column:
    """256-bit digest of a composite key; NULL and '' stay different."""
    parts = [F.col(c) if isinstance(c, str) else c for c in columns]
    marked = [F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("-")) for p in parts]
    return F.sha2(F.concat_ws("\u0001", *marked), 256)


def mark_new(
    incoming: DataFrame, keys: Sequence[str], order: str, stored: DataFrame | None = None
) -> DataFrame:
    """Add ``outcome``: ACQUIRED for the first arrival of an unstored key, else DUPLICATE.

    Rows of one key with the same ``order`` are told apart by their contents, and equal rows by
    chance, so that one row per key is new in any case. Only one row per key meets the stored
    table.
    """
    # contents are hashed here, so that columns nobody asks for are not shuffled for their sake
    keyed = incoming.withColumns({"_key": F.unhex(key_digest(keys)), "_tie": _contents(incoming)})
    first = keyed.groupBy("_key").agg(F.min(order).alias("_first"))
    if stored is not None:
        first = first.join(stored.select(F.unhex(key_digest(keys)).alias("_key")), "_key", "left_anti")
    winners = first.select("_key", F.col("_first").alias(order), F.lit(True).alias("_won"))
    joined = keyed.join(winners, ["_key", order], "left")
    place = F.row_number().over(Window.partitionBy("_key", order).orderBy("_tie"))
    won = F.col("_won") & (place == 1)
    return joined.withColumn("outcome", F.when(won, F.lit(NEW)).otherwise(DUPLICATE)).select(
        *incoming.columns, "outcome"
    )


def _contents(rows: DataFrame) -> Column:
    return F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])))


def _place_among_ties(rows: DataFrame, *keys: str) -> Column:
    """Place of a row among those that agree in ``keys``; needs no shuffle after a join on them."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(_contents(rows)))


def only_new(
    incoming: DataFrame,
    keys: Sequence[str],
    order: str,
    stored: DataFrame | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """The rows that ``mark_new`` calls ACQUIRED, or ``columns`` of them.

    One aggregate carries the row itself, so ``incoming`` is read and shuffled once.
    """
    names = [F.col(f"`{c}`") for c in (columns or incoming.columns)]
    first = (
        incoming.where(F.col(order).isNotNull())  # as in the join of ``mark_new``
        .select(
            F.unhex(key_digest(keys)).alias("_key"),
            F.struct(F.col(order).alias("_order"), _contents(incoming).alias("_tie")).alias("_at"),
            F.struct(*names).alias("_row"),
        )
        .groupBy("_key")
        .agg(F.min_by("_row", "_at").alias("_row"))
    )
    if stored is not None:
        first = first.join(stored.select(F.unhex(key_digest(keys)).alias("_key")), "_key", "left_anti")
    return first.select("_row.*")


# --- two unique keys ---------------------------------------------------------------------------


def accept_two_keys(
    incoming: DataFrame,
    key_a: Sequence[str],
    key_b: Sequence[str],
    order: str,
    stored: DataFrame | None = None,
) -> DataFrame:
    """Rows kept when a row is ignored iff an *accepted* earlier row shares either key.

    A row is an edge between its two keys and the sequential rule is greedy matching by
    arrival. An edge that is the earliest at both ends is certainly accepted, and every edge
    touching it is certainly ignored; repeating that settles all edges exactly. Each round is
    aggregates and equi-joins, so a hot key needs no big task, and is written to the
    checkpoint folder. A chain of conflicts takes as many rounds as it has turns; rows of the
    same ``order`` come in the order of their key digests.
    """
    digests = {"_a": F.unhex(key_digest(key_a)), "_b": F.unhex(key_digest(key_b))}  # 32 bytes each
    keyed = incoming.withColumns(digests)
    open_rows = keyed.select("_a", "_b", F.col(order).alias("_ord"))
    if stored is not None:
        open_rows = open_rows.join(stored.select(digests["_a"].alias("_a")), "_a", "left_anti")
        open_rows = open_rows.join(stored.select(digests["_b"].alias("_b")), "_b", "left_anti")
    edges = cut_lineage(open_rows.groupBy("_a", "_b").agg(F.min("_ord").alias("_ord")))
    accepted = None
    while True:
        best_a = edges.groupBy("_a").agg(F.min(F.struct("_ord", "_b")).alias("_at")).select("_a", "_at.*")
        best_b = edges.groupBy("_b").agg(F.min(F.struct("_ord", "_a")).alias("_at")).select("_b", "_at.*")
        won = cut_lineage(best_a.join(best_b, ["_a", "_b", "_ord"]))
        accepted = won if accepted is None else accepted.union(won)
        edges = cut_lineage(
            edges.join(won.select("_a"), "_a", "left_anti").join(
                won.select("_b"), "_b", "left_anti"
            )
        )
        if edges.isEmpty():
            break
    rows = keyed.withColumn("_ord", F.col(order)).join(accepted, ["_a", "_b", "_ord"], "left_semi")
    place = _place_among_ties(incoming, "_a", "_b", "_ord")
    return rows.withColumn("_place", place).where("_place = 1").select(*incoming.columns)


def with_children(parents_new: DataFrame, children: DataFrame, on: Sequence[str]) -> DataFrame:
    """Children of newly accepted parents only: a duplicate parent drops its children too."""
    return children.join(parents_new.select(*on), list(on), "left_semi")
