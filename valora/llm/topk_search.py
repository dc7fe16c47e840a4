"""Exact top-k search by inner product: MaxScore over shards of postings.

Vectors are made integers. A query's terms are its dimensions with the sign of the query's
component; a posting list holds the vectors whose component has that sign, and a shard knows the
largest component of each list, which bounds what a term can add to a score. All other
components can only lower it.

For each query and part of a shard, terms are split by their bounds: those whose bounds add up
to less than the score to beat are non-essential, because a vector in none of the other lists
cannot win. The essential lists are traversed and their scores added; then what can lower the
score and the non-essential terms are probed for the vectors that are still competitive, those
whose score and remaining bounds reach the score to beat, which rises as the best are found. It
starts as the k-th best of a small sample of vectors, a bound that can only be too low.

Shards meet queries in blocks, and the best of each shard are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from valora.llm.common import ship_package, staged

#: Largest values of a long; scores beyond count as these.
_TOP = (1 << 63) - 1
#: Sums of integers up to here are exact in double precision.
_EXACT = 1 << 53
#: Vectors of a shard that are searched at a time, and dimensions probed at a time.
_PART, _PROBE = 4096, 8


def usable(vector: Column) -> Column:
    """Not null and without null or non-finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine, F.lit(False))


def integers(vectors: list[np.ndarray], scale: int, dims: int) -> np.ndarray:
    """floor(scale * x) of each component, missing ones 0: doubles that hold integers, or Python
    integers where a sum of products might not be exact in doubles."""
    out = np.zeros((len(vectors), dims))
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    with np.errstate(over="ignore"):
        scaled = np.floor(out * scale)
    if np.isfinite(scaled).all():
        return scaled
    exact = np.empty(out.shape, dtype=object)
    for k, x in np.ndenumerate(out):
        top, bottom = float(x).as_integer_ratio()
        exact[k] = scale * top // bottom
    return exact


def _as_objects(values: np.ndarray) -> np.ndarray:
    if values.dtype == object:
        return values
    out = np.empty(values.shape, dtype=object)
    for k, x in np.ndenumerate(values):
        out[k] = int(x)
    return out


def in_doubles(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether all inner products of rows of ``a`` and ``b``, and bounds of them, are exact in doubles."""
    if a.dtype == object or b.dtype == object:
        return False
    most = max(1.0, np.abs(a).max(initial=0)) * max(1.0, np.abs(b).max(initial=0))
    return bool(2 * most * max(1, a.shape[1]) < _EXACT)


class Postings:
    """Lists of vectors by dimension and sign, with their largest components."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.vectors = vectors
        self.columns = np.ascontiguousarray(vectors.T)
        self.lists = []
        for sign in (1, -1):
            of_sign = []
            for column in self.columns * sign:
                rows = np.nonzero(column > 0)[0]
                of_sign.append((rows, column[rows]))
            self.lists.append(of_sign)
        #: The largest component of each list, 0 of an empty one: sign, dimension.
        self.tops = np.array(
            [[w.max() if len(w) else 0 for _, w in of_sign] for of_sign in self.lists], dtype=vectors.dtype
        ).reshape(2, -1)

    def competitive(self, query: np.ndarray, least) -> tuple[np.ndarray, np.ndarray]:
        """Rows whose score with ``query`` is at least ``least``, and the scores."""
        negative = (query < 0).astype(np.int64)
        weight = np.abs(query)
        bounds = weight * self.tops[negative, np.arange(len(query))]
        order = np.array(sorted(range(len(query)), key=lambda d: -bounds[d]), dtype=np.int64)
        rest = np.append(np.cumsum(bounds[order][::-1])[::-1], 0)  # what the terms from here on can add
        # Essential: all terms before the first whose bound, with all later ones, falls short.
        essential = int(np.count_nonzero(rest >= least)) if least is not None else len(order)
        essential = min(essential, len(order))
        if least is not None and rest[0] < least:
            return np.zeros(0, dtype=np.int64), query[:0]
        size = self.columns.shape[1]
        score = np.zeros(size, dtype=self.columns.dtype)
        seen = np.zeros(size, dtype=bool)
        for d in order[:essential]:
            rows, values = self.lists[negative[d]][d]
            score[rows] += weight[d] * values
            seen[rows] = True
        if least is None or rest[essential] >= least:
            seen[:] = True  # so low a score to beat that any vector may win
        live = np.nonzero(seen)[0]
        left = rest[essential]
        if least is not None:
            live = live[score[live] + left >= least]
        # Components of the other sign, heaviest first, then the non-essential terms.
        other = [d for d in order[:essential] if query[d] != 0]
        other.sort(key=lambda d: -weight[d])
        for k in range(0, len(other), _PROBE):
            some = np.array(other[k : k + _PROBE])
            lower = np.minimum(self.columns[some][:, live] * np.sign(query[some])[:, None], 0)
            score[live] += weight[some] @ lower
            if least is not None:
                live = live[score[live] + left >= least]
        for k in range(essential, len(order), _PROBE):
            some = order[k : k + _PROBE]
            score[live] += query[some] @ self.columns[some][:, live]
            left = rest[min(k + _PROBE, len(order))]
            if least is not None:
                live = live[score[live] + left >= least]
        return live, score[live]


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` ids of the highest scores, ties to the smaller id; an id's best score counts."""
    order = np.lexsort((ids, ~scores))  # ~x falls as x rises, without overflow
    ids, scores = ids[order], scores[order]
    if len(ids) > 1:
        _, first = np.unique(ids, return_index=True)
        if len(first) < len(ids):
            first.sort()
            ids, scores = ids[first], scores[first]
    return ids[:k], scores[:k]


def _clipped(scores: np.ndarray) -> np.ndarray:
    """Scores as longs."""
    if scores.dtype != object:
        return scores.astype(np.int64)
    return np.array([max(-_TOP - 1, min(_TOP, int(x))) for x in scores], dtype=np.int64)


def search_block(
    query_ids: np.ndarray, queries: np.ndarray, least: list, ids: np.ndarray, vectors: np.ndarray, k: int
):
    """(query row, ids, scores) of the best ``k`` vectors of a shard that reach ``least``."""
    doubles = in_doubles(queries, vectors)
    if not doubles:
        queries, vectors = _as_objects(queries), _as_objects(vectors)
    best = [(np.zeros(0, dtype=np.int64),) * 2 for _ in range(len(queries))]
    for at in range(0, len(ids), _PART):
        part = Postings(vectors[at : at + _PART])
        own = ids[at : at + _PART]
        for q in range(len(queries)):
            rows, scores = part.competitive(queries[q], least[q])
            other = own[rows] != query_ids[q]
            if not other.any():
                continue
            found, scores = own[rows][other], _clipped(scores[other])
            found, scores = np.concatenate([best[q][0], found]), np.concatenate([best[q][1], scores])
            best[q] = _best(found, scores, k)
            if len(best[q][0]) == k:
                least[q] = max(int(best[q][1][-1]), least[q] if least[q] is not None else -_TOP)
    return best


def _starts(query_ids, queries, ids, vectors, k: int) -> list:
    """For each query the ``k``-th best score over a few vectors, None with fewer than ``k``."""
    doubles = in_doubles(queries, vectors)
    if not doubles:
        queries, vectors = _as_objects(queries), _as_objects(vectors)
    out = []
    for q in range(len(queries)):
        rows = np.nonzero(ids != query_ids[q])[0]
        _, scores = _best(ids[rows], _clipped(vectors[rows] @ queries[q]), k)
        out.append(int(scores[-1]) if len(scores) == k else None)
    return out


def _rows(column, dtype: str) -> list[np.ndarray]:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    sizes = np.array([len(x) for x in column], dtype=np.int64)
    return np.split(values, np.cumsum(sizes)[:-1]) if len(sizes) else []


def top_k(
    vectors: DataFrame,
    k: int = 10,
    every: int = 100,
    scale: int = 1024,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    shard: int = 1 << 18,
    block: int = 1 << 18,
    sample: int = 2048,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the ``k`` best for each query.

    Queries are the rows whose id is divisible by ``every``, candidates all rows of another id.
    The score is the inner product of the components' floor(``scale`` * x), x as double, exact
    whatever their size; beyond the range of a long it counts as the nearest long. Equal scores
    are ranked by the smaller id, and a query with fewer than ``k`` candidates gets all.

    Vectors that are null or hold null or non-finite components take no part, nor do rows with
    a null id. Of vectors of different lengths, the shorter one counts as ending in zeros; an
    empty one scores 0. Repeated rows count once; of several vectors of one id, a candidate's or
    a query's, the best score counts. Other columns are not read; an empty table gives no rows.

    ``shard`` and ``block``: components of the vectors and of the queries that meet in a task.
    Each pair of a shard and a block of queries is one group, so that neither grows with the
    table. ``sample``: vectors that give the first score to beat; they only save work.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    kind = vectors.schema[vec_col].dataType.elementType.simpleString()
    kind = "float" if kind == "float" else "double"
    dtype = "float32" if kind == "float" else "float64"
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(f"array<{kind}>").alias("vector")
    )
    live = staged(rows.where(usable(F.col("vector")) & F.col("vec_id").isNotNull()).distinct(), "topk-vectors")
    is_query = F.col("vec_id") % every == 0
    count, asked, width, total, asked_total = live.agg(
        F.count(F.lit(1)),
        F.count(F.when(is_query, 1)),
        F.max(F.size("vector")),
        F.sum(F.size("vector") + 1),
        F.sum(F.when(is_query, F.size("vector") + 1)),
    ).first()
    schema = "query_id long, vec_id long, score long"
    ranked = "query_id", "rank", "vec_id", "score"
    if not asked:
        return spark.createDataFrame([], schema).select("query_id", F.lit(1).alias("rank"), "vec_id", "score")
    shards = max(1, -(-total // shard))
    blocks = max(1, -(-asked_total // block))

    few = live.orderBy(F.xxhash64("vec_id", "vector")).limit(min(sample, max(k, shard // max(1, width)))).toArrow()
    few = few.combine_chunks()
    sample_ids = few["vec_id"].to_numpy()
    sample_vectors = spark.sparkContext.broadcast(_rows(few["vector"].combine_chunks(), dtype))

    deal = F.xxhash64("vec_id", "vector")
    own_shard = F.pmod(deal, F.lit(shards)).cast("int")
    own_block = F.pmod(F.xxhash64(deal), F.lit(blocks)).cast("int")

    def begin(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                own = _rows(part.column(1), dtype)
                dims = max([len(v) for v in [*own, *sample_vectors.value]], default=0)
                least = _starts(
                    part.column(0).to_numpy(), integers(own, scale, dims),
                    sample_ids, integers(sample_vectors.value, scale, dims), k,
                )
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(least, pa.int64())], ["vec_id", "vector", "block", "least"]
                )

    queries = staged(
        live.where(is_query)
        .select("vec_id", "vector", own_block.alias("block"))
        .mapInArrow(begin, f"vec_id long, vector array<{kind}>, block int, least long"),
        "topk-queries",
    )
    sides = (
        queries.select(
            F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "block", "vec_id", "vector", "least", F.lit(True).alias("asks")
        ).union(
            live.select(
                own_shard.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
                "vec_id", "vector", F.lit(None).cast("long").alias("least"), F.lit(False).alias("asks"),
            )
        )
    )

    def run(table):
        table = table.combine_chunks()
        asks = table["asks"].to_numpy()
        vectors_ = _rows(table["vector"].combine_chunks(), dtype)
        dims = max([len(v) for v in vectors_], default=0)
        values = integers(vectors_, scale, dims)
        ids = table["vec_id"].to_numpy()
        least = table["least"].to_pylist()
        found = search_block(
            ids[asks], values[asks], [x for x, a in zip(least, asks) if a], ids[~asks], values[~asks], k
        )
        sizes = [len(x[0]) for x in found]
        empty = np.zeros(0, dtype=np.int64)
        return pa.table(
            {
                "query_id": np.repeat(ids[asks], sizes),
                "vec_id": np.concatenate([empty, *(x[0] for x in found)]),
                "score": np.concatenate([empty, *(x[1] for x in found)]),
            }
        )

    found = staged(sides.groupBy("shard", "block").applyInArrow(run, schema), "topk-found")
    sample_vectors.destroy()
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", place).where(F.col("rank") <= k).select(*ranked)


def topk_query(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """WITH v AS (SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10"""
