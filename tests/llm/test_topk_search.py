"""Top-k search against all inner products in Python integers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from valora.llm.topk_search import Postings, top_k

SCHEMA = "vec_id long, embedding array<double>"


def plain(rows, k=10, every=100, scale=1024):
    clip = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    good = [
        (i, [scale * a // b for a, b in (float(x).as_integer_ratio() for x in v)])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    best = {}
    for q, a in good:
        if q % every == 0:
            for i, b in good:
                if i != q:
                    score = clip(sum(x * y for x, y in zip(a, b)))
                    best[q, i] = max(score, best.get((q, i), score))
    out = []
    for q in {q for q, _ in best}:
        mine = sorted((-s, i) for (x, i), s in best.items() if x == q)[:k]
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(mine, 1)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def drawn(count, dims, seed=1, zeros=0.0):
    pick = random.Random(seed)
    out = []
    for k in range(count):
        v = [0.0 if pick.random() < zeros else pick.gauss(0, 0.2) for _ in range(dims)]
        out.append((k, v))
    return out


@pytest.mark.parametrize("shard,block", [(1 << 18, 1 << 18), (700, 60)])
def test_drawn(spark, shard, block):
    rows = drawn(600, 16) + [(1000 + k, v) for k, v in drawn(300, 16, 2, 0.8)]
    rows += [(2000 + k, rows[0][1]) for k in range(200)]  # one vector very often
    vectors = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert got(top_k(vectors, shard=shard, block=block)) == plain(rows)


ODD = [
    (0, [1.0, -1.0]),
    (0, [1.0, -1.0]),
    (0, [5.0, 0.0]),
    (100, None),
    (200, [1.0, None]),
    (300, [float("nan"), 1.0]),
    (400, [float("inf"), 1.0]),
    (500, []),
    (600, [0.0, 0.0, 3.0]),
    (-100, [-0.0001, 2.0]),
    (None, [1.0, 1.0]),
    (7, [1e300, -1e300]),
    (8, [-1e300, 1e300]),
    (9, [1e9, 3.0]),
    (10, [1.0, -1.0]),
    (11, [1.0, -1.0]),
    (12, [2.0]),
    (12, [-2.0]),
]


def test_odd_rows(spark):
    vectors = spark.createDataFrame(ODD, SCHEMA).withColumn("rank", F.lit(1)).withColumn("block", F.lit("x"))
    assert got(top_k(vectors)) == plain(ODD)
    assert got(top_k(vectors, k=2, shard=4, block=4)) == plain(ODD, k=2)
    assert top_k(vectors.limit(0)).count() == 0
    assert top_k(vectors.where("vec_id = 12")).count() == 0


def test_floats(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    assert got(top_k(table.select("vec_id", "embedding"), shard=5000)) == plain(rows)


def test_pruning_is_exact():
    pick = np.random.default_rng(5)
    vectors = np.floor(pick.normal(size=(500, 24)) * 100)
    vectors[pick.random(vectors.shape) < 0.5] = 0
    postings = Postings(vectors)
    for query in np.floor(pick.normal(size=(20, 24)) * 100):
        scores = vectors @ query
        for least in (None, -1e9, 0, np.sort(scores)[-10], scores.max(), scores.max() + 1):
            rows, found = postings.competitive(query, least)
            want = np.arange(500) if least is None else np.nonzero(scores >= least)[0]
            assert rows.tolist() == want.tolist() and found.tolist() == scores[want].tolist()
