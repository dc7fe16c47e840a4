import tracemalloc

import numpy as np
import pytest
from test_components import least

from valora.llm import embedding_join as J

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, threshold):
    def fine(i, v):
        if i is None or not v or any(x is None for x in v) or not np.isfinite(v).all() or not any(v):
            return None
        v = np.array(v, dtype=np.float64)
        v = v / np.abs(v).max()
        return v / np.sqrt((v * v).sum())

    unit = [fine(*r) for r in rows]
    links = [0] * len(rows)
    edges = []
    for a, x in enumerate(unit):
        for b, y in enumerate(unit[:a]):
            if x is not None and y is not None and len(x) == len(y) and float(x @ y) >= threshold:
                links[a] += 1
                links[b] += 1
                edges.append((rows[a][0], rows[b][0]))
    comp = least(edges)
    return sorted(
        ((i, n, comp.get(i, i), i is not None and comp.get(i, i) == i) for (i, _), n in zip(rows, links)), key=repr
    )


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def clusters(seed, n=260, dims=32, spread=0.05):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(25, dims))
    out = centers[rng.integers(0, 25, n)] + rng.normal(size=(n, dims)) * rng.choice([spread, 4 * spread, 1], (n, 1))
    return [(k, v.tolist()) for k, v in enumerate(out)]


@pytest.mark.parametrize(("seed", "tile", "keys"), [(1, 1 << 20, 2), (2, 9 * 32, 2), (3, 20 * 32, 3), (4, 7 * 32, 1)])
def test_random(spark, seed, tile, keys):
    rows = clusters(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(J.cosine_components(df, tile=tile, keys=keys)) == brute(rows, 0.95)


def test_cases(spark):
    nan, inf = float("nan"), float("inf")
    a, b = [1.0, 2.0, 3.0], [1.0, 2.0, 3.1]
    rows = [
        (1, a), (2, a), (3, b), (4, None), (5, []), (6, [0.0, 0.0, 0.0]), (7, [1.0, None, 3.0]), (8, [1.0, nan, 3.0]),
        (9, [1.0, inf, 3.0]), (10, [1e200, 2e200, 3e200]), (11, [1e-200, 2e-200, 3e-200]), (12, [1.0, 2.0]), (13, [2.0, 4.0]),
        (None, a), (14, [-1.0, -2.0, -3.0]), (15, [5.0]), (16, [0.1]), (17, [-0.0, 1.0]), (18, [0.0, 1.0]), (3, b),
        (19, [1.0] * 3000), (20, [1.0] * 2999 + [2.0]),
    ]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS rep", "'clash' AS n_links", "2 AS h")
    assert got(J.cosine_components(df)) == brute(rows, 0.95)
    assert J.cosine_components(df.limit(0)).count() == 0


def test_floats_and_query(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert got(J.embedding_query(spark, sf_dir)) == brute(rows, 0.95)


def test_hot_group(spark):
    rng = np.random.default_rng(0)
    rows = [(k, (np.ones(16) + rng.normal(size=16) * 0.02).astype(np.float32).tolist()) for k in range(300)]
    rows += [(k, rows[0][1]) for k in range(300, 400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    assert got(J.cosine_components(df, tile=64 * 16)) == brute(rows, 0.95)


def test_links_are_folded_as_they_come():
    """Some 4 million links in chunks leave no pairs in memory; roots are those of all links."""
    rng = np.random.default_rng(3)
    reps = rng.permutation(3000).astype(np.int64) * 7
    many = rng.integers(1, 4, 3000)
    few = [(rng.integers(0, 3000, 50), rng.integers(0, 3000, 50)) for _ in range(20)]

    def links(group):  # all pairs of the first nodes, then a few others
        i, j = np.triu_indices(group, 1)
        for k in range(0, len(i), 20_000):
            yield i[k : k + 20_000], j[k : k + 20_000]
        yield from few

    counts = np.zeros(3000, dtype=np.int64)
    for a, b in links(60):
        np.add.at(counts, a, many[b])
        np.add.at(counts, b, many[a])
    comp = least([(int(reps[a]), int(reps[b])) for x, y in links(60) for a, b in zip(x, y)])
    got, roots = J._links_and_roots(links(60), reps, many)
    assert (got == counts).all()
    assert roots.tolist() == [comp.get(int(r), int(r)) for r in reps]

    chunks = iter((a.copy(), b.copy()) for _ in range(200) for a, b in [(np.arange(20_000) % 2999, np.arange(20_000) % 3000)])
    tracemalloc.start()
    J._links_and_roots(chunks, reps, many)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8_000_000
