import random

from valora.llm.components import components


def least(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


def test_chains_stars_and_random(spark):
    rng = random.Random(3)
    chain = [(k, k + 1) for k in range(100, 140)]
    star = [(500, k) for k in range(501, 600)]
    loose = [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(110)]
    edges = chain + star + loose + [(5, 5), (7, 6), (6, 7)]
    df = spark.createDataFrame([*edges, (None, 3), (4, None)], "a long, b long").repartition(3)
    rows = components(df).collect()
    got = {r.node: r.component for r in rows}
    assert len(rows) == len(got)
    assert got == least([e for e in edges if e[0] != e[1]])


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
