"""sets that share many buckets meet in few of them, and no pair is lost by it."""

import random

import pytest
from pyspark.sql import functions as F
from test_ngram_join import brute, got

from valora.llm import ngram_join as N

WIDE = ", ".join(f"{s} long" for s in N._SKETCHES)


def _made(spark, scheme, shared, sets):
    labels = spark.createDataFrame(sets, f"cls long, label long, n long, {WIDE}")
    buckets = spark.createDataFrame(shared, "sig long, cls long, center long")
    out = N._cross_pairs(buckets, labels, scheme)
    out.write.format("noop").mode("overwrite").save()
    found = sorted(tuple(r) for r in out.collect())
    return found, out._jdf.queryExecution().optimizedPlan().toString()


def test_a_pair_meets_once(spark):
    """Two sets in 40 buckets: one row comes out of the joins, not 40."""
    sets = [(k, k, 100, *[k] * N.SKETCH) for k in (1, 2)]
    shared = [(sig, cls, 9) for sig in range(40) for cls in (1, 2)]
    found, plan = _made(spark, N.Scheme(80), shared, sets)
    assert found == [(1, 2)]
    assert "array_intersect" in plan.split("Aggregate")[1]


def test_groups_that_cannot_be_alike_do_not_meet(spark):
    """Components of several sets are told apart by bits that all sets of one have, none of the other."""
    bits = [(1 << 40) - 1, 0]
    sets = [(10 * g + k, g, 20, *[bits[g] | 1 << (50 + k)] * N.SKETCH) for g in (0, 1) for k in range(3)]
    frame = spark.createDataFrame(sets, f"cls long, label long, n long, {WIDE}")
    keyed = [F.min("n").alias("least"), F.max("n").alias("most")]
    for s in N._SKETCHES:
        keyed += [F.bit_and(s).alias(f"{s}_all"), F.bit_or(s).alias(f"{s}_any")]
    groups = frame.groupBy("label").agg(*keyed)
    a, b = (groups.select(*[F.col(c).alias(f"{c}_{x}") for c in groups.columns]) for x in "ab")
    met = a.crossJoin(b).where(N._groups_alike(80)).select("label_a", "label_b").collect()
    assert sorted(tuple(r) for r in met) == [(0, 0), (1, 1)]


@pytest.mark.parametrize("low", [1, 8])
def test_no_pair_is_lost(spark, monkeypatch, low):
    """Chains of sets at the edge of the similarity, and a phrase that all of them share."""
    monkeypatch.setattr(N, "LOW", low)
    rng = random.Random(low)
    phrase = " ".join(f"p{k}" for k in range(12))
    rows = []
    for g in range(6):
        text = [f"g{g}w{k}" for k in range(60)]
        for _ in range(14):
            for _ in range(rng.choice([1, 1, 2])):
                text[rng.randrange(60)] = f"n{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(text) + " " + phrase))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(N.ngram_components(df, 3, 80)) == brute(rows, 3, 80)
