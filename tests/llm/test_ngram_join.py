import random

import numpy as np
import pytest
from test_components import least

from valora.llm import ngram_join as N

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, words):
    for s in SPACE:
        text = text.replace(s, " ")
    found = [w for w in text.translate(LOWER).split(" ") if w]
    if not found:
        return frozenset()
    return frozenset(tuple(found[k : k + words]) for k in range(max(1, len(found) - words + 1)))


def brute(rows, words, percent):
    """(doc_id, size, component) of each row, by comparing all pairs."""
    sets = [(i, shingle_set(t or "", words)) for i, t in rows]
    edges = []
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b:
                both = len(a & b)
                if 100 * both >= percent * (len(a) + len(b) - both):
                    edges.append((i, j))
    comp = least(edges)
    return sorted(((i, len(s), comp.get(i, i)) for i, s in sets), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def corpus(seed, groups=12, words=400):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(words)]
    rows = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 5, 9, 12, 20, 40, 80, 200]))]
        for _ in range(rng.randint(1, 7)):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, len(base) // 12])):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                text = text[: max(1, len(text) - rng.randint(0, 3))]
            rows.append(" ".join(text))
    rng.shuffle(rows)
    return list(enumerate(rows, 10))


@pytest.mark.parametrize(("seed", "words", "percent"), [(1, 3, 90), (2, 5, 80), (3, 1, 50)])
def test_random(spark, seed, words, percent):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(N.ngram_components(df, words, percent)) == brute(rows, words, percent)


def test_cases(spark):
    base = " ".join(f"x{k}" for k in range(60))
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "two one"), (8, base), (9, base.upper()),
        (10, base + " more"), (11, base + " more"), (12, base), (12, base), (None, base), (13, "long " * 100_000),
        (14, "long " * 90_000), (15, "É é"), (16, "é é"), (17, " ".join(f"{k}" for k in range(30_000))),
        (18, " ".join(f"{k}" for k in range(29_000))),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS sig", "'clash' AS component_id", "2 AS n")
    assert got(N.ngram_components(df, 3, 90)) == brute(rows, 3, 90)
    assert N.ngram_components(df.limit(0)).count() == 0


def test_null_id_first(spark):
    """A row without id that comes first in a task does not take the index of its set."""
    base = " ".join(f"x{k}" for k in range(60))
    rows = [(None, base), (None, base), (1, base), (2, base + " more"), (3, "other words here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert got(N.ngram_components(df, 3, 90)) == brute(rows, 3, 90)


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert got(N.ngram_query(spark, sf_dir)) == brute(rows, 3, 90)


def near(rng, size, percent):
    """Two sets just within the similarity."""
    a = rng.integers(0, 1 << 62, size).astype(np.uint64)
    extra = int(size * (100 - percent) / 100)
    lost = rng.integers(0, extra + 1)
    keep = a[lost:]
    gained = max(0, (100 * len(keep) // percent) - size)
    return np.unique(a), np.unique(np.concatenate([keep, rng.integers(0, 1 << 62, gained).astype(np.uint64)]))


@pytest.mark.parametrize("percent", [50, 80, 90, 95])
def test_similar_sets_share_a_signature(percent):
    """Also under an allocation that skips segments and widens others."""
    rng = np.random.default_rng(percent)
    scheme = N.Scheme(percent)
    for _ in range(150):
        a, b = near(rng, int(rng.integers(2, 400)), percent)
        if 100 * len(np.intersect1d(a, b)) < percent * len(np.union1d(a, b)) or np.array_equal(a, b):
            continue
        first, second = (N.signatures(x, scheme)[0] for x in (a, b))
        assert np.intersect1d(first, second).size
        band = N.Scheme(percent).bands_of(min(len(a), len(b)))[-1]
        m = int(scheme.segments[band])
        order = rng.permutation(m)
        allocation = {band: (set(order[: m // 2].tolist()), set(order[m // 2 : 2 * (m // 2)].tolist()))}
        gone = {N.segment_code(band, s) for part in allocation[band] for s in part}

        def chosen(x):
            sig, code = N.signatures(x, scheme)
            kept = [s for s, c in zip(sig.tolist(), code.tolist()) if c >> 32 == band and c not in gone]
            wide, codes = N.signatures(x, scheme, allocation)
            return {*kept, *wide[codes >> 32 == band].tolist()}

        assert chosen(a) & chosen(b)


def test_sketches_never_rule_out():
    rng = np.random.default_rng(4)
    for _ in range(200):
        a, b = near(rng, int(rng.integers(1, 3000)), 70)
        apart = len(np.setxor1d(a, b))
        assert N._bits_apart(N._wide_sketch(a), N._wide_sketch(b)) <= apart
        assert sum((x ^ y).bit_count() for x, y in zip(*[[v & (1 << 64) - 1 for v in N._sketch(t)] for t in (a, b)])) <= apart


def test_allocation_pays():
    scheme = N.Scheme(80)
    band = 12
    m = int(scheme.segments[band])
    dear = {int(N.segment_code(band, s)): 1e9 for s in (0, 1)} | {int(N.segment_code(band, 2)): 1.0}
    skipped, widened = N.allocate(dear, {band: 1000}, scheme)[band]
    assert skipped == {0, 1} and len(widened) == 2 and not widened & {0, 1, 2} and max(widened) < m
    assert N.allocate({int(N.segment_code(band, 0)): 5.0}, {band: 1000}, scheme) == {}


def test_widened_segments_in_the_join(spark, monkeypatch):
    rows = corpus(9)
    monkeypatch.setattr(N, "allocate", lambda c, s, scheme: {
        b: ({0}, {1}) for b in range(len(scheme.segments)) if scheme.segments[b] > 1
    })
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(N.ngram_components(df, 3, 80)) == brute(rows, 3, 80)


def test_hot_group_of_near_copies(spark):
    rng = random.Random(2)
    base = [f"v{k}" for k in range(120)]
    rows = []
    for k in range(150):
        text = list(base)
        text[rng.randrange(120)] = f"new{k}"
        rows.append((k, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(N.ngram_components(df, 3, 90)) == brute(rows, 3, 90)
