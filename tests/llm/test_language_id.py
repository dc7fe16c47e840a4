import numpy as np
import pytest
from pyspark.sql import functions as F

from valora.llm import language_id as L


@pytest.fixture(scope="module")
def result(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = L.language_query(spark, sf_dir).join(docs, "doc_id").collect()
    return rows


def test_accuracy_on_rows_never_learned(result):
    rows = [r for r in result if r.held_out and r.lang]
    assert len(rows) > 20
    assert np.mean([r.lang == r.lang_pred for r in rows]) >= 0.95
    assert all(0 <= r.score <= 1 for r in result)


def test_lookup_form_equals_the_network(result):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 256, (40, 64)).astype(np.uint8)
    net = L.train(x, rng.integers(0, 3, 40), ["a", "b", "c"], epochs=2)
    emb = net.embedding[x]
    tops = []
    for bank, bias in zip(net.banks, net.biases):
        span = x.shape[1] - len(bank) + 1
        act = sum(emb[:, j : j + span] @ bank[j] for j in range(len(bank)))
        tops.append(np.maximum(act.max(axis=1) + bias, 0))
    z = np.concatenate(tops, axis=1) @ net.weight + net.bias
    want = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    assert np.allclose(net.scorer(chunk=7)(x), want, atol=1e-4)


def test_gradients():
    """A step of training lowers the loss on separable windows to almost nothing."""
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 400)
    x = np.where(rng.random((400, 32)) < 0.3, np.where(y, 97, 98)[:, None], rng.integers(99, 122, (400, 32)))
    net = L.train(x.astype(np.uint8), y, ["a", "b"], epochs=5)
    assert (net.scorer()(x.astype(np.uint8)).argmax(axis=1) == y).mean() > 0.98


def test_sample_is_bounded(spark, monkeypatch):
    """A million copies of one id count once; of the other ids, those of smallest hash."""
    copies = spark.range(1_000_000).select(
        F.lit(-5).cast("long").alias("doc_id"), F.lit("aba abba " * 40).alias("text"), F.lit("x").alias("lang")
    )
    others = spark.range(3_000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("ono "), F.col("id").cast("string")).alias("text"), F.lit("y").alias("lang")
    )
    seen = {}
    monkeypatch.setattr(L, "train", lambda x, y, languages: seen.update(y=y, languages=languages))
    L.fit(copies.union(others).union(copies.limit(5).withColumn("doc_id", F.lit(None).cast("long"))), rows_per_language=100)
    assert seen["languages"] == ["x", "y"]
    assert np.bincount(seen["y"]).tolist() == [2, 100]


def test_cases(spark):
    rows = [(1, "aba abba " * 30, "x"), (2, "ono onno " * 30, "y"), (3, None, "x"), (4, "", "y"),
            (5, "123 !!", None), (6, "ono " * 50_000, None), (7, "aba", None), (7, "aba", None), (None, "²½", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    net = L.fit(docs, windows_per_row=20)
    got = sorted(((r.doc_id, r.lang_pred) for r in L.identify(docs, net).collect()), key=repr)
    assert got == sorted([(1, "x"), (2, "y"), (3, "und"), (4, "und"), (5, "und"), (6, "y"), (7, "x"), (7, "x"), (None, "und")], key=repr)
    assert {r.lang_pred for r in L.identify(docs, None).collect()} == {"und"}
    empty = docs.limit(0)
    assert L.fit(empty) is None and L.identify(empty, net).count() == 0
    assert len(L.windows_of(b"x" * 257)) == 2 and (L.windows_of(b"x" * 257)[1, 1:] == 32).all()
