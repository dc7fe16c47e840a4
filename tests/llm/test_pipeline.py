"""The pipeline against brute-force versions of its stages."""

import corpus_pipeline as P
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_line_dedup import want as line_brute
from test_ngram_join import brute as near_brute
from tokenizers import Tokenizer

from valora.llm import language_id, packing


def test_run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = language_id.fit(docs.where(~language_id.held_out()))
    judged = language_id.identify(docs, net).collect()
    rows = [(r.doc_id, r.text) for r in judged if r.lang_pred != "und" and r.score >= P.MIN_SCORE]
    rows = [(i, t) for i, t, _, _ in line_brute(rows)]
    keep = {i for i, _, c in near_brute(rows, 5, 80) if i == c}
    rows = {i: t for i, t in rows if i in keep}

    lib = Tokenizer.from_file(packing.tokenizer_file("byte_bpe_50k.json"))
    out = P.run(spark, sf_dir).collect()
    sizes = {i: len(lib.encode(t, add_special_tokens=False).ids) + 1 for i, t in rows.items()}
    got = {}
    for r in out:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == sizes
    fills = {}
    for r in out:
        fills.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in fills.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 1024


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize(("name", "stage"), P.STAGES)
def test_odd_rows(spark, sf_dir, name, stage):
    base = " ".join(f"word{k}" for k in range(40))
    rows = [
        (1, base, "en", "s", 1), (2, base + " x", "en", "s", None), (3, None, None, None, None), (4, "", "de", "s", 0),
        (None, base, "en", "s", 2), (5, "und so weiter " * 30_000, "de", "t", 3), (5, "und so weiter " * 30_000, "de", "t", 3),
        (6, "123", "en", "s", 3), (7, "le chat et la souris dans la maison", "fr", "s", 9),
    ]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("clash")).withColumn("n_lines", F.lit(1))
    out = stage(spark, docs, sf_dir)
    empty = stage(spark, docs.limit(0), sf_dir)
    assert empty.count() == 0
    if stage is not P.pack_documents:
        assert out.columns == docs.columns == empty.columns
    ids = sorted((r.doc_id for r in out.collect()), key=repr)
    if stage is P.identify_language:
        assert ids == sorted([1, 2, None, 5, 5, 7], key=repr)
    if stage is P.dedup_lines:
        assert ids == sorted([r[0] for r in rows], key=repr)
    if stage is P.drop_near_duplicates:
        assert ids == sorted([1, 3, 4, None, 5, 5, 6, 7], key=repr)
