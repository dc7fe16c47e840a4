import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from valora.llm import bpe_automaton as B
from valora.llm.packing import tokenizer_file

PATH = tokenizer_file("word_bpe_49k.json")
TEXTS = [
    None, "", " ", "Hello, World!", "it's THE'S don't 1234 5x6", "a" * 3000, "ab" * 2000, "aaaab aaab aab",
    "<|startoftext|>x<|endoftext|> y <|STARTOFTEXT|>", "x<|endoftext|><|endoftext|>", "été ÉTÉ ΑΣ Σ İ ß ǅ",
    "日本語 テスト　한국어 가", "\x1c\x1d a\x1fb\x85c d e \x0b\x0c", "½²Ⅷ ٣ x٣", "😀👍🏽 --- ... ''s '",
    "word " * 5000, "̈abc ̈", "</w> a</w>", "; `   Å",
]


@pytest.fixture(scope="module")
def both():
    return B.WordBpe(PATH), Tokenizer.from_file(PATH)


@pytest.mark.parametrize("text", TEXTS[1:])
def test_texts(both, text):
    bpe, lib = both
    want = lib.encode(text, add_special_tokens=False).ids
    got = next(bpe.encode([text]))
    assert got.tolist() == want
    assert B.ArcLabels(PATH).emit(got) == lib.decode(want, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=40), st.text("abceilnorst' .,", max_size=60), st.text("aéßΣ1 ́", max_size=20)))
def test_any_text(both, text):
    bpe, lib = both
    want = lib.encode(text, add_special_tokens=False).ids
    assert next(bpe.encode([text])).tolist() == want


def sequential(word, merges):
    """All merges in their order, each from left to right."""
    parts = list(word[:-1]) + [word[-1] + "$"]
    for a, b in merges:
        k = 0
        while k < len(parts) - 1:
            if (parts[k], parts[k + 1]) == (a, b):
                parts[k : k + 2] = [a + b]
            k += 1
    return parts


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_gadgets_on_small_vocabularies(data):
    """Random merges over two letters: the automaton gives what the merges give."""
    symbols = ["a", "b", "a$", "b$"]
    merges = []
    for _ in range(data.draw(st.integers(0, 12))):
        left = data.draw(st.sampled_from([s for s in symbols if not s.endswith("$")]))
        right = data.draw(st.sampled_from(symbols))
        if left + right not in symbols:
            merges.append((left, right))
            symbols.append(left + right)
    vocab = {s: k for k, s in enumerate(symbols)}
    automaton = B.TokenAutomaton(vocab, merges, "$")
    for _ in range(10):
        word = data.draw(st.text("ab", min_size=1, max_size=14))
        assert [symbols[t] for t in automaton.encode_word(word)] == sequential(word, merges)


def test_query(spark, sf_dir):
    lib = Tokenizer.from_file(PATH)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = B.bpe_query(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = lib.encode(docs[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        text = lib.decode(ids, skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_table_cases(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(None, "x"), (3, TEXTS[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'clash' AS n_tokens", "1 AS ids")
    out = B.decode(B.encode(docs, PATH), PATH).collect()
    assert len(out) == len(rows)
    assert {r.decoded for r in out if r.doc_id in (0, 1, 2)} == {""}
    assert B.encode(docs.limit(0), PATH).count() == 0
