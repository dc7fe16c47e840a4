"""Packing against one-by-one best fit, and the tokens against the library itself."""

import bisect
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from valora.llm import packing

PATH = packing.tokenizer_file("byte_bpe_50k.json")


def one_by_one(lengths, capacity):
    """Best-fit decreasing, one piece at a time: the number of bins of each fill."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        at = bisect.bisect_left(rooms, n)
        room = rooms.pop(at) if at < len(rooms) else capacity
        bisect.insort(rooms, room - n)
    return sorted(capacity - r for r in rooms)


@pytest.mark.parametrize("seed", range(30))
def test_plan_is_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(5, 80))
    lengths = rng.integers(1, capacity + 1, int(rng.integers(1, 400)))
    values, counts = np.unique(lengths, return_counts=True)
    plan = packing.best_fit_plan(dict(zip(values.tolist(), counts.tolist())), capacity)
    fill = np.zeros(plan.bins, dtype=int)
    seen = {}
    for n, count in zip(values, counts):
        bins, offsets = plan.place(np.full(count, n), np.arange(count))
        for b, o in zip(bins, offsets):
            seen.setdefault(int(b), []).append((int(o), int(n)))
            fill[b] += n
    for parts in seen.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert end <= capacity
    assert sorted(fill.tolist()) == one_by_one(lengths.tolist(), capacity)


TEXTS = [
    None, "", " ", "  ", "a b", "a  b", "a   b c", " a", "a ", "a\n b", "a \nb", "\n \n x", "it's 's x's",
    "x <|endoftext|> y", "x<|endoftext|>", "été ñ 日本 語\u3000x \u00a0 y", "tab\t\tx \t y", "don't 12 3a4 ... !!",
    "a" * 5000, "w " * 3000, "\u2028 x \x85 y",
]


def test_tokens_and_pieces(spark):
    lib = Tokenizer.from_file(PATH)
    docs = spark.createDataFrame(list(enumerate(TEXTS)) + [(3, " ")], "doc_id long, text string")
    docs = docs.withColumn("length", F.lit("clash"))
    rows = packing.token_pieces(docs, PATH, capacity=64).orderBy("doc_id", "piece").collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for k, text in enumerate(TEXTS):
        ids = lib.encode(text or "", add_special_tokens=False).ids + [2]
        got = [r for r in by[k]] if k != 3 else by[k][:1]
        assert b"".join(r.ids for r in got) == np.array(ids, dtype="<u4").tobytes()
        assert all(r.length == 64 for r in got[1:]) and 1 <= got[0].length <= 64
        assert [r.start for r in got] == np.cumsum([0, *[r.length for r in got[:-1]]]).tolist()


LIBRARY = Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=40), st.text("ab1 \n\t.'s\u00a0é<|", max_size=60)))
def test_any_text(text):
    got = next(packing.encoded(iter([text]), PATH))
    assert got.tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_query(spark, sf_dir):
    lib = Tokenizer.from_file(PATH)
    rows = packing.packing_query(spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want = {}
    lengths = []
    for d in docs:
        ids = np.array(lib.encode(d.text or "", add_special_tokens=False).ids + [2], dtype="<u4")
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(d.doc_id, k)] = (a, b - a, zlib.crc32(ids[a:b].tobytes()))
            lengths.append(b - a)
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    assert len(rows) == len(want)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert end <= 1024
    assert len(bins) == len(one_by_one(lengths, 1024))


def test_bad_and_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, piece int, length long")
    assert packing.pack(empty).count() == 0
    bad = spark.createDataFrame([(1, 0, 0)], "doc_id long, piece int, length long")
    with pytest.raises(Exception, match="length outside"):
        packing.pack(bad).collect()
    nulls = spark.createDataFrame([(None, 0, 5), (None, 0, 5)], "doc_id long, piece int, length long")
    assert sorted(r.offset for r in packing.pack(nulls, 10).collect()) == [0, 5]


def test_a_task_gives_back_its_parts():
    first = [list(ids) for ids in packing.encoded(["some words, some more"], PATH)]
    assert packing._CACHES[PATH].where
    packing.forget_parts(PATH)
    assert not packing._CACHES[PATH].where and packing._CACHES[PATH].held == 0
    assert [list(ids) for ids in packing.encoded(["some words, some more"], PATH)] == first
