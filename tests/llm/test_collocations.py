"""Collocations against a plain count of all phrases, in the whole and in small shards."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from valora.llm.collocations import Trie, _Read, collocations


def plain(rows, least, most=5):
    words, found = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            w = re.findall("[^ \t]+", piece)
            words[lang] += len(w)
            for k in range(1, most + 1):
                for i in range(len(w) - k + 1):
                    found[lang, tuple(w[i : i + k])] += 1
    known = {x: n for x, n in found.items() if n >= least}
    inside = {}
    for (lang, w), n in known.items():
        for i in range(len(w)):
            for j in range(i + 1, len(w) + 1):
                if j - i < len(w):
                    key = lang, w[i:j]
                    inside[key] = max(inside.get(key, 0), n)
    out = {}
    for (lang, w), a in known.items():
        if len(w) < 2 or inside.get((lang, w), 0) >= a:
            continue
        cuts = []
        for k in range(1, len(w)):
            l, r = known[lang, w[:k]], known[lang, w[k:]]
            cuts.append((1000 * a * words[lang] // (l * r), k, l, r))
        score, _, l, r = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    rows = []
    for lang, of in out.items():
        for rank, (score, a, phrase, l, r) in enumerate(sorted(of), 1):
            rows.append((lang, rank, phrase.decode(), -a, l, r, words[lang], -score))
    return sorted(rows)


ROWS = [
    ("New York city is in New York state. New York!", "en"),
    ("NEW YORK city\tis  big; new york city is old", "en"),
    ("a a a a a a", "en"),
    ("a a a a a a", None),
    ("a a a a a a", "und"),
    (None, "en"),
    ("", "fr"),
    (" .,;:!? \n", "fr"),
    ("É É été É É ÉTÉ", "fr"),
    ("x\x0by x\ry x y x\x0cy x y", "fr"),
    ("same text twice over", "de"),
    ("same text twice over", "de"),
    ("lang null", None),
]


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("states", [1 << 20, 12])
def test_rows(spark, states):
    docs = spark.createDataFrame(ROWS, "text string, lang string").repartition(3)
    docs = docs.withColumn("phrase", F.lit(1)).withColumn("n", F.lit("x"))
    assert got(collocations(docs, least=2, top=None, states=states)) == plain(ROWS, 2)


def test_long_texts(spark):
    """Texts over several blocks, and one of a single word longer than a block."""
    words = [f"w{(k * k) % 37}" for k in range(400_000)]
    rows = [(" ".join(words), "en"), ("q" * 2_500_000 + " w1 w1", "en"), ("w1 w4 w9 w16", "en")]
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert got(collocations(docs, least=3, top=None)) == plain(rows, 3)


def test_top_and_empty(spark):
    docs = spark.createDataFrame(ROWS, "text string, lang string")
    assert all(r["rank"] == 1 for r in collocations(docs, least=2, top=1).collect())
    whole = sorted(tuple(r) for r in collocations(docs, least=2, top=None).where("rank <= 3").collect())
    assert sorted(tuple(r) for r in collocations(docs, least=2, top=3).collect()) == whole
    assert collocations(docs.limit(0), least=2).count() == 0
    assert collocations(docs, least=1000).count() == 0


def test_trie():
    phrases = [("en", b"a b"), ("en", b"a c"), ("en", b"b a"), ("fr", b"a b"), ("fr", b"c c")]
    trie = Trie(phrases)
    for lang in ("en", "fr", "de"):
        text = b"a b a c c c x a b".split()
        read = _Read(b" ".join(text))
        found = trie.accepted(lang, read.stream(trie.symbols.of(read.first, read.second)), 2).tolist()
        want = [k for i in range(len(text) - 1) for k, p in enumerate(phrases) if p == (lang, b" ".join(text[i : i + 2]))]
        assert found == want


def test_words_of_a_block():
    """Hashes depend on the word alone, wherever it stands, and tell words apart."""
    import random

    pick = random.Random(4)
    words = sorted({bytes(pick.choice(b"abc\x00\xc3") for _ in range(pick.randrange(1, 7))) for _ in range(4000)})
    words += [b"x" * 70_000, b"y" * 200_000]
    pick.shuffle(words)
    block = b" . ".join(words) + b".."
    read = _Read(block)
    assert [block[a:b] for a, b in zip(read.starts, read.ends)] == words
    assert len(set(read.first.tolist())) == len(set(read.second.tolist())) == len(words)
    alone = [_Read(w).first[0] for w in words]
    assert read.first.tolist() == alone
    assert (read.stream(read.first) == 0).sum() == len(words)
    assert _Read(b"").size == 0 and _Read(b". .").size == 1 and _Read(b" a").size == 1
