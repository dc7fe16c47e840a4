"""The trie against a plain one of dictionaries, in one round and in several."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from valora.llm.prefix_trie import WIDTH, Node256, RadixTree, conversation_trie


def turn_id(role, text):
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]


def plain(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, turn_id(role, text), role or "", text or ""))
    own = {c: [(r, x) for *_, r, x in sorted(t)] for c, t in convs.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = (own.get(c - c % 20, [])[:h] if c >= 0 else own.get(c + -c % 20, [])[:h]) + turns[h:]
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)

    leaves, saved = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        below = kids.get(p, [])
        leaves[p] = sum(leaves[x] for x in below) or 1
        words = len(re.findall("[^ \t-\r]+", p[-1][1])) if p else 0
        saved[p] = sum(saved[x] for x in below) + (len(nodes[p]) - 1) * words
    out = []
    for p, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(p))
        parent = min(nodes[p[:-1]]) if p else None
        out.append(
            (min(members), len(p), parent, len(members), len(kids.get(p, [])), leaves[p], saved[p],
             hashlib.sha256(ends.encode()).hexdigest())
        )
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def drawn(seed, convs=300):
    """Conversations with many copies, long shared beginnings and few distinct turns."""
    pick = random.Random(seed)
    rows = []
    for c in range(convs):
        size = pick.choice([1, 2, 3, 4, 8, 30])
        same = pick.random() < 0.4
        for t in range(size):
            text = f"turn {t} of all" if same or t < 3 and pick.random() < 0.8 else pick.choice(["a b", "c", "", None])
            rows.append((c, t, pick.choice(["user", "assistant"]) if not same else "user", text))
    return rows


ODD = [
    (None, 0, "user", "no conversation"),
    (0, None, "user", "first of all"),
    (0, 1, None, None),
    (0, 1, "user", "tie"),
    (0, 1, "user", "tie"),
    (3, 0, "", ""),
    (-7, 0, "user", "below zero"),
    (-7, 1, "user", "x\x0by z"),
    (45, 0, "user", "base is absent"),
    (61, 5, "us", "er"),
    (62, 5, "user", ""),
]


def test_odd_rows(spark):
    turns = frame(spark, ODD).withColumn("key", F.lit(1)).withColumn("depth", F.lit("x"))
    assert got(conversation_trie(turns)) == plain(ODD)
    assert conversation_trie(turns.limit(0)).count() == 0


def test_drawn(spark):
    for seed in range(2):
        rows = drawn(seed)
        assert got(conversation_trie(frame(spark, rows).repartition(5))) == plain(rows)


@pytest.mark.parametrize("entries", [1, 40, 400])
def test_several_rounds(spark, entries):
    from valora.llm.prefix_trie import prefix_trie, rebuilt

    rows = drawn(7, 600)
    assert got(prefix_trie(rebuilt(frame(spark, rows)), entries)) == plain(rows)


def test_long_conversation(spark):
    rows = [(c, t, "user", f"{t}" * (200 if t == 3 else 1)) for c in (20, 21, 22) for t in range(3000 + c)]
    rows.append((23, 0, "user", "word " * 300_000))
    assert got(conversation_trie(frame(spark, rows))) == plain(rows)


def test_layouts():
    pick = random.Random(3)
    keys = sorted({bytes([pick.randrange(256) if k % WIDTH < 2 else 7 for k in range(WIDTH * pick.randrange(4))]) for _ in range(3000)})
    shuffled = keys[:]
    pick.shuffle(shuffled)
    tree = RadixTree()
    for key in shuffled:
        tree.insert(key, key)
    assert isinstance(tree.root, Node256)
    found, stack = [], [(tree.root, b"")]
    while stack:
        node, above = stack.pop()
        text = above + node.path
        if node.value is not None:
            found.append((node.value, text))
        stack += [(child, text + bytes([b])) for b, child in node.pairs()]
    assert sorted(found) == [(k, k) for k in keys]
