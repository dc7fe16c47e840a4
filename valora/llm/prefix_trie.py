"""Conversation prefix trie: all shared beginnings of conversations, with sums over subtrees.

A turn becomes a fixed-width big-endian id, a conversation the string of its turns' ids. Equal
conversations are made one key with a count. The keys are dealt by range, and each task puts
its sorted keys, some at a time, into an adaptive radix tree: inner nodes grow through layouts
of 4, 16, 48 and 256 children, and bytes without a branch are one path. Ids are many bytes
wide, so a tree has nodes at byte depths within a turn; only depths at the end of a turn are
nodes of the result.

A tree holds the whole subtree of each of its nodes, but for those on the paths of its first
and its last key, which the neighbouring trees may share. The values of these paths are handed
on as two keys with a value for each depth, and the next round builds trees over the handed-on
keys only. Each round leaves a small fraction of the keys, and the last one fits one tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from valora.llm.common import drop_staged, keyed_join, ship_package, staged

#: Bytes of a turn's id.
WIDTH = 16
#: Conversations whose ids are joined into one string before a key's strings meet.
_SPAN = 4096
_EMPTY_HASH = hashlib.sha256(b"").hexdigest()


class Node4:
    """Few children: their bytes in order beside them. 16 children use the same form."""

    __slots__ = ("path", "value", "bytes", "children")
    room = 4

    def __init__(self, path: bytes) -> None:
        self.path = path
        self.value = None
        self.bytes = bytearray()
        self.children: list = []

    def find(self, byte: int):
        at = self.bytes.find(byte)
        return None if at < 0 else self.children[at]

    def replace(self, byte: int, child) -> None:
        self.children[self.bytes.index(byte)] = child

    def full(self) -> bool:
        return len(self.children) == self.room

    def add(self, byte: int, child) -> None:
        at = 0
        while at < len(self.bytes) and self.bytes[at] < byte:
            at += 1
        self.bytes.insert(at, byte)
        self.children.insert(at, child)

    def items(self) -> list:
        return self.children

    def pairs(self) -> Iterator:
        return zip(self.bytes, self.children)

    def grown(self):
        return _moved(self, Node16(self.path))


class Node16(Node4):
    __slots__ = ()
    room = 16

    def grown(self):
        return _moved(self, Node48(self.path))


class Node48:
    """A table of 256 bytes that points into up to 48 children."""

    __slots__ = ("path", "value", "index", "children")

    def __init__(self, path: bytes) -> None:
        self.path = path
        self.value = None
        self.index = bytearray(256)
        self.children: list = []

    def find(self, byte: int):
        at = self.index[byte]
        return self.children[at - 1] if at else None

    def replace(self, byte: int, child) -> None:
        self.children[self.index[byte] - 1] = child

    def full(self) -> bool:
        return len(self.children) == 48

    def add(self, byte: int, child) -> None:
        self.children.append(child)
        self.index[byte] = len(self.children)

    def pairs(self) -> Iterator:
        return ((b, self.children[at - 1]) for b, at in enumerate(self.index) if at)

    def items(self) -> list:
        return [child for _, child in self.pairs()]

    def grown(self):
        return _moved(self, Node256(self.path))


class Node256:
    """A place for each byte."""

    __slots__ = ("path", "value", "children")

    def __init__(self, path: bytes) -> None:
        self.path = path
        self.value = None
        self.children: list = [None] * 256

    def find(self, byte: int):
        return self.children[byte]

    def replace(self, byte: int, child) -> None:
        self.children[byte] = child

    add = replace

    def full(self) -> bool:
        return False

    def pairs(self) -> Iterator:
        return ((b, x) for b, x in enumerate(self.children) if x is not None)

    def items(self) -> list:
        return [x for x in self.children if x is not None]


def _moved(old, new):
    new.value = old.value
    for byte, child in old.pairs():
        new.add(byte, child)
    return new


def _shared(a: bytes, b: bytes) -> int:
    """How many bytes two strings begin with in common."""
    size = min(len(a), len(b))
    if a[:size] == b[:size]:
        return size
    low, high = 0, size  # a[:low] == b[:low], a[:high] != b[:high]
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class RadixTree:
    """An adaptive radix tree with path compression; a key may be the beginning of another."""

    def __init__(self) -> None:
        self.root = Node4(b"")

    def insert(self, key: bytes, value) -> None:
        above, edge, node, at = None, 0, self.root, 0
        while True:
            path = node.path
            same = _shared(path, key[at : at + len(path)]) if path else 0
            if same < len(path):  # the path parts here
                fork = Node4(path[:same])
                fork.add(path[same], node)
                node.path = path[same + 1 :]
                self._put(above, edge, fork)
                at += same
                self._end(above, edge, fork, key, at, value)
                return
            at += same
            if at == len(key):
                node.value = value
                return
            child = node.find(key[at])
            if child is None:
                self._end(above, edge, node, key, at, value)
                return
            above, edge, node, at = node, key[at], child, at + 1

    def _end(self, above, edge: int, node, key: bytes, at: int, value) -> None:
        """Put the rest of a key below ``node``, which has no way on for it."""
        if at == len(key):
            node.value = value
            return
        leaf = Node4(key[at + 1 :])
        leaf.value = value
        if node.full():
            node = node.grown()
            self._put(above, edge, node)
        node.add(key[at], leaf)

    def _put(self, above, edge: int, node) -> None:
        if above is None:
            self.root = node
        else:
            above.replace(edge, node)


class Key:
    """A key of a tree with the words of its turns and its values at each depth from 0.

    ``count`` and ``low`` are the members that begin with it and the least of them; ``kids``,
    ``leaves`` and ``saved`` are what earlier rounds found below; ``ends`` the hash of the
    members that end there, None where none do.
    """

    __slots__ = ("key", "words", "count", "low", "kids", "leaves", "saved", "ends", "_nodes")

    def __init__(self, key, words, count, low, kids, leaves, saved, ends) -> None:
        self.key, self.words, self.count, self.low = key, words, count, low
        self.kids, self.leaves, self.saved, self.ends = kids, leaves, saved, ends
        self._nodes = None

    @classmethod
    def of_members(cls, key: bytes, words: list[int], members: int, least: int, ends: str) -> Key:
        size = len(words)
        none = [0] * (size + 1)
        return cls(
            key, words, [members] * (size + 1), [least] * (size + 1), none, none, none, [None] * size + [ends]
        )

    def node(self, depth: int) -> bytes:
        """128-bit hash of the beginning of ``depth`` turns; all are made at once."""
        if self._nodes is None:
            hasher = xxhash.xxh3_128()
            self._nodes = [hasher.digest()]
            for k in range(0, len(self.key), WIDTH):
                hasher.update(self.key[k : k + WIDTH])
                self._nodes.append(hasher.digest())
        return self._nodes[depth]


class _Node:
    """Sums of a node of the result; ``lo`` is the place of a key below it."""

    __slots__ = ("depth", "lo", "open", "count", "low", "kids", "leaves", "saved", "ends")

    def __init__(self, keys: list[Key], lo: int, hi: int, depth: int, below: list[_Node], shared: bool):
        self.depth, self.lo = depth, lo
        self.open = shared and (lo == 0 or hi == len(keys))
        self.count = self.kids = self.leaves = self.saved = 0
        self.low = self.ends = None
        for k in range(lo, hi):
            key = keys[k]
            self.count += key.count[depth]
            self.kids += key.kids[depth]
            self.leaves += key.leaves[depth]
            self.saved += key.saved[depth]
            low = key.low[depth]
            if low is not None and (self.low is None or low < self.low):
                self.low = low
            if key.ends[depth] is not None:
                self.ends = key.ends[depth]
        for child in below:
            if not child.open:
                self.kids += 1
                self.leaves += child.leaves
                self.saved += child.saved
        if not self.open:
            self.leaves = self.leaves if self.kids else 1
            if depth:
                self.saved += (self.count - 1) * keys[lo].words[depth - 1]


def _families(keys: list[Key], shared: bool) -> Iterator[tuple[_Node, list[_Node]]]:
    """(node, its children) for all nodes over the sorted distinct ``keys``, children first.

    If ``shared``, other trees may hold keys below the nodes on the paths of the first and the
    last key; those nodes are open. In a key's order, a node's keys are one range.
    """
    tree = RadixTree()
    for k, key in enumerate(keys):
        tree.insert(key.key, k)
    done: list[tuple[int, int, list[_Node]]] = []  # (first key, last key, topmost nodes)
    frames = [(tree.root, iter(tree.root.items()), -1, 0)]
    while frames:
        node, children, above, held = frames[-1]
        bottom = above + 1 + len(node.path)
        child = next(children, None)
        if child is not None:
            frames.append((child, iter(child.items()), bottom, len(done)))
            continue
        frames.pop()
        parts = done[held:]
        del done[held:]
        lo = node.value if node.value is not None else parts[0][0]
        hi = parts[-1][1] if parts else lo + 1
        tops = [x for part in parts for x in part[2]]
        # The turns that end on this path, the byte that leads to it included.
        for depth in range(bottom // WIDTH, above // WIDTH, -1):
            here = _Node(keys, lo, hi, depth, tops, shared)
            yield here, tops
            tops = [here]
        done.append((lo, hi, tops))


def _handed_on(keys: list[Key], opened: dict[tuple[bool, int], _Node]) -> Iterator[dict]:
    """The paths of the first and the last key as rows for the next round."""
    first, last = keys[0], keys[-1]
    both = _shared(first.key, last.key) // WIDTH  # depth that the two paths share
    for key, is_last in ((first, False), (last, True)):
        if is_last and len(keys) == 1:
            return
        row = {"key": key.key, "turn_words": key.words}
        row |= {x: [] for x in ("count", "low", "kids", "below", "under", "ends")}
        for depth in range(len(key.words) + 1):
            node = None if is_last and depth <= both else opened[is_last and depth > both, depth]
            for name, value in (
                ("count", node.count if node else 0),
                ("low", node.low if node else None),
                ("kids", node.kids if node else 0),
                ("below", node.leaves if node else 0),
                ("under", node.saved if node else 0),
                ("ends", node.ends if node else None),
            ):
                row[name].append(value)
        yield row


def _tree_rows(keys: list[Key], shared: bool, named: bool) -> Iterator[dict]:
    """Rows of the finished nodes, and if ``shared``, of the two paths that are handed on.

    A row whose parent is open has the hash of the parent's turns in ``parent_node``. ``named``:
    rows give their own hash in ``node``, for rows of earlier rounds that wait for it.
    """
    opened: dict[tuple[bool, int], _Node] = {}

    def row(node: _Node, parent: _Node | None) -> dict:
        waits = parent is not None and parent.open
        return {
            "conv_id": node.low,
            "depth": node.depth,
            "parent_conv_id": None if waits or parent is None else parent.low,
            "parent_node": keys[parent.lo].node(parent.depth) if waits else None,
            "node": keys[node.lo].node(node.depth) if named else None,
            "n_convs": node.count,
            "n_children": node.kids,
            "n_leaves": node.leaves,
            "saved_tokens": node.saved,
            "ends_sha256": node.ends or _EMPTY_HASH,
        }

    for node, children in _families(keys, shared):
        for child in children:
            if not child.open:
                yield row(child, node)
        if node.open:
            opened[node.lo > 0, node.depth] = node
        elif node.depth == 0:
            yield row(node, None)
    if shared:
        yield from _handed_on(keys, opened)


_NODE = (
    "conv_id long, depth long, parent_conv_id long, parent_node binary, node binary, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
)
_PATH = (
    "key binary, turn_words array<long>, count array<long>, low array<long>, kids array<long>, "
    "below array<long>, under array<long>, ends array<string>"
)
_ROW = pa.schema(
    [(x, pa.int64()) for x in ("conv_id", "depth", "parent_conv_id")]
    + [(x, pa.binary()) for x in ("parent_node", "node")]
    + [(x, pa.int64()) for x in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    + [("ends_sha256", pa.string()), ("key", pa.binary())]
    + [(x, pa.list_(pa.int64())) for x in ("turn_words", "count", "low", "kids", "below", "under")]
    + [("ends", pa.list_(pa.string()))]
)


def _batches(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) >= 4096:
            yield pa.RecordBatch.from_pylist(held, _ROW)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, _ROW)


def _trees(keys: Iterator[Key], entries: int | None, named: bool) -> Iterator[dict]:
    """Rows of trees of about ``entries`` turns each; of one tree over all keys if None."""
    held: list[Key] = []
    size = 0
    for key in keys:
        held.append(key)
        size += len(key.words) + 1
        if entries is not None and size >= entries and len(held) >= 8:
            yield from _tree_rows(held, True, named)
            held, size = [], 0
    if held:
        yield from _tree_rows(held, entries is not None, named)


def _member_keys(batches) -> Iterator[Key]:
    """Keys from rows sorted by key and span. The ids of a key's members, however many, go
    through its hash in their order and are not kept."""
    key = None
    for batch in batches:
        columns = [batch.column(k) for k in range(5)]
        for this, members, least, ids, words in zip(*columns):
            this, members, least, ids = this.as_py(), members.as_py(), least.as_py(), ids.as_py().encode()
            if this == key:
                total += members
                low = min(low, least)
                hasher.update(b"," + ids)
                continue
            if key is not None:
                yield Key.of_members(key, turn_words, total, low, hasher.hexdigest())
            key, total, low, turn_words = this, members, least, words.as_py()
            hasher = hashlib.sha256(ids)
    if key is not None:
        yield Key.of_members(key, turn_words, total, low, hasher.hexdigest())


def _path_keys(batches) -> Iterator[Key]:
    for batch in batches:
        for row in batch.to_pylist():
            yield Key(
                row["key"], row["turn_words"], row["count"], row["low"], row["kids"], row["below"], row["under"], row["ends"]
            )  # fmt: skip


def rebuilt(turns: DataFrame) -> DataFrame:
    """``conv_id`` and the rebuilt ``turns`` (id, words) of each conversation: the first h turns
    of conversation c - c % 20, then its own after the first h, h = crc32(c) % 4."""
    role, text = (F.coalesce(F.col(x), F.lit("")) for x in ("role", "text"))
    written = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    conv = F.col("conv_id").cast("long")
    each = turns.where(conv.isNotNull()).select(
        (conv - conv % 20).alias("base"),
        conv.alias("conv_id"),
        F.struct(
            F.col("turn").alias("turn"),
            F.substring(F.sha2(written, 256), 1, 2 * WIDTH).alias("id"),
            F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
        ).alias("turn"),
    )
    # At most twenty conversations share a base, so all that follows stays in its partition.
    own = (
        each.repartition(F.col("base"))
        .groupBy("base", "conv_id")
        .agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    )
    head = F.when(F.col("conv_id") == F.col("base"), F.slice("turns", 1, 3))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    first = F.coalesce(F.slice("head", 1, F.col("h")), F.slice("turns", 1, 0))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return (
        own.withColumn("head", F.max(head).over(Window.partitionBy("base")))
        .withColumn("h", h)
        .select("conv_id", F.concat(first, rest).alias("turns"))
    )


def _member_rows(convs: DataFrame) -> DataFrame:
    """One row for each distinct conversation and span of ids: copies of one are combined
    before they meet, and no row holds more than `_SPAN` ids."""
    return (
        convs.select(
            "conv_id",
            F.unhex(F.array_join(F.col("turns.id"), "")).alias("key"),
            F.col("turns.words").alias("turn_words"),
            F.floor(F.col("conv_id") / _SPAN).alias("span"),
        )
        .groupBy("key", "span")
        .agg(
            F.count(F.lit(1)).alias("members"),
            F.min("conv_id").alias("least"),
            F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"),
            F.first("turn_words").alias("turn_words"),
        )
    )


def prefix_trie(convs: DataFrame, entries: int = 200_000) -> DataFrame:
    """The nodes of the trie over ``convs`` (``conv_id``, ``turns`` of id and words).

    ``conv_id`` (least member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens`` and ``ends_sha256`` of each distinct beginning, from the root
    without turns. A conversation is one row; ``conv_id`` must be unique and not null, and an
    ``id`` is 32 hex digits. An empty table gives no rows, a conversation without turns is a
    member of the root. ``entries``: turns of the keys that a tree is built over at a time, at
    least 8 keys.
    """
    spark = convs.sparkSession
    ship_package(spark)
    schema = f"{_NODE}, {_PATH}"
    members = staged(_member_rows(convs), "trie-members")

    def first_round(batches):
        yield from _batches(_trees(_member_keys(batches), entries, False))

    def next_round(batches):
        yield from _batches(_trees(_path_keys(batches), entries, True))

    def last_round(batches):
        yield from _batches(_trees(_path_keys(batches), None, True))

    dealt = members.select("key", "members", "least", "ids", "turn_words", "span")
    dealt = dealt.repartitionByRange("key").sortWithinPartitions("key", "span")
    rounds = [staged(dealt.mapInArrow(first_round, schema), "trie-1")]
    drop_staged(members)
    path = [x.split()[0] for x in _PATH.split(", ")]
    while True:
        paths = rounds[-1].where("key IS NOT NULL").select(*path)
        count, size = paths.agg(F.count(F.lit(1)), F.sum(F.size("turn_words") + 1)).first()
        if not count:
            break
        if size <= max(entries, 8):
            dealt, step = paths.repartition(1), last_round
        else:
            parts = max(1, min(size // entries, count // 8))
            dealt, step = paths.repartitionByRange(parts, "key"), next_round
            if parts == 1 and count < 16:
                step = last_round
        rounds.append(staged(dealt.sortWithinPartitions("key").mapInArrow(step, schema), f"trie-{len(rounds) + 1}"))
    nodes = reduce(DataFrame.unionByName, rounds).where("key IS NULL")
    named = nodes.where("node IS NOT NULL").select(F.col("node").alias("parent_node"), F.col("conv_id").alias("_parent"))
    out = [x for x in nodes.columns if x not in ("parent_node", "node", *path)]
    late = keyed_join(nodes.where("parent_node IS NOT NULL"), named, ["parent_node"], "conv_id")
    late = late.withColumn("parent_conv_id", F.col("_parent")).select(*out)
    return nodes.where("parent_node IS NULL").select(*out).union(late)


def conversation_trie(turns: DataFrame) -> DataFrame:
    """`prefix_trie` over rebuilt conversations (`rebuilt`).

    Turns are ordered by ``turn``, null first, equal ones by a hash of role and text. Null roles
    and texts are empty; rows with a null ``conv_id`` are in no conversation; repeated rows are
    turns each; other columns are not read; an empty table gives no rows.
    """
    return prefix_trie(rebuilt(turns))


def trie_query(spark, sf_dir: str) -> DataFrame:
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


SQL = r"""WITH RECURSIVE ids AS (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS s FROM conversations WHERE conv_id IS NOT NULL),
crc AS (SELECT conv_id, s, 0 AS k, 4294967295::BIGINT AS c FROM ids UNION ALL
  SELECT conv_id, s, k + 1, xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384::BIGINT ELSE 0 END) FROM (
    SELECT conv_id, s, k, CASE WHEN k % 8 = 0 THEN xor(c, ascii(s[k // 8 + 1])::BIGINT) ELSE c END AS x FROM crc WHERE k < 8 * length(s))),
hs AS (SELECT conv_id, xor(c, 4294967295::BIGINT) % 4 AS h FROM crc WHERE k = 8 * length(s)),
turns AS (SELECT conv_id, turn, substr(sha256(length(r) || ':' || r || x), 1, 32) AS id, len(regexp_extract_all(x, '[^ 	-]+')) AS words
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)),
own AS (SELECT conv_id, list(id ORDER BY turn NULLS FIRST, id) AS ids, list(words ORDER BY turn NULLS FIRST, id) AS words FROM turns GROUP BY conv_id),
built AS (SELECT o.conv_id, list_concat(coalesce(b.ids[1:h], []), o.ids[h + 1:]) AS ids, list_concat(coalesce(b.words[1:h], []), o.words[h + 1:]) AS words
  FROM own o JOIN hs USING (conv_id) LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20),
places AS (SELECT conv_id, ids, words, unnest(range(len(ids) + 1)) AS depth FROM built),
nodes AS (SELECT array_to_string(ids[1:depth], '') AS k, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(max(words[depth]), 0) AS words,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE len(ids) = depth), '')) AS ends_sha256 FROM places GROUP BY ALL),
children AS (SELECT substr(k, 1, 32 * (depth - 1)) AS k, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
counted AS (SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.k = n.k),
up AS (SELECT substr(k, 1, CAST(32 * j AS BIGINT)) AS k, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * words) AS saved
  FROM (SELECT *, unnest(range(depth + 1)) AS j FROM counted) GROUP BY 1)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, CAST(u.n_leaves AS BIGINT) AS n_leaves,
  CAST(u.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM counted n JOIN up u ON u.k = n.k LEFT JOIN nodes p ON n.depth > 0 AND p.k = substr(n.k, 1, 32 * (n.depth - 1))"""
