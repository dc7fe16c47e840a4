"""Best-fit packing: documents become token pieces, pieces become full sequences.

Best-fit decreasing looks only at lengths, and equal lengths are interchangeable. So Spark
counts the pieces of each length (at most ``capacity`` counts, whatever the data), the plan of
all sequences is made once from the counts, and Spark then deals each piece, by its rank among
the pieces of its length, to its place in the plan. The plan is that of best-fit decreasing
over the whole corpus, not over shards of it.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from valora.llm.bpe_automaton import byte_symbols, tokenizer_file
from valora.llm.common import partitions, salt_of, ship_package, staged
from valora.llm.part_cache import PartCache, flat, grouped

# --- tokens -----------------------------------------------------------------------------------

#: A single space before a character that is no white space always begins a token of the
#: byte-level pattern, so what lies between two such places can be encoded by itself.
_CUT = re.compile(r" (?=\S)")
#: How the byte-level pre-tokenizer splits text.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BEYOND = re.compile("[^\\x00-\u024f]")
_CACHES: dict[str, PartCache] = {}
#: Bytes of parts that a task keeps; two tasks of an executor hold it beside the heap.
_KEPT_BYTES = 24 << 20


class ByteBpe:
    """Encodes parts of text with a byte-level BPE file of the tokenizers library.

    Where ids follow the order of the merges, they are ranks as well, and the tiktoken library
    gives the same ids in a fifth of the time. Parts with special tokens, or with characters
    beyond the Latin blocks (which of the newer ones are letters differs between Unicode
    versions), and files of another order are left to the tokenizers library.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = [t["content"] for t in spec["added_tokens"]]
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.fast = None
        if all(vocab.get(a + b) == 256 + k for k, (a, b) in enumerate(merges)):
            from tiktoken import Encoding

            byte_of = {c: b for b, c in enumerate(byte_symbols())}
            ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if i < 256 + len(merges)}
            self.fast = Encoding("parts", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})
            self.bytes_of = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
            self.bytes_of[list(ranks.values())] = [len(token) for token in ranks]

    def _plain(self, text: str) -> bool:
        return not _BEYOND.search(text) and not any(s in text for s in self.special)

    def _joined(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts that each begin with a cut, encoded as one text: no token crosses a
        cut, so the lengths of the tokens in bytes tell which part they belong to."""
        ids = np.array(self.fast.encode_ordinary("".join(parts)), dtype="<u4")
        sizes = np.fromiter((len(x.encode()) for x in parts), np.int64, len(parts))
        ends = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum(sizes)) + 1
        return ids, np.diff(ends, prepend=0)

    def encode_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A part lost its leading space at the cut; the first part of a text, which had none,
        is marked by one."""
        whole = [x[1:] if x.startswith(" ") else " " + x for x in parts]
        alone = [k for k, x in enumerate(parts) if x.startswith(" ")]
        if self.fast is None:
            alone = range(len(parts))
        elif not self._plain("".join(whole)):
            alone = [k for k, x in enumerate(whole) if parts[k] == " " + x or not self._plain(x)]
        single = np.zeros(len(parts), dtype=bool)
        single[list(alone)] = True
        one, fast = self.library, self.fast
        found = [
            fast.encode_ordinary(whole[k])
            if fast is not None and self._plain(whole[k])
            else one.encode(whole[k], add_special_tokens=False).ids
            for k in alone
        ]
        groups = [(single, flat(found))]
        if not single.all():
            groups.append((~single, self._joined([whole[k] for k in np.nonzero(~single)[0]])))
        sizes = np.zeros(len(parts), dtype=np.int64)
        for mask, (_, some) in groups:
            sizes[mask] = some
        starts = np.cumsum(sizes) - sizes
        out = np.zeros(int(sizes.sum()), dtype="<u4")
        for mask, (ids, some) in groups:
            within = np.arange(len(ids)) - np.repeat(np.cumsum(some) - some, some)
            out[np.repeat(starts[mask], some) + within] = ids
        return out, sizes


def forget_parts(path: str) -> None:
    """Give back what this process kept of a tokenizer's parts."""
    if path in _CACHES:
        _CACHES[path].clear()
        pa.default_memory_pool().release_unused()


def _cache_of(path: str) -> PartCache:
    """One tokenizer and one cache of encoded parts per worker process."""
    if path not in _CACHES:
        _CACHES[path] = PartCache(ByteBpe(path).encode_parts, _KEPT_BYTES)
    return _CACHES[path]


def encoded(texts: Iterator[str], path: str) -> Iterator[np.ndarray]:
    """Token ids of whole texts, as the tokenizers library gives them for a byte-level BPE."""
    cache = _cache_of(path)
    for group in grouped(texts):
        split = [_CUT.split(text) if text else [] for text in group]
        for parts in split:
            if parts:
                parts[0] = " " + parts[0]
        yield from cache.encode(split)


PIECES = "doc_id long, piece int, start long, length long, ids binary"


def token_pieces(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 1024,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Token ids of each text and ``end_id``, cut into pieces of at most ``capacity`` tokens.

    Columns: ``doc_id``, ``piece`` (from 0), ``start`` (ids of the document before it),
    ``length``, ``ids`` (little-endian unsigned 32-bit integers). Only documents above the
    capacity are cut; their first piece takes the odd rest, all others are full. Null and
    empty texts give the single id ``end_id``. Repeated rows give repeated pieces, a null id
    stays null, other columns are not read. Batches of rows and of pieces stay small, so a
    task holds one long text at a time.
    """
    ship_package(docs.sparkSession)

    def run(batches):
        for batch in batches:
            ids_of = batch.column(0).to_pylist()
            rows: list[tuple] = []
            held = 0
            texts = (x.as_py() or "" for x in batch.column(1))
            for doc, ids in zip(ids_of, encoded(texts, tokenizer)):
                ids = np.append(ids, np.array([end_id], dtype="<u4"))
                first = len(ids) % capacity or capacity
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    rows.append((doc, k, a, b - a, ids[a:b].astype("<u4").tobytes()))
                held += len(ids)
                if held > 1 << 20:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)
        # the worker lives on; later stages need the memory
        forget_parts(tokenizer)

    picked = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    )
    return picked.mapInArrow(run, PIECES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    names = ("doc_id", "piece", "start", "length", "ids")
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=k) for c, k in zip(zip(*rows), kinds)], names=names
    )


# --- plan -------------------------------------------------------------------------------------


class CapacityTree:
    """Segment tree over the remaining capacities 0..top: which of them have an open bin."""

    def __init__(self, top: int) -> None:
        self.size = 1
        while self.size <= top:
            self.size *= 2
        self.open = np.zeros(2 * self.size, dtype=bool)

    def set(self, capacity: int, is_open: bool) -> None:
        at = capacity + self.size
        self.open[at] = is_open
        at //= 2
        while at:
            self.open[at] = self.open[2 * at] or self.open[2 * at + 1]
            at //= 2

    def tightest(self, least: int) -> int | None:
        """The smallest open capacity that is at least ``least``."""
        at = least + self.size
        if self.open[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.open[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None


@dataclass
class Plan:
    """Where the pieces of each length go: steps in the order of their rank.

    A step takes ``count`` pieces into bins ``bin``, ``bin + 1``, ..., ``each`` to a bin,
    the first of them at ``offset``.
    """

    length: np.ndarray
    rank: np.ndarray
    bin: np.ndarray
    each: np.ndarray
    offset: np.ndarray
    bins: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = self.length.astype(np.int64) * (1 << 44) + self.rank
        at = np.searchsorted(key, length.astype(np.int64) * (1 << 44) + rank, side="right") - 1
        within = rank - self.rank[at]
        return (
            self.bin[at] + within // self.each[at],
            self.offset[at] + within % self.each[at] * length,
        )


def best_fit_plan(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing over lengths with counts.

    Bins with the same contents are held as runs of consecutive numbers under their
    remaining capacity. One look into the tree finds the tightest capacity that fits, and a
    whole run of such bins is filled at once with as many pieces each as one-by-one best fit
    would put there: after a piece a bin is tighter still, so it is filled up before the next.
    The number of runs depends on the capacity alone, not on the number of pieces.
    """
    tree = CapacityTree(capacity)
    runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    steps: list[tuple[int, int, int, int, int]] = []
    bins = 0

    def add(left: int, first: int, n: int) -> None:
        if n and left:
            if not runs[left]:
                tree.set(left, True)
            runs[left].append((first, n))

    for length in sorted(counts, reverse=True):
        todo, rank = counts[length], 0
        while todo:
            room = tree.tightest(length)
            if room is None:
                first, n, room = bins, -(-todo // (capacity // length)), capacity
                bins += n
            else:
                first, n = runs[room].pop()
                if not runs[room]:
                    tree.set(room, False)
            each = room // length
            full = min(n, todo // each)
            if full:
                steps.append((length, rank, first, each, capacity - room))
                rank += full * each
                todo -= full * each
                add(room - each * length, first, full)
            if full < n and todo:
                some = todo
                steps.append((length, rank, first + full, each, capacity - room))
                rank, todo = rank + some, 0
                add(room - some * length, first + full, 1)
                full += 1
            add(room, first + full, n - full)
    columns = np.array(sorted(steps), dtype=np.int64).reshape(-1, 5).T
    return Plan(*columns, bins)


PACKED = "sequence_id long, offset long"


def pack(pieces: DataFrame, capacity: int = 1024, length_col: str = "length") -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces of 1 to ``capacity`` tokens.

    Sequences are filled without gaps from offset 0 by best-fit decreasing over all pieces.
    ``pieces`` needs the columns ``doc_id``, ``piece`` and the length; further columns are
    kept. Equal pieces are told apart only by rank, so it does not matter which of them takes
    which place. A null or non-positive length, or one above the capacity, is an error. An
    empty table gives no rows.

    The rank within a length is taken in two steps, so that no frequent length is ranked in
    one task: within (length, salt of the document), and by the counts of the salts before.
    """
    spark = pieces.sparkSession
    ship_package(spark)
    salts = 4 * partitions(spark)
    wrong = F.col(length_col).isNull() | ~F.col(length_col).between(1, capacity)
    length = F.when(wrong, F.raise_error(F.lit("piece length outside 1..capacity"))).otherwise(
        F.col(length_col).cast("long")
    )
    rows = staged(
        pieces.withColumn("_length", length).withColumn(
            "_salt", salt_of(F.concat_ws(":", "doc_id", "piece"), salts)
        ),
        "packing-pieces",
    )
    counts = rows.groupBy("_length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    totals = counts.groupBy("_length").agg(F.sum("_n").alias("n")).collect()
    plan = best_fit_plan({int(r["_length"]): int(r["n"]) for r in totals}, capacity)

    ranked = rows.withColumn(
        "_rank",
        F.row_number().over(Window.partitionBy("_length", "_salt").orderBy("doc_id", "piece")) - 1,
    ).join(starts, ["_length", "_salt"])
    dealt = ranked.withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_salt", "_before")
    kept = [c for c in pieces.columns]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)

    def run(batches):
        for batch in batches:
            at = {n: i for i, n in enumerate(batch.schema.names)}
            lengths = batch.column(at["_length"]).to_numpy()
            ranks = batch.column(at["_rank"]).to_numpy()
            bins, offsets = plan.place(lengths, ranks)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(at[c]) for c in kept], pa.array(bins), pa.array(offsets)],
                names=[*kept, "sequence_id", "offset"],
            )

    return dealt.mapInArrow(run, f"{schema}, {PACKED}")


def packing_query(spark, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet") if docs is None else docs
    pieces = token_pieces(docs, tokenizer_file("byte_bpe_50k.json"))
    narrow = pieces.select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")
    )
    return pack(narrow)
