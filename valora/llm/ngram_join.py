"""N-gram Jaccard join: documents whose sets of word shingles are similar, as components.

Two sets of similarity t or more differ in at most H elements, where H follows from their
sizes. Sizes fall into bands; each band has its own partition of the universe of shingles into
H + 1 segments. By the pigeonhole principle two similar sets agree on at least one segment, or
differ by one element on a segment that is given two units of the budget. So

* each set is indexed by a signature of its part of every segment, in the scheme of its own
  band and of the lower bands that hold possible partners; a few more segments than H + 1 make
  up for those that are empty, which are left out;
* a segment may be skipped if another one is indexed with its one-deletion neighbourhood
  (its part and the part less each element); which segments, is decided by the cost of the
  collisions counted on all sets;
* sets that share a signature are compared exactly, from their texts.

Only components are asked for, so the sets of a bucket are first compared with one of them.
Buckets that are then of one component are done; in the others all pairs across components are
compared. Every similar pair shares a bucket, so no link is lost, and a large group of near
copies costs a number of comparisons in proportion to its size.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valora.llm.common import (
    drop_staged,
    in_parts,
    keyed_join,
    membership_filter,
    mixed,
    passes,
    ship_package,
    staged,
)
from valora.llm.components import components

_U = np.uint64
#: Word hashes, and sets seen, that a worker keeps before it starts afresh (some 50 MB each);
#: hashes of longer words are not kept.
WORDS, SEEN, KEPT_WORD = 200_000, 300_000, 64
#: Orders in which the first set of a bucket is chosen, a power of two.
CENTERS = 4
#: First signatures that a set keeps, to see where it met another one before.
LOW = 8


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= KEPT_WORD:
            if len(self) > WORDS:
                self.clear()
            self[word] = value
        return value


_WORDS = _Words()


def _give_back() -> None:
    """At the end of a task: the worker lives on, and other stages need the memory."""
    _WORDS.clear()
    pa.default_memory_pool().release_unused()


def shingles(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct hashes of the ``words``-word shingles; ASCII case does not count.

    A text of fewer words is one shingle, a text without words has none.
    """
    found = text.lower().split()  # bytes: only A-Z change, only ASCII white space splits
    n = len(found)
    if not n:
        return np.zeros(0, dtype=_U)
    h = np.fromiter(map(_WORDS.__getitem__, found), dtype=_U, count=n)
    factors = mixed(np.arange(1, min(n, words) + 1, dtype=_U)) | _U(1)
    span = max(1, n - words + 1)
    total = np.full(span, len(factors), dtype=_U)
    for j, factor in enumerate(factors):
        total += h[j : j + span] * factor
    return np.unique(mixed(total))


@dataclass
class Scheme:
    """Bands of set sizes and the segments of each band, for a similarity in percent.

    Segments that are empty in both sets agree and say nothing. A band has ``slack`` segments
    more than its budget asks for: two similar sets that have at most so many common empty
    segments agree on one that is not empty. A set with more empty ones than that, which is
    rare, is indexed by them as well, so that two such sets meet there.
    """

    percent: int
    growth: float = 1.5
    lows: np.ndarray = field(init=False)
    segments: np.ndarray = field(init=False)
    slack: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        lows, low = [], 1
        while low < 1 << 31:
            lows.append(low)
            low = max(low + 1, int(low * self.growth) + 1)
        self.lows = np.array([*lows, low], dtype=np.int64)
        top = self.lows[1:] - 1
        least = self.most_apart(top, top * 100 // self.percent) + 1
        self.slack = np.array([self._slack(int(m), int(low)) for m, low in zip(least, lows)])
        self.segments = least + self.slack

    @staticmethod
    def _slack(least: int, low: int) -> int:
        """Two deviations above the empty segments that the smallest sets of a band have; none
        where segments are so small that more of them only add empty ones."""

        def enough(slack: int) -> bool:
            m = least + slack
            each = low / m
            empty = m * np.exp(-each)
            return bool(slack >= empty + 2 * np.sqrt(empty * (1 - (1 + each) * np.exp(-each))))

        # by halving: bands reach sets of 2^31 elements, too many to try each number
        found = bisect_left(range(least), True, key=enough) if least > 1 else least
        return found if found < least else 0

    def most_apart(self, a, b):
        """In how many elements similar sets of these sizes can differ."""
        return (100 - self.percent) * (a + b) // (100 + self.percent)

    def bands_of(self, size: int) -> range:
        """The bands in which a set is indexed: its own and those of smaller partners. Where
        the budget is 0 only equal sets are similar, and those are one class already."""
        least = -(-self.percent * size // 100)
        low, high = np.searchsorted(self.lows, [least, size], side="right") - 1
        return range(low, high + 1)


def segment_code(band, segment):
    return band * (1 << 32) + segment


#: Allocation of a band: segments that are skipped, and segments with one-deletion lists.
Allocation = dict[int, tuple[set[int], set[int]]]


def signatures(
    tokens: np.ndarray, scheme: Scheme, allocation: Allocation | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of a set and their segment codes.

    Without an allocation: the whole part on every segment, on empty ones only if there are more
    than the band's slack. With one: only the one-deletion
    neighbourhoods of the segments that it names for that.
    """
    sigs, codes = [], []
    place = mixed(tokens ^ _U(0x9E3779B97F4A7C15))
    for band in scheme.bands_of(len(tokens)):
        m = int(scheme.segments[band])
        if m == 1 or (allocation is not None and not allocation.get(band, (0, 0))[1]):
            continue
        at = (place % _U(m)).astype(np.int64)
        sums = np.zeros(m, dtype=_U)
        np.add.at(sums, at, tokens)
        code = segment_code(int(band), np.arange(m, dtype=np.int64))
        if allocation is None:
            sig = mixed(sums + mixed(code.astype(_U)))
            filled = np.bincount(at, minlength=m) > 0
            if m - np.count_nonzero(filled) <= scheme.slack[band]:
                sig, code = sig[filled], code[filled]
            sigs.append(sig)
            codes.append(code)
            continue
        base = mixed(code.astype(_U) ^ _U(0x5851F42D4C957F2D))
        chosen = np.array(sorted(allocation[band][1]), dtype=np.int64)
        sigs.append(mixed(sums[chosen] + base[chosen]))
        codes.append(code[chosen])
        inside = np.isin(at, chosen)
        own = at[inside]
        sigs.append(mixed(sums[own] - tokens[inside] + base[own]))
        codes.append(code[own])
    if not sigs:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(sigs).view(np.int64), np.concatenate(codes)


def allocate(
    collisions: dict[int, float], sets: dict[int, int], scheme: Scheme
) -> Allocation:
    """Skip segments whose collisions cost more than another segment's deletion list.

    ``collisions``: pairs of sets that meet, by segment code; ``sets``: indexed sets by band.
    Each skipped segment gives up one unit of the budget, each deletion list takes one more,
    so they are chosen in pairs: dearest skipped, cheapest widened, while that pays.
    """
    out: Allocation = {}
    by_band: dict[int, list[tuple[float, int]]] = {}
    for code, pairs in collisions.items():
        by_band.setdefault(code >> 32, []).append((pairs, code & 0xFFFFFFFF))
    for band, dear in by_band.items():
        m = int(scheme.segments[band])
        part = float(scheme.lows[band + 1]) / m + 1  # elements of a segment, at most on average
        known = {s: p for p, s in dear}
        cheap = sorted(range(m), key=lambda s: (known.get(s, 0), s))
        skipped: set[int] = set()
        widened: set[int] = set()
        for pairs, segment in sorted(dear, reverse=True):
            other = cheap[len(widened)]
            price = part * (sets.get(band, 0) + known.get(other, 0))
            if other == segment or other in skipped or pairs <= price or segment in widened:
                break
            skipped.add(segment)
            widened.add(other)
        if skipped:
            out[band] = (skipped, widened)
    return out


#: Words of the parity sketch of a set.
SKETCH = 4
_SKETCHES = [f"s{k}" for k in range(SKETCH)]
_SET = (
    "doc_id long, n long, d1 long, d2 long, "
    + ", ".join(f"{s} long" for s in _SKETCHES)
    + ", sigs array<long>, codes array<long>"
)


def _digest(tokens: np.ndarray) -> tuple[int, int]:
    """128-bit digest of a set."""
    whole = xxhash.xxh3_128_intdigest(tokens.tobytes())
    return _signed(whole & (1 << 64) - 1), _signed(whole >> 64)


def _sketch(tokens: np.ndarray) -> list[int]:
    """For each bit, whether an odd number of elements fall on it."""
    bits = 64 * SKETCH
    place = (mixed(tokens ^ _U(0xD6E8FEB86659FD93)) & _U(bits - 1)).astype(np.int64)
    odd = (np.bincount(place, minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64).tolist()


def _wide_sketch(tokens: np.ndarray) -> bytes:
    """A parity sketch of about one bit per element: a power of two, so that it can be folded
    to the length of a smaller set's."""
    bits = max(256, 1 << max(0, len(tokens) - 1).bit_length())
    place = (mixed(tokens ^ _U(0xA0761D6478BD642F)) & _U(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=bits) & 1).astype(np.uint8)).tobytes()


def _bits_apart(a: bytes, b: bytes) -> int:
    """Bits in which two wide sketches differ, at the length of the shorter one: at most the
    number of elements in which the sets differ."""
    one, two = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(one) > len(two):
        one = one[: len(one) // 2] ^ one[len(one) // 2 :]
    while len(two) > len(one):
        two = two[: len(two) // 2] ^ two[len(two) // 2 :]
    return int(np.bitwise_count(one ^ two).sum())


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("text").cast("binary").alias("text"))


def document_sets(docs: DataFrame, words: int, scheme: Scheme) -> DataFrame:
    """The shingle set of each row: size ``n``, digest ``d1``/``d2``, parity sketch, and its
    signatures with their segment codes. A set is indexed once per task, however many
    documents of the task have it; for the others, and for rows without an id, the signatures
    are null.
    """

    def run(batches):
        seen: set[tuple[int, int]] = set()
        for batch in in_parts(batches, 1):
            rows = []
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                tokens = shingles(text.as_py() or b"", words)
                d1, d2 = _digest(tokens)
                sigs = codes = None
                if len(tokens) and doc_id.is_valid and (d1, d2) not in seen:
                    if len(seen) > SEEN:
                        seen.clear()
                    seen.add((d1, d2))
                    sigs, codes = signatures(tokens, scheme)
                rows.append((len(tokens), d1, d2, *_sketch(tokens), sigs, codes))
            columns = list(zip(*rows)) if rows else [()] * (SKETCH + 5)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *[pa.array(c, pa.int64()) for c in columns[:-2]],
                    *[pa.array(c, pa.list_(pa.int64())) for c in columns[-2:]],
                ],
                ["doc_id", "n", "d1", "d2", *_SKETCHES, "sigs", "codes"],
            )
        _give_back()

    return _narrow(docs).mapInArrow(run, _SET)


_INDEX = "sig long, cls long, code long"


def _index_batch(*columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(c), pa.int64()) for c in columns], ["sig", "cls", "code"]
    )


def shared_index(sets: DataFrame, only: np.ndarray) -> DataFrame:
    """``sig``, ``cls`` (first half of the set's digest) and ``code`` of the signatures that
    the membership filter ``only`` lets pass."""

    def run(batches):
        for batch in batches:
            kept = passes(only, batch.column(0).to_numpy())
            yield batch.filter(pa.array(kept, pa.bool_()))

    # rows of one signature each: an Arrow batch of whole sets would hold some 10,000 indexes
    each = sets.where("sigs IS NOT NULL").select("d1", F.inline(F.arrays_zip("sigs", "codes")))
    return each.select(
        F.col("sigs").alias("sig"), F.col("d1").alias("cls"), F.col("codes").alias("code")
    ).mapInArrow(run, _INDEX)


def widened_index(
    docs: DataFrame, words: int, scheme: Scheme, allocation: Allocation
) -> DataFrame:
    """The one-deletion neighbourhoods of the segments that ``allocation`` names for that."""

    def run(batches):
        seen: set[int] = set()
        sigs, classes, codes, held = [], [], [], 0
        for batch in in_parts(batches, 1):
            for text in batch.column(1):
                tokens = shingles(text.as_py() or b"", words)
                d1 = _digest(tokens)[0]
                if not len(tokens) or d1 in seen:
                    continue
                if len(seen) > SEEN:
                    seen.clear()
                seen.add(d1)
                sig, code = signatures(tokens, scheme, allocation)
                if len(sig):
                    sigs.append(sig)
                    codes.append(code)
                    classes.append(np.full(len(sig), d1))
                    held += len(sig)
                if held > 200_000:
                    yield _index_batch(sigs, classes, codes)
                    sigs, classes, codes, held = [], [], [], 0
        if held:
            yield _index_batch(sigs, classes, codes)
        _give_back()

    return _narrow(docs).mapInArrow(run, _INDEX)


def _texts(docs: DataFrame, members: DataFrame, words: int) -> DataFrame:
    """``cls``, ``rep``, ``text``, size and wide sketch of a document of each class in
    ``members``."""
    hashed = members.withColumn("place", F.xxhash64("rep"))
    only = membership_filter(hashed, "place")

    def wanted(batches):
        for batch in batches:
            kept = passes(only, batch.column(2).to_numpy())
            if kept.any():
                yield batch.filter(pa.array(kept)).select(["rep", "text"])

    def same_set(batches):
        for batch in in_parts(batches, 3):
            kept, sizes, wide = [], [], []
            for d1, d2, text in zip(
                batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)
            ):
                tokens = shingles(text.as_py() or b"", words)
                kept.append(_digest(tokens) == (d1, d2))
                sizes.append(len(tokens))
                wide.append(_wide_sketch(tokens))
            yield pa.RecordBatch.from_arrays(
                [*batch.select(["d1", "rep", "text"]).columns, pa.array(sizes, pa.int64()), pa.array(wide, pa.binary())],
                ["d1", "rep", "text", "n", "wide"],
            ).filter(pa.array(kept, pa.bool_()))
        _give_back()

    rows = _narrow(docs).select(
        F.col("doc_id").alias("rep"), "text", F.xxhash64("doc_id").alias("place")
    )
    found = rows.mapInArrow(wanted, "rep long, text binary")
    joined = members.select("rep", "d1", "d2").join(found, "rep").select("d1", "d2", "rep", "text")
    return (
        joined.mapInArrow(same_set, "d1 long, rep long, text binary, n long, wide binary")
        .dropDuplicates(["d1", "rep"])
        .withColumnRenamed("d1", "cls")
    )


def _verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs of classes (a, b) whose sets are similar, as edges between documents.

    Wide sketches go to the pairs first, at a bit per element, and texts only to those left.
    """

    def near(batches):
        for batch in batches:
            kept = []
            sizes = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            for (n, m), x, y in zip(sizes, batch.column(4), batch.column(5)):
                apart = (100 - percent) * (n + m) // (100 + percent)
                kept.append(_bits_apart(x.as_py(), y.as_py()) <= apart)
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    def run(batches):
        last, tokens = None, None
        for batch in in_parts(batches, 3):
            out = []
            ids = zip(
                batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(4).to_pylist()
            )
            for k, (a, b, cls) in enumerate(ids):
                if (a, cls) != last:
                    last, tokens = (a, cls), shingles(batch.column(1)[k].as_py(), words)
                other = shingles(batch.column(3)[k].as_py(), words)
                both = len(np.intersect1d(tokens, other, assume_unique=True))
                if 100 * both >= percent * (len(tokens) + len(other) - both):
                    out.append((a, b))
            a, b = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        _give_back()

    one = texts.select(F.col("cls").alias("a"), F.col("rep").alias("rep_a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("cls").alias("b"), F.col("rep").alias("rep_b"), F.col("text").alias("text_b"))
    left = texts.select(F.col("cls").alias("a"), F.col("n").alias("n_a"), F.col("wide").alias("wide_a"))
    right = texts.select(F.col("cls").alias("b"), F.col("n").alias("n_b"), F.col("wide").alias("wide_b"))
    sketched = pairs.join(right, "b").join(left, "a").select("a", "b", "n_a", "n_b", "wide_a", "wide_b")
    pairs = sketched.mapInArrow(near, "a long, b long").distinct()
    wide = pairs.join(two, "b").join(one, "a").where("rep_a != rep_b")
    return wide.select("rep_a", "text_a", "rep_b", "text_b", "a").mapInArrow(run, "a long, b long")


def _alike(percent: int) -> Column:
    """Whether the sizes and sketches (of sides a and b) allow the similarity. An element of
    one set alone turns one bit of the sketches' difference, so too many bits rule it out."""
    a, b = F.col("n_a"), F.col("n_b")
    bits = [F.bit_count(F.col(f"{s}_a").bitwiseXOR(F.col(f"{s}_b"))) for s in _SKETCHES]
    apart = F.expr(f"({100 - percent} * (n_a + n_b)) div {100 + percent}")
    sizes = 100 * F.least(a, b) >= percent * F.greatest(a, b)
    return sizes & (sum(bits[1:], bits[0]) <= apart)


def _side(df: DataFrame, side: str, *columns: str) -> DataFrame:
    """``columns``, size and sketch with the name of a side of a pair behind them."""
    return df.select(*[F.col(c).alias(f"{c}_{side}") for c in (*columns, "n", *_SKETCHES)])


def _star_pairs(shared: DataFrame, members: DataFrame, scheme: Scheme) -> DataFrame:
    """Pairs (a, b) of a bucket's center with its other classes."""
    side = members.select(F.col("d1").alias("cls"), "n", *_SKETCHES).distinct()
    stars = shared.where("cls != center").select(F.col("center").alias("a"), F.col("cls").alias("b"))
    return (
        stars.distinct()
        .join(_side(side, "a", "cls").withColumnRenamed("cls_a", "a"), "a")
        .join(_side(side, "b", "cls").withColumnRenamed("cls_b", "b"), "b")
        .where(_alike(scheme.percent))
        .select("a", "b")
        .distinct()
    )


def _groups_alike(percent: int) -> Column:
    """Whether any set of group a may be similar to one of group b: by the smallest and largest
    size, and by the bits that all sketches of one side have and none of the other."""
    apart = [
        F.bit_count(
            F.col(f"{s}_all_a").bitwiseAND(F.bitwise_not(F.col(f"{s}_any_b"))).bitwiseOR(
                F.col(f"{s}_all_b").bitwiseAND(F.bitwise_not(F.col(f"{s}_any_a")))
            )
        )
        for s in _SKETCHES
    ]
    most = F.expr(f"({100 - percent} * (most_a + most_b)) div {100 + percent}")
    sizes = (100 * F.col("most_a") >= percent * F.col("least_b")) & (
        100 * F.col("most_b") >= percent * F.col("least_a")
    )
    return sizes & (sum(apart[1:], apart[0]) <= most)


def _cross_pairs(shared: DataFrame, labels: DataFrame, scheme: Scheme) -> DataFrame:
    """Pairs (a, b) of classes of a bucket that are in different components so far.

    Components of a bucket are paired first, if some of their classes may be alike; then the
    smaller one of a pair is listed, and meets those of the other that are alike. Two classes
    that share many buckets meet in few of them: ``low`` are a class's first signatures, and a
    pair that has one of them in common met there.
    """
    rows = staged(
        shared.where("cls != center").select("sig", "cls").join(labels, "cls"), "ngram-labelled"
    )
    several = rows.groupBy("sig").agg(F.min("label").alias("l"), F.max("label").alias("m")).where("l != m")
    met = rows.join(several.select("sig"), "sig", "left_semi")
    low = met.groupBy("cls").agg(F.slice(F.array_sort(F.collect_set("sig")), 1, LOW).alias("low"))
    met = staged(met.join(low, "cls"), "ngram-met")
    drop_staged(rows)
    bounds = [F.min("n").alias("least"), F.max("n").alias("most"), F.first("low").alias("low")]
    for s in _SKETCHES:
        bounds += [F.bit_and(s).alias(f"{s}_all"), F.bit_or(s).alias(f"{s}_any")]
    groups = met.groupBy("sig", "label").agg(F.count(F.lit(1)).alias("k"), *bounds)
    groups = staged(groups, "ngram-groups")

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select("sig", *[F.col(c).alias(f"{c}_{name}") for c in df.columns if c != "sig"])

    smaller = F.struct("k_a", "label_a") < F.struct("k_b", "label_b")
    single = (F.col("k_a") == 1) & (F.col("k_b") == 1)
    common = F.array_min(F.array_intersect("low_a", "low_b"))  # no lambda: joins stay compiled
    earlier = F.coalesce(common < F.col("sig"), F.lit(False))
    across = (
        side(groups, "a")
        .join(side(groups, "b"), "sig")
        .where(smaller & _groups_alike(scheme.percent) & ~(single & earlier))
        .select("sig", "label_a", "label_b")
    )
    return (
        across.join(side(met, "a"), ["sig", "label_a"])
        .join(side(met, "b"), ["sig", "label_b"])
        .where(_alike(scheme.percent) & ~earlier)
        .select(F.least("cls_a", "cls_b").alias("a"), F.greatest("cls_a", "cls_b").alias("b"))
        .distinct()
    )


def ngram_components(
    docs: DataFrame,
    words: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of each row of ``docs``.

    Two documents link when the Jaccard similarity of their shingle sets is at least
    ``percent`` / 100, counted exactly; the component is the smallest id reachable by links.
    Null texts and texts without words have an empty set and link with nothing. Rows of one id
    are one document: they share a component. A row with a null id links with nothing and has
    a null component. Other columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    ship_package(spark)
    scheme = Scheme(percent)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sets = staged(document_sets(docs, words, scheme), "ngram-sets")
    filled = sets.where("n > 0 AND doc_id IS NOT NULL")
    classes = staged(
        filled.groupBy("d1", "d2").agg(
            F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("n", *_SKETCHES)]
        ),
        "ngram-classes",
    )

    known = docs.where(F.col("doc_id").isNotNull())
    each = filled.select(F.explode("sigs").alias("sig"))
    twice = each.groupBy("sig").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    rows = staged(shared_index(filled, membership_filter(twice, "sig")), "ngram-index")

    def buckets(rows: DataFrame) -> DataFrame:
        """Signatures of at least two sets, with one of them and the number of rows. Which one
        comes first goes by one of ``CENTERS`` orders, so that a set that is in many buckets
        meets several of the sets that are like it."""
        order = F.xxhash64("cls", F.col("sig").bitwiseAND(CENTERS - 1))
        return (
            rows.groupBy("sig")
            .agg(
                F.min_by("cls", order).alias("center"),
                F.max_by("cls", order).alias("last"),
                F.count(F.lit(1)).alias("k"),
                F.first("code").alias("code"),
            )
            .where("center != last")
        )

    found = staged(buckets(rows), "ngram-buckets")
    pairs_at = found.groupBy("code").agg(F.sum(F.expr("k * (k - 1.0) / 2")).alias("pairs"))
    band_of = F.lit(-1)
    for band, low in enumerate(scheme.lows[:-1]):
        band_of = F.when(F.col("n") >= int(low), F.lit(band)).otherwise(band_of)
    sizes = classes.groupBy(band_of.alias("band")).agg(F.count(F.lit(1)).alias("k")).collect()
    allocation = allocate(
        {r["code"]: float(r["pairs"]) for r in pairs_at.collect()},  # segments, not sets
        {r["band"]: r["k"] for r in sizes},
        scheme,
    )
    if allocation:
        old = [rows, found]
        gone = [int(segment_code(b, s)) for b, (skip, wide) in allocation.items() for s in skip | wide]
        rows = staged(
            rows.where(~F.col("code").isin(gone)).union(
                widened_index(known, words, scheme, allocation)
            ),
            "ngram-index",
        )
        found = staged(buckets(rows), "ngram-buckets")
        drop_staged(*old)

    shared = staged(
        rows.select("sig", "cls").join(found.select("sig", "center"), "sig").distinct(), "ngram-shared"
    )
    drop_staged(rows, found)
    wanted = shared.select(F.col("cls").alias("d1")).distinct()
    members = staged(classes.join(wanted, "d1"), "ngram-members")
    texts = staged(_texts(known, members, words), "ngram-texts")

    first = staged(
        _verified(_star_pairs(shared, members, scheme), texts, words, percent), "ngram-links"
    )
    stars_of = staged(components(first), "ngram-stars")
    drop_staged(first)

    labels = members.join(
        stars_of.select(F.col("node").alias("rep"), "component"), "rep", "left"
    ).select(
        F.col("d1").alias("cls"), F.coalesce("component", "rep").alias("label"), "n", *_SKETCHES
    )
    second = staged(_verified(_cross_pairs(shared, labels, scheme), texts, words, percent), "ngram-links")
    drop_staged(shared, members, texts)
    joined = components(
        stars_of.select(F.col("node").alias("a"), F.col("component").alias("b")).union(second)
    )

    named = classes.join(
        joined.select(F.col("node").alias("rep"), "component"), "rep", "left"
    ).select("d1", "d2", F.coalesce("component", "rep").alias("component"))
    alone = sets.where("n = 0 OR doc_id IS NULL").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")
    )
    out = keyed_join(filled.select("doc_id", "n", "d1", "d2"), named, ["d1", "d2"], "doc_id")
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id")
    ).union(alone)


def ngram_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return ngram_components(docs, words=3, percent=90)
