"""Phrase collocation mining: frequent phrases of each language, scored by their weakest cut.

Level by level, as in Apriori: a phrase of k words can only be frequent if its first and its
last k - 1 words are. Each level takes two steps.

* Candidates. At every position where both parts of k - 1 words may be frequent (a membership
  filter of fixed size, which never misses one) the pair of their hashes is counted. Hashes
  that collide only add, so the sums bound the counts from above, and pairs whose sum reaches
  the limit are the candidates; nothing is paired that does not stand together in a text.
* Counts. Words are known by two 64-bit hashes, which numpy takes for all words of a block of text
  at once. The candidates are dealt into shards of bounded size. Each shard becomes a
  double-array trie, which is broadcast; numpy advances the states of all text positions by one
  word at a time, and accepting states are counted with ``bincount``. The sums over the tasks
  are exact, whatever the hashes did.

The candidates of the next level are gathered in the same pass over the texts, so five levels
take six passes (more if a level has several shards).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from valora.llm.common import drop_staged, membership_filter, mixed, passes, salt_of, ship_package, staged

_U = np.uint64
#: Fixed values of the contract: characters that end a piece, and those between words.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_GAPS = b" \t"
#: One byte for all ends of pieces; it is in no word.
_END = b"."
_LOWER = bytes(
    _END[0] if b in _ENDS else 32 if b in _GAPS else b + 32 if 65 <= b <= 90 else b
    for b in range(256)
)
#: Bytes of text that are cut into words at a time.
_BLOCK = 1 << 20
#: Bytes of words counted and number of pairs gathered by a task before they are handed on.
_HELD_BYTES, _PAIRS = 1 << 25, 1 << 21
#: Bytes whose hash values are summed at a time.
_SEGMENT = 1 << 16
#: Slices of a language whose best phrases are found apart before they are ranked together.
RANK_SLICES = 64
#: Multiplier of the phrase hashes.
_STEP = _U(0x9E3779B97F4A7C15)


def _blocks(text: bytes) -> Iterator[bytes]:
    """A text in lower case in blocks that end between words; one space or end between words."""
    text = text.translate(_LOWER)
    at = 0
    while len(text) - at > _BLOCK:
        cut = max(text.rfind(b" ", at, at + _BLOCK), text.rfind(_END, at, at + _BLOCK))
        if cut <= at:  # a word longer than a block
            after = [x for x in (text.find(b" ", at + 1), text.find(_END, at + 1)) if x >= 0]
            cut = min(after, default=len(text))
        yield text[at:cut]
        at = cut
    yield text[at:]


def _streams(batches) -> Iterator[tuple[str, bytes, bool]]:
    """(language, text in lower case, whether it goes on from the one before).

    Short texts of a language share a block; a long text comes in several that go on.
    """
    for batch in batches:
        held: dict[str, list[bytes]] = {}
        sizes: Counter[str] = Counter()

        def flush(lang, held=held, sizes=sizes):
            sizes.pop(lang)
            return lang, _END.join([*held.pop(lang), b""]), False

        for lang, value in zip(batch.column(0), batch.column(1)):
            lang, text = lang.as_py(), value.as_py()
            if not text:
                continue
            if len(text) > _BLOCK:
                on = False
                for block in _blocks(text):
                    yield lang, block, on
                    on = True
                continue
            held.setdefault(lang, []).append(text.translate(_LOWER))
            sizes[lang] += len(text)
            if sizes[lang] > _BLOCK:
                yield flush(lang)
        for lang in list(held):
            yield flush(lang)


class _Rolling:
    """A 64-bit polynomial hash of many parts of a text at once.

    The value of a byte depends on the byte before it. A part's hash is the difference of two
    prefix sums, shifted back to the part's begin; sums are taken segment by segment.
    """

    def __init__(self, seed: int) -> None:
        pick = np.random.default_rng(seed)
        self.values = pick.integers(0, 1 << 64, 1 << 16, dtype=_U)
        self.ratio = int(pick.integers(0, 1 << 63)) * 2 + 1
        self.inverse = pow(self.ratio, -1, 1 << 64)
        self.up, self.down = (self._powers(x) for x in (self.ratio, self.inverse))

    @staticmethod
    def _powers(ratio: int) -> np.ndarray:
        out = np.ones(_SEGMENT, dtype=_U)
        size = 1
        while size < _SEGMENT:
            out[size : 2 * size] = out[:size] * _U(pow(ratio, size, 1 << 64))
            size *= 2
        return out

    def __call__(self, codes: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Hashes of the parts between the places 0 and 1, 2 and 3, ... of the sorted ``edges``."""
        sums, starts = self._sums(codes, edges), edges[0::2]
        out = sums[1::2] - sums[0::2]
        count = -(-len(codes) // _SEGMENT) + 1
        back = np.array([pow(self.inverse, k * _SEGMENT, 1 << 64) for k in range(count)], dtype=_U)
        out = mixed(out * self.down[starts % _SEGMENT] * back[starts // _SEGMENT])
        out[out == 0] = 1
        return out

    def _sums(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Sums of all values before each of the sorted places ``at``."""
        out = np.zeros(len(at), dtype=_U)
        carry = np.zeros(1, dtype=_U)
        for k in range(0, len(codes), _SEGMENT):
            part = self.values.take(codes[k : k + _SEGMENT])
            part *= self.up[: len(part)]
            np.cumsum(part, out=part)
            part *= _U(pow(self.ratio, k, 1 << 64))
            part += carry
            low, high = np.searchsorted(at, [k + 1, k + len(part) + 1])
            out[low:high] = part[at[low:high] - k - 1]
            carry = part[-1:]
        return out


class _Read:
    """The words of a block: ``starts`` and ``ends``, two hashes of each, and its place in the
    stream of words and ends of pieces."""

    def __init__(self, block: bytes) -> None:
        data = np.frombuffer(block, dtype=np.uint8)
        end = data == _END[0]
        gap = end | (data == 32)
        edges = np.nonzero(np.diff(gap, prepend=True, append=True))[0]
        self.starts, self.ends = edges[0::2], edges[1::2]
        codes = data.astype(np.intp)
        codes[1:] |= (codes * ~gap << 8)[:-1]
        self.first, self.second = (h(codes, edges) for h in _rolling())
        passed = np.concatenate([[0], np.cumsum(end.view(np.uint8), dtype=np.int32)])
        at_start, at_end = passed[self.starts], passed[self.ends]
        broken = np.append(at_start, passed[-1]) > np.concatenate([[0], at_end])
        self.places = np.arange(len(self.starts)) + np.cumsum(broken[:-1])
        self.size = len(self.starts) + int(broken.sum())

    def stream(self, values: np.ndarray) -> np.ndarray:
        """One value for each word, 0 at the ends of pieces."""
        out = np.zeros(self.size, dtype=values.dtype)
        out[self.places] = values
        return out


@lru_cache(maxsize=1)
def _rolling() -> tuple[_Rolling, _Rolling]:
    return _Rolling(11), _Rolling(12)


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(
        F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).cast("binary").alias("text")
    )


def _word_counts(texts: DataFrame) -> DataFrame:
    """``lang``, ``phrase`` (one word) and ``n``, its occurrences."""

    def run(batches):
        counts: dict[str, dict[bytes, int]] = {}

        def flush():
            for lang, of in counts.items():
                words, ns = list(of), list(of.values())
                for k in range(0, len(words), 50_000):
                    some = slice(k, k + 50_000)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.repeat(pa.scalar(lang, pa.string()), len(words[some])),
                            pa.array(words[some], pa.binary()),
                            pa.array(ns[some], pa.int64()),
                        ],
                        ["lang", "phrase", "n"],
                    )
            counts.clear()

        held = 0
        for lang, block, _ in _streams(batches):
            read = _Read(block)
            rows, _, _, ns = _grouped(read.first, read.second)
            mine = counts.setdefault(lang, {})
            for start, end, n in zip(read.starts[rows].tolist(), read.ends[rows].tolist(), ns.tolist()):
                word = block[start:end]
                known = mine.get(word)
                if known is None:
                    held += end - start + 100
                    known = 0
                mine[word] = known + n
            if held > _HELD_BYTES:
                yield from flush()
                held = 0
        yield from flush()

    return (
        texts.mapInArrow(run, "lang string, phrase binary, n long")
        .groupBy("lang", F.col("phrase").cast("string").alias("phrase"))
        .agg(F.sum("n").alias("n"))
    )


def _seed(lang: str) -> np.uint64:
    return _U(xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass"), seed=1))


class _Symbols:
    """Symbols of words, by both of their hashes; 0 for a word that is not there."""

    def __init__(self, first: np.ndarray, second: np.ndarray) -> None:
        self.first, self.second = first, second
        slots = 1 << max(10, (8 * len(first)).bit_length())
        self.mask = _U(slots - 1)
        at = (first & self.mask).astype(np.int64)
        self.slots = np.full(slots, -1, dtype=np.int32)
        self.slots[at] = np.arange(len(first))
        self.shared = np.bincount(at, minlength=slots) > 1
        self.order = np.argsort(first)

    def of(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        if not len(self.first):
            return np.zeros(len(first), dtype=np.int32)
        slot = (first & self.mask).astype(np.int64)
        found = self.slots[slot]
        some = np.nonzero(self.shared[slot])[0]
        if len(some):
            at = np.searchsorted(self.first, first[some], sorter=self.order)
            found[some] = self.order[np.minimum(at, len(self.order) - 1)]
        right = (found >= 0) & (self.first[found] == first) & (self.second[found] == second)
        return np.where(right, found + 1, 0).astype(np.int32)


def _phrase_hashes(words: np.ndarray, seed: np.uint64, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the phrases of ``size`` words at each position, and which lie in one piece.
    The words' hashes are even, so a polynomial of them is, too."""
    count = max(0, len(words) - size + 1)
    out = np.full(count, seed, dtype=_U)
    whole = np.ones(count, dtype=bool)
    for k in range(size):
        part = words[k : k + count]
        whole &= part != 0
        out *= _STEP
        out += part
    return out, whole


def _with_hash(phrases: DataFrame, size: int) -> DataFrame:
    """``phrases`` with ``h``, the hash that `_phrase_hashes` gives them."""
    phrases = phrases.withColumn("phrase", F.col("phrase").cast("binary"))
    kept = [f.name for f in phrases.schema]
    lang, phrase = kept.index("lang"), kept.index("phrase")

    def run(batches):
        for batch in batches:
            words = _Read(b" ".join(batch.column(phrase).to_pylist())).first.reshape(-1, size)
            found = np.array([_seed(x) for x in batch.column(lang).to_pylist()], dtype=_U)
            for k in range(size):
                found = found * _STEP + words[:, k]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.view(np.int64))], [*kept, "h"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in phrases.schema)
    out = phrases.mapInArrow(run, f"{schema}, h long")
    return out.withColumn("phrase", F.col("phrase").cast("string"))


def _grouped(a: np.ndarray, b: np.ndarray, n: np.ndarray | None = None):
    """(row of one, a, b, count) of the distinct pairs. Pairs of one code that are mixed with
    others may come in several parts."""
    order = np.argsort(a * _STEP + b)
    a, b = a[order], b[order]
    first = np.ones(len(a), dtype=bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    at = np.nonzero(first)[0]
    sizes = np.diff(np.append(at, len(a))) if n is None else np.add.reduceat(n[order], at) if len(at) else n
    return order[at], a[at], b[at], sizes


class _Pairs:
    """Counts of pairs of adjacent hashes, handed on when there are many."""

    def __init__(self) -> None:
        self.parts: dict[str, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        self.held = 0

    def add(self, lang: str, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(a):
            return
        self.parts.setdefault(lang, []).append(_grouped(a, b)[1:])
        self.held += len(self.parts[lang][-1][0])
        if self.held > _PAIRS:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        for lang, parts in self.parts.items():
            _, a, b, n = _grouped(*(np.concatenate(x) for x in zip(*parts)))
            for k in range(0, len(a), 1 << 16):
                some = slice(k, k + (1 << 16))
                yield _rows(lang, a[some], b[some], n[some])
        self.parts, self.held = {}, 0


def _rows(lang: str | None, a: np.ndarray, b: np.ndarray | None, n: np.ndarray) -> pa.RecordBatch:
    """Rows of a pass: pairs of hashes with a language, or ids of candidates without one."""
    langs = pa.repeat(pa.scalar(lang, pa.string()), len(a))
    second = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b.view(np.int64))
    return pa.RecordBatch.from_arrays(
        [langs, pa.array(a.view(np.int64)), second, pa.array(n, pa.int64())], ["lang", "a", "b", "n"]
    )


class Trie:
    """A double-array trie over (language, word, word, ...).

    ``base[s] + symbol`` is the place of the state that follows ``s``, and ``check`` there holds
    ``s``. Nodes with many children are placed first, where all their children find free places.
    Symbol 0 stands for what is in no phrase. ``ids[s]`` is the row of the phrase that ends at
    ``s``, -1 at the others.
    """

    def __init__(self, phrases: list[tuple[str, bytes]]) -> None:
        paths = [(lang.encode("utf-8", "surrogatepass"), *phrase.split(b" ")) for lang, phrase in phrases]
        langs = sorted({p[0] for p in paths})
        words = sorted({w for p in paths for w in p[1:]})
        self.langs = {x.decode("utf-8", "surrogatepass"): k for k, x in enumerate(langs, 1)}
        read = _Read(b" ".join(words))
        self.symbols = _Symbols(read.first, read.second)
        of_word = {x: k for k, x in enumerate(words, 1)}
        symbols = 1 + max(len(langs), len(words))
        of_lang = {x: k for k, x in enumerate(langs, 1)}
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for row, path in enumerate(paths):
            at = 0
            for k, x in enumerate(path):
                symbol = of_word[x] if k else of_lang[x]
                into = children[at].get(symbol)
                if into is None:
                    into = children[at][symbol] = len(children)
                    children.append({})
                    ends.append(-1)
                at = into
            ends[at] = row
        self._place(children, symbols)
        self.ids = np.full(len(self.base), -1, dtype=np.int32)
        self.ids[self.places] = ends
        self.starts = {x: int(self.base[0] + k) for x, k in self.langs.items()}
        del self.places

    def _place(self, children: list[dict[int, int]], symbols: int) -> None:
        size = 2 * len(children) + 2 * symbols + 64
        free = np.ones(size, dtype=bool)
        free[:symbols] = False  # so that no base is negative
        place = np.zeros(len(children), dtype=np.int64)
        base = np.zeros(len(children), dtype=np.int64)
        many = sorted((k for k, of in enumerate(children) if len(of) > 1), key=lambda k: -len(children[k]))
        first = symbols
        for k in many:
            steps = np.sort(np.fromiter(children[k], dtype=np.int64, count=len(children[k])))
            reach = steps - steps[0]
            at, width = first, 512
            while True:
                if at + width + reach[-1] >= len(free):
                    free = np.concatenate([free, np.ones(len(free) + width + int(reach[-1]), dtype=bool)])
                spots = at + np.nonzero(free[at : at + width])[0]
                good = spots
                for step in reach[1:]:
                    good = good[free[good + step]]
                    if not len(good):
                        break
                if len(good):
                    break
                at += width
                width = min(2 * width, 1 << 16)
            base[k] = good[0] - steps[0]
            taken = base[k] + steps
            free[taken] = False
            for symbol, into in children[k].items():
                place[into] = base[k] + symbol
            if at > first + 4096 and free[first : first + 4096].mean() < 0.05:
                first += 4096
        single = [k for k, of in enumerate(children) if len(of) == 1]
        spots = np.nonzero(free)[0]
        if len(spots) < len(single):
            spots = np.concatenate([spots, np.arange(len(free), len(free) + len(single))])
        for k, spot in zip(single, spots.tolist()):
            ((symbol, into),) = children[k].items()
            base[k] = spot - symbol
            place[into] = spot
        end = int(place.max(initial=symbols)) + symbols + 2
        self.places = place
        self.base = np.zeros(end, dtype=np.int32)
        self.base[place] = base
        self.check = np.full(end, -1, dtype=np.int32)
        for k, of in enumerate(children):
            for into in of.values():
                self.check[place[into]] = place[k]

    def accepted(self, lang: str, symbols: np.ndarray, size: int) -> np.ndarray:
        """Rows of the phrases of ``size`` words that begin at any position, repeated as often
        as they occur. All positions take one step at a time; those without a way on drop out."""
        start = self.starts.get(lang)
        if start is None:
            return np.zeros(0, dtype=np.int32)
        at = np.nonzero(symbols[: max(0, len(symbols) - size + 1)])[0]
        states = np.full(len(at), start, dtype=np.int32)
        for k in range(size):
            to = self.base[states] + symbols[at + k]
            on = self.check[to] == states
            at, states = at[on], to[on]
        found = self.ids[states]
        return found[found >= 0]


def _next_pairs(pairs: _Pairs, filter_words: np.ndarray, lang: str, words: np.ndarray, size: int):
    """Count pairs of adjacent phrases of ``size`` words that both pass the filter."""
    h, whole = _phrase_hashes(words, _seed(lang), size)
    live = np.nonzero(whole[:-1] & whole[1:])[0]
    live = live[passes(filter_words, h[live].view(np.int64))]
    live = live[passes(filter_words, h[live + 1].view(np.int64))]
    return pairs.add(lang, h[live], h[live + 1])


def _pass(texts: DataFrame, size: int, least: int, trie=None, ids=None, filter_words=None) -> DataFrame:
    """One pass over the texts: counts ``n`` of the ``trie``'s phrases of ``size`` words by
    ``ids`` (in ``a``, without ``lang``), and counts of at least ``least`` of adjacent phrases of
    ``size`` words that pass the filter. Trie, ids and filter are broadcast and of bounded size."""

    def run(batches):
        wanted = filter_words.value if filter_words is not None else None
        tree = trie.value if trie is not None else None
        pairs = _Pairs()
        counts = np.zeros(len(ids.value) if tree is not None else 0, dtype=np.int64)
        symbol_tail, hash_tail = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=_U)
        for lang, block, on in _streams(batches):
            read = _Read(block)
            if tree is not None:
                symbols = read.stream(tree.symbols.of(read.first, read.second))
                if on:
                    symbols = np.concatenate([symbol_tail, symbols])
                symbol_tail = symbols[max(0, len(symbols) - size + 1) :]
                counts += np.bincount(tree.accepted(lang, symbols, size), minlength=len(counts))
            if wanted is not None:
                hashes = read.stream(read.first)
                if on:
                    hashes = np.concatenate([hash_tail, hashes])
                hash_tail = hashes[-size:]
                yield from _next_pairs(pairs, wanted, lang, hashes, size)
        yield from pairs.flush()
        some = np.nonzero(counts)[0]
        for k in range(0, len(some), 1 << 16):
            at = some[k : k + (1 << 16)]
            yield _rows(None, ids.value[at], None, counts[at])

    rows = texts.mapInArrow(run, "lang string, a long, b long, n long")
    sums = rows.groupBy("lang", "a", "b").agg(F.sum("n").alias("n"))
    return sums.where(F.col("lang").isNull() | (F.col("n") >= least))


def _filter_of(phrases: DataFrame):
    """Membership filter of the hashes of phrases: fixed size, no phrase is missed."""
    return phrases.sparkSession.sparkContext.broadcast(membership_filter(phrases, "h"))


def _candidates(bounds: DataFrame, shorter: DataFrame, size: int) -> DataFrame:
    """Phrases of ``size`` words that have a bound and whose parts are frequent."""
    first = shorter.select("lang", F.col("h").alias("a"), F.col("phrase").alias("first"))
    rest = shorter.select("lang", F.col("h").alias("b"), F.col("phrase").alias("rest"))
    found = bounds.select("lang", "a", "b").join(first, ["lang", "a"]).join(rest, ["lang", "b"])
    last = F.element_at(F.split("rest", " "), -1)
    if size > 2:  # equal hashes of different phrases go here
        overlap = F.substring_index("rest", " ", size - 2)
        found = found.where(F.endswith("first", F.concat(F.lit(" "), overlap)))
    return found.select("lang", F.concat_ws(" ", "first", last).alias("phrase")).distinct()


def _shards(candidates: DataFrame, size: int, states: int) -> tuple[DataFrame, int]:
    """The candidates with an ``id`` and a ``shard``, in shards of about ``states`` states."""
    rows = staged(candidates.withColumn("id", F.monotonically_increasing_id()), "collocation-candidates")
    count, held = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("phrase"))).first()
    number = max(1, -(-count * size // states), -(-(held or 0) // (16 * states)))
    return rows.withColumn("shard", F.pmod(F.xxhash64("lang", "phrase"), F.lit(number))), (number if count else 0)


def _counted(texts: DataFrame, candidates: DataFrame, size: int, most: int, least: int, states: int):
    """Exact counts ``n`` of the candidates, and the bounds for the next level (None after the
    last). Each shard has its own pass; only the first gathers the bounds."""
    context = texts.sparkSession.sparkContext
    with_shard, number = _shards(candidates, size, states)
    if not number:
        return with_shard.select("lang", "phrase", F.lit(0).cast("long").alias("n")), None
    wanted = None
    if size < most:
        wanted = _filter_of(_with_hash(with_shard.select("lang", "phrase"), size))
    passes_, sent = [], [wanted] if wanted is not None else []
    for shard in range(number):
        found = with_shard.where(F.col("shard") == shard).select(
            "lang", F.col("phrase").cast("binary").alias("phrase"), "id"
        ).toArrow()  # bounded by ``states``
        trie = Trie(list(zip(found["lang"].to_pylist(), found["phrase"].to_pylist())))
        ids = found["id"].to_numpy()
        sent += [context.broadcast(trie), context.broadcast(ids)]
        passes_.append(_pass(texts, size, least, *sent[-2:], None if shard else wanted))
    out = staged(reduce(DataFrame.unionByName, passes_), "collocation-pass")
    for each in sent:
        each.destroy()
    sums = out.where("lang IS NULL").select(F.col("a").alias("id"), "n")
    return with_shard.join(sums, "id").select("lang", "phrase", "n"), out.where("lang IS NOT NULL")


def frequent_phrases(
    docs: DataFrame,
    least: int = 100,
    most_words: int = 5,
    text_col: str = "text",
    lang_col: str = "lang",
    states: int = 1 << 20,
) -> tuple[DataFrame, DataFrame]:
    """(phrases, totals): ``lang``, ``phrase``, ``words`` and ``n`` of all phrases of 1 to
    ``most_words`` words that occur at least ``least`` times, and all words' ``total`` by lang."""
    spark = docs.sparkSession
    ship_package(spark)
    texts = _texts(docs, text_col, lang_col)
    words = staged(_word_counts(texts), "collocation-words")
    totals = staged(words.groupBy("lang").agg(F.sum("n").alias("total")), "collocation-totals")
    kept = staged(
        _with_hash(words.where(F.col("n") >= least), 1).withColumn("words", F.lit(1)), "collocation-1"
    )
    drop_staged(words)
    levels = [kept]
    wanted = _filter_of(kept)
    bounds = staged(_pass(texts, 1, least, filter_words=wanted), "collocation-bounds")
    wanted.destroy()
    for size in range(2, most_words + 1):
        candidates = _candidates(bounds, levels[-1], size)
        counts, following = _counted(texts, candidates, size, most_words, least, states)
        found = _with_hash(counts.where(F.col("n") >= least), size).withColumn("words", F.lit(size))
        levels.append(staged(found, f"collocation-{size}"))
        drop_staged(bounds)
        if following is None:
            break
        bounds = following
    return reduce(DataFrame.unionByName, (x.select("lang", "phrase", "words", "n") for x in levels)), totals


def _part(first: int | Column, count: Column) -> Column:
    return F.array_join(F.slice("_words", first, count), " ")


def collocations(
    docs: DataFrame,
    least: int = 100,
    most_words: int = 5,
    top: int | None = 2000,
    text_col: str = "text",
    lang_col: str = "lang",
    states: int = 1 << 20,
) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n`` and ``score`` of each language's
    best phrases of 2 to ``most_words`` words.

    A text is lowered in A-Z and split at ``.,;:!?`` and line ends into pieces, these at spaces
    and tabs into words. ``a`` counts the phrase within pieces, overlaps included, ``n`` all
    words of the language; a cut into two parts that occur ``l`` and ``r`` times scores
    floor(1000 a n / (l r)), and the cut that scores least counts, of equal ones the first.
    Phrases with ``a`` below ``least`` are left out, as are those that occur only inside a longer
    one. ``top`` of each language are returned by score, ``a`` and phrase, all if None.

    A null text is empty, a null language ``und``; repeated rows count each time; other columns
    are not read; an empty table gives no rows. Texts and words of any length are read whole, a
    long text in blocks. ``states``: the states of a trie that is sent to the executors; with
    more candidates, further passes over the texts follow. Products are exact to 38 digits.
    """
    phrases, totals = frequent_phrases(docs, least, most_words, text_col, lang_col, states)
    phrases = staged(phrases, "collocation-phrases")
    longer = phrases.where("words > 1").withColumn("_words", F.split("phrase", " "))
    cuts = longer.select(
        "lang", "phrase", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"), "words", "_words"
    ).select(
        "lang", "phrase", "a", "k",
        _part(1, F.col("k")).alias("_l"), _part(F.col("k") + 1, F.col("words") - F.col("k")).alias("_r"),
    )
    known = phrases.select("lang", "phrase", "n")
    wide = "decimal(38,0)"
    scored = (
        cuts.join(known.select("lang", F.col("phrase").alias("_l"), F.col("n").alias("l")), ["lang", "_l"])
        .join(known.select("lang", F.col("phrase").alias("_r"), F.col("n").alias("r")), ["lang", "_r"])
        .join(totals.select("lang", F.col("total").alias("n")), "lang")
        .withColumn(
            "score",
            F.expr(
                f"(cast(1000 * cast(a as {wide}) as {wide}) * cast(n as {wide}))"
                f" div (cast(l as {wide}) * cast(r as {wide}))"
            ),
        )
    )
    weakest = (
        scored.groupBy("lang", "phrase", "a", "n")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
        .select("lang", "phrase", "a", "n", "cut.score", "cut.l", "cut.r")
    )
    # A longer phrase as frequent as a part of it: so is every phrase between the two.
    inside = (
        longer.where("words > 2")
        .select(
            "lang", "n", F.explode(F.array(_part(1, F.col("words") - 1), _part(2, F.col("words") - 1))).alias("phrase")
        )
        .groupBy("lang", "phrase")
        .agg(F.max("n").alias("a"))
    )
    out = weakest.join(inside, ["lang", "phrase", "a"], "left_anti")
    best = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    if top is not None:  # the best of each slice of a language first: no task ranks a whole language
        out = out.withColumn("slice", salt_of("phrase", RANK_SLICES))
        place = F.row_number().over(Window.partitionBy("lang", "slice").orderBy(*best))
        out = out.withColumn("place", place).where(F.col("place") <= top)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*best))
    ranked = out.withColumn("rank", place.cast("long"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocation_query(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang"))


_UPPER, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SQL = f"""WITH pieces AS (SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(p) AS piece, unnest(range(len(p))) AS k
  FROM (SELECT doc_id, lang, string_split(translate(translate(coalesce(text, ''), '{_UPPER}', '{_LOW}'),
    ',;:!?' || chr(10) || chr(11) || chr(12) || chr(13), '.........'), '.') AS p FROM documents)),
word_lists AS (SELECT lang, [x FOR x IN string_split(replace(piece, chr(9), ' '), ' ') IF x <> ''] AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM word_lists GROUP BY lang),
counts AS (SELECT lang, m AS words, array_to_string(w[s:s + m - 1], ' ') AS phrase, count(*) AS a
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM word_lists, (SELECT unnest([1, 2, 3, 4, 5]) AS m) WHERE len(w) >= m)
  GROUP BY ALL HAVING count(*) >= 100),
cuts AS (SELECT lang, words, phrase, a, unnest(range(1, words)) AS k, string_split(phrase, ' ') AS w FROM counts WHERE words > 1),
scored AS (SELECT c.lang, c.words, c.phrase, c.a, c.k, l.a AS l, r.a AS r, t.n,
    CAST((1000::HUGEINT * c.a * t.n) // (l.a::HUGEINT * r.a) AS BIGINT) AS score
  FROM cuts c JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:c.k], ' ')
  JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.k + 1:], ' ') JOIN totals t ON t.lang = c.lang),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (SELECT * FROM weakest s WHERE NOT EXISTS (SELECT 1 FROM counts b WHERE b.lang = s.lang AND b.words > s.words
  AND 100 * b.a >= 100 * s.a AND contains(' ' || b.phrase || ' ', ' ' || s.phrase || ' '))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000"""
