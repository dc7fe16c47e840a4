"""BPE encoding and decoding with a tokenization automaton.

The automaton runs over tokens: a state for "this token was read last", an arc for each token
that may follow. It accepts exactly the token sequences that the merges make of some text. It
is built merge by merge. The gadget of the merge (a, b) -> c, at time t,

* adds the state c, whose arcs are those that state b has at time t,
* adds an arc c to every state that has an arc a and can then go on to b,
* takes the arc b from state a: there the pair would have been merged.

The arcs are not written out, which would take tokens x tokens entries. A state knows from
which state it was copied and when (the right half of its token), an arc label from which label
it was made and when (the left half), and the removals are a table of pairs with their time.
Whether an arc exists follows from these tables; the answers are kept as they are met.

A word is read symbol by symbol. For each prefix exactly one token can come last: the one that
spells its end and has an arc from the state of the prefix before it. The states are thus
stepped through by table look-ups, without ever searching the merges.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from valora.llm.common import ship_package
from valora.llm.part_cache import PartCache, flat, grouped

_NEVER = 1 << 60
#: Answers about arcs and words that a worker keeps before it starts afresh, and the longest word
#: that is kept; with the parts (`part_cache`) below 250 MB, whatever the text.
ARCS, WORDS, KEPT_WORD = 300_000, 200_000, 64


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    table = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


class TokenAutomaton:
    """States, arcs and removals, compiled from an ordered list of merges."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str) -> None:
        self.suffix = suffix
        self.labels = {i: token for token, i in vocab.items()}
        size = max(self.labels) + 1
        self.copied = [-1] * size  # the state that a state was copied from
        self.made = [-1] * size  # the label that a label was made from
        self.born = [-1] * size
        self.removed: dict[tuple[int, int], int] = {}
        self.arcs: dict[int, bool] = {}
        self.spelled = {t: i for t, i in vocab.items() if len(t.removesuffix(suffix)) == 1}
        for time, (a, b) in enumerate(merges):
            self._gadget(time, vocab[a], vocab[b], vocab[a + b])
        self.longest = max(len(t) for t in self.spelled)
        self.words: dict[str, list[int]] = {}

    def _gadget(self, time: int, a: int, b: int, c: int) -> None:
        reachable = self.labels[a] in self.spelled and self.labels[b] in self.spelled
        if reachable and self._open(a, b, time):
            self.copied[c], self.made[c], self.born[c] = b, a, time
            self.spelled[self.labels[c]] = c
        self.removed.setdefault((a, b), time)

    def _open(self, state: int, label: int, until: int) -> bool:
        """Whether the arc exists at the time ``until``, by the removals before it."""
        removed, made, copied, born = self.removed, self.made, self.copied, self.born
        limit = until - 1  # the last removal that counts for the label
        while label >= 0:
            at, before = state, until
            while at >= 0:
                time = removed.get((at, label))
                if time is not None and time <= limit and time < before:
                    return False
                before = born[at]
                at = copied[at]
            limit = born[label]
            label = made[label]
        return True

    def follows(self, state: int, label: int) -> bool:
        key = state << 24 | label
        known = self.arcs.get(key)
        if known is None:
            if len(self.arcs) > ARCS:
                self.arcs.clear()
            known = self.arcs[key] = self._open(state, label, _NEVER)
        return known

    def encode_word(self, word: str) -> list[int]:
        """Token ids of one word, given as one symbol per byte."""
        known = self.words.get(word)
        if known is not None:
            return known
        spelled, longest, n = self.spelled, self.longest, len(word)
        arcs = self.arcs
        states = [-1] * (n + 1)
        for end in range(1, n + 1):
            for start in range(end - 1, max(-1, end - longest - 1), -1):  # most tokens are short
                piece = word[start:end] if end < n else word[start:] + self.suffix
                token = spelled.get(piece)
                if token is None:
                    continue
                if start:
                    known = arcs.get(states[start] << 24 | token)
                    if not (self.follows(states[start], token) if known is None else known):
                        continue
                states[end] = token
                break
            else:
                raise ValueError(f"no token spells the end of {word[:end][-40:]!r}")
        out = []
        end, strip = n, len(self.suffix)
        while end:
            out.append(states[end])
            end -= len(self.labels[states[end]]) - strip
            strip = 0
        out.reverse()
        if n <= KEPT_WORD:
            if len(self.words) > WORDS:
                self.words.clear()
            self.words[word] = out
        return out


class WordBpe:
    """A word-level BPE of the tokenizers format: clean, split into words, encode each.

    Understands what the public word vocabulary uses: NFC, white space as separator, lower
    case by character, a splitting pattern, byte symbols, a word-end suffix, and special
    tokens that are found in the raw text.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        # White_Space in place of \s, which also takes four control characters here
        self.pattern = regex.compile(split.replace(r"\s", r"\p{White_Space}"))
        self.automaton = TokenAutomaton(
            model["vocab"], [tuple(m) for m in model["merges"]], model["end_of_word_suffix"]
        )
        self.library = Tokenizer.from_file(path)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.around = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.spaces = regex.compile(r"\p{White_Space}+")
        self.symbols = byte_symbols()
        self.cache = PartCache(self._encode_parts)

    def _words(self, part: str) -> list[str]:
        """The words of a part, one symbol per byte.

        Which of the newer characters are letters differs between Unicode versions, so parts
        with any beyond the Latin blocks are cleaned and split by the library itself.
        """
        if part.isascii() and part.isprintable():  # then each symbol is the character itself
            part = part.lower()
            return [part] if part.isalpha() else self.pattern.findall(part)
        if not part.isascii():
            if max(part) > "\u024f":
                clean = self.library.normalizer.normalize_str(part)
                return [word for word, _ in self.library.pre_tokenizer.pre_tokenize_str(clean)]
            part = unicodedata.normalize("NFC", part)
        words = self.pattern.findall("".join(c.lower() for c in part))
        return ["".join(self.symbols[b] for b in word.encode()) for word in words]

    def _encode_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for part in parts:
            if part in self.special:
                out.append([self.special[part]])
                continue
            out.append([i for word in self._words(part) for i in self.automaton.encode_word(word)])
        return flat(out)

    def _parts(self, text: str) -> list[str]:
        pieces = self.around.split(text) if "<|" in text else [text]
        odd = any(c in text for c in "\x1c\x1d\x1e\x1f")
        parts: list[str] = []
        for piece in pieces:
            if piece in self.special:
                parts.append(piece)
            elif odd:
                parts += [x for x in self.spaces.split(piece) if x]
            else:
                parts += piece.split()
        return parts

    def encode(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        for group in grouped(texts):
            yield from self.cache.encode([self._parts(text) for text in group])


class ArcLabels:
    """Decoding: the labels of the arcs that a token sequence passes, apart by spaces."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        labels = {i: token for token, i in spec["model"]["vocab"].items()}
        labels |= {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.labels = [labels.get(i, "") for i in range(max(labels) + 1)]

    def emit(self, ids: np.ndarray) -> str:
        return " ".join(map(self.labels.__getitem__, ids.tolist()))


_LOADED: dict[str, WordBpe] = {}


def _loaded(path: str) -> WordBpe:
    """One automaton per worker process; it is compiled in about a second."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def encode(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit) of each whole text.

    The ids are those of the tokenizers library with the same file and no special tokens
    added. Null and empty texts have no ids. Repeated rows are encoded alike, a null id stays
    null, other columns are not read, an empty table gives no rows.
    """
    ship_package(docs.sparkSession)

    def run(batches):
        bpe = _loaded(vocabulary)
        for batch in batches:
            ids_of, rows, held = batch.column(0), [], 0
            texts = (text.as_py() or "" for text in batch.column(1))
            for k, ids in enumerate(bpe.encode(texts)):
                rows.append((ids_of[k].as_py(), len(ids), ids.tobytes()))
                held += len(ids)
                if held > 1 << 20:
                    yield _rows(rows)
                    rows, held = [], 0
            if rows:
                yield _rows(rows)

    def _rows(rows):
        ids_of, sizes, ids = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids_of, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())],
            ["doc_id", "n_tokens", "ids"],
        )

    picked = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    )
    return picked.mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """Add ``decoded``: what the library's decode gives, special tokens included.

    The vocabulary names no decoder, so token labels stand apart by one space and keep their
    word ends. Null ids decode to the empty text. All columns are kept; a column already named
    ``decoded`` is replaced.
    """
    ship_package(encoded.sparkSession)
    encoded = encoded.drop("decoded")
    place = encoded.columns.index("ids")

    def run(batches):
        arcs = ArcLabels(vocabulary)
        for batch in batches:
            for part in (batch.slice(k, 256) for k in range(0, batch.num_rows, 256)):
                texts = [
                    arcs.emit(np.frombuffer(x.as_py() or b"", dtype="<u4"))
                    for x in part.column(place)
                ]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(texts, pa.string())], [*part.schema.names, "decoded"]
                )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{schema}, decoded string")


def tokenizer_file(name: str) -> str:
    """The place of a public vocabulary file; it is installed on every worker."""
    import public_tokenizers

    return public_tokenizers.path(name)


def bpe_query(spark, sf_dir: str) -> DataFrame:
    path = tokenizer_file("word_bpe_49k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return decode(encode(docs, path), path).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
