"""Language ID: a small convolutional network over bytes, trained in numpy.

Texts become fixed-length windows of bytes. Filters of several widths slide over a window, the
maximum of each filter goes into a softmax over the languages of the training rows. A text has
the mean of the probabilities of all its windows, weighted by their letters.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from valora.llm.common import in_parts, ship_package

WINDOW = 256
#: Ids are counted in 2^16 ranges of their hash before the smallest are ranked.
RANGE_BITS = 16
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")
#: ASCII bytes other than letters become spaces.
_PLAIN = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def plain_bytes(text: str | None) -> bytes:
    """Lower-cased letters in UTF-8, words apart by one space; empty if there is no letter."""
    if not text or not _LETTER.search(text):
        return b""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_PLAIN).split())


def windows_of(data: bytes, size: int = WINDOW) -> np.ndarray:
    """All windows of ``data``, the last one filled up with spaces."""
    full = data + b" " * (-len(data) % size)
    return np.frombuffer(full, dtype=np.uint8).reshape(-1, size)


@dataclass
class ByteNet:
    """Embedding (256, d), one filter bank (width, d, f) and bias (f) per width, softmax."""

    languages: list[str]
    embedding: np.ndarray
    banks: list[np.ndarray]
    biases: list[np.ndarray]
    weight: np.ndarray
    bias: np.ndarray

    def tables(self) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The banks as lookups: one row per pair of bytes, and one per byte for odd widths."""
        pairs, singles = [], []
        for bank in self.banks:
            at = [self.embedding @ bank[j] for j in range(len(bank))]
            for j in range(0, len(bank) - 1, 2):
                pairs.append((at[j][:, None] + at[j + 1][None]).reshape(65536, -1))
            if len(bank) % 2:
                singles.append(at[-1])
        return [p.astype(np.float32) for p in pairs], [s.astype(np.float32) for s in singles]

    def scorer(self, chunk: int = 64):
        """A function from windows (n, size) to probabilities (n, languages)."""
        pairs, singles = self.tables()

        def score(windows: np.ndarray) -> np.ndarray:
            out = np.empty((len(windows), len(self.languages)))
            for k in range(0, len(windows), chunk):
                x = windows[k : k + chunk].astype(np.int32)
                two = (x[:, :-1] << 8) | x[:, 1:]
                pair, single = iter(pairs), iter(singles)
                tops = []
                for bank, bias in zip(self.banks, self.biases):
                    width = len(bank)
                    n = x.shape[1] - width + 1
                    total = None
                    for j in range(0, width - 1, 2):
                        part = np.take(next(pair), two[:, j : j + n], axis=0)
                        total = part if total is None else np.add(total, part, out=total)
                    if width % 2:
                        part = np.take(next(single), x[:, width - 1 : width - 1 + n], axis=0)
                        total = part if total is None else np.add(total, part, out=total)
                    tops.append(np.maximum(total.max(axis=1) + bias, 0))
                out[k : k + chunk] = _softmax(np.concatenate(tops, axis=1) @ self.weight + self.bias)
            return out

        return score


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(
    windows: np.ndarray,
    labels: np.ndarray,
    languages: list[str],
    widths: tuple[int, ...] = (2, 3, 4),
    filters: int = 16,
    depth: int = 8,
    epochs: int = 4,
    batch: int = 64,
    rate: float = 0.01,
    seed: int = 0,
) -> ByteNet:
    """Fit the network with Adam on windows (n, size) of known language numbers."""
    rng = np.random.default_rng(seed)
    params = [
        rng.normal(0, 0.5, (256, depth)),
        *[rng.normal(0, (w * depth) ** -0.5, (w, depth, filters)) for w in widths],
        *[np.zeros(filters) for _ in widths],
        rng.normal(0, 0.1, (filters * len(widths), len(languages))),
        np.zeros(len(languages)),
    ]
    params = [p.astype(np.float32) for p in params]
    first = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]
    k = len(widths)
    step = 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(windows)), max(1, len(windows) // batch)):
            x, y, n = windows[rows], labels[rows], len(rows)
            emb = params[0][x]
            picked, tops = [], []
            for w, bank, bias in zip(widths, params[1 : 1 + k], params[1 + k : 1 + 2 * k]):
                span = x.shape[1] - w + 1
                act = sum(emb[:, j : j + span] @ bank[j] for j in range(w))
                best = act.argmax(axis=1)
                picked.append(best)
                tops.append(np.take_along_axis(act, best[:, None], 1)[:, 0] + bias)
            raw = np.concatenate(tops, axis=1)
            hidden = np.maximum(raw, 0)
            delta = _softmax(hidden @ params[-2] + params[-1])
            delta[np.arange(n), y] -= 1
            delta /= n
            grads = [np.zeros_like(p) for p in params]
            grads[-2], grads[-1] = hidden.T @ delta, delta.sum(axis=0)
            back = (delta @ params[-2].T) * (raw > 0)
            for i, w in enumerate(widths):
                g = back[:, i * filters : (i + 1) * filters]
                grads[1 + k + i] = g.sum(axis=0)
                for j in range(w):
                    byte = np.take_along_axis(x, picked[i] + j, axis=1)
                    grads[1 + i][j] = np.einsum("nfd,nf->df", params[0][byte], g)
                    np.add.at(grads[0], byte, g[:, :, None] * params[1 + i][j].T[None])
            step += 1
            for p, g, a, b in zip(params, grads, first, second):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return ByteNet(
        languages, params[0], params[1 : 1 + k], params[1 + k : 1 + 2 * k], params[-2], params[-1]
    )


def fit(
    labelled: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    rows_per_language: int = 400,
    windows_per_row: int = 6,
) -> ByteNet | None:
    """Train on a bounded sample: the ids of smallest hash in each language, and evenly spaced
    windows of the text of each. The bounds are the two parameters; the number of languages
    must be small. Rows without language, id or letters are left out. Rows of one id and
    language count once, with the least of their windows, however many they are. None if
    nothing is left.

    The ids are counted by ranges of their hash first, so that only those of the lowest ranges
    are ranked, wherever the rows of a language lie.
    """
    ship_package(labelled.sparkSession)
    base = labelled.select(
        F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")
    ).where("lang IS NOT NULL AND doc_id IS NOT NULL")
    hashed = F.xxhash64("doc_id")
    ids = base.select("lang", "doc_id", hashed.alias("h")).distinct()
    ranges = ids.groupBy("lang", F.shiftright("h", 64 - RANGE_BITS).alias("range")).agg(
        F.count(F.lit(1)).alias("n")
    )
    lower = Window.partitionBy("lang").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    needed = (
        ranges.withColumn("before", F.coalesce(F.sum("n").over(lower), F.lit(0)))
        .where(F.col("before") < rows_per_language)
        .select("lang", "range")
    )
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    picks = (
        ids.withColumn("range", F.shiftright("h", 64 - RANGE_BITS))
        .join(needed, ["lang", "range"], "left_semi")
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= rows_per_language)
        .select("doc_id", "lang")
    )

    def cut(batches):
        least: dict[tuple, bytes] = {}  # of the picked ids only
        for batch in batches:
            for doc_id, lang, text in zip(
                batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            ):
                data = plain_bytes(text.as_py())
                if data:
                    all_of = windows_of(data)
                    some = np.linspace(0, len(all_of) - 1, min(len(all_of), windows_per_row))
                    cut_out = all_of[some.astype(int)].tobytes()
                    least[doc_id, lang] = min(cut_out, least.get((doc_id, lang), cut_out))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([str(d) for d, _ in least], pa.string()),
                pa.array([g for _, g in least], pa.string()),
                pa.array(least.values(), pa.binary()),
            ],
            ["doc_id", "lang", "windows"],
        )

    # at most rows_per_language ids per language: the join sends ids, not texts
    picked = base.join(F.broadcast(picks), ["doc_id", "lang"]).select("doc_id", "lang", "text")
    found = (
        picked.mapInArrow(cut, "doc_id string, lang string, windows binary")
        .groupBy("doc_id", "lang")
        .agg(F.min("windows").alias("windows"))
        .toArrow()
        .to_pydict()
    )
    if not found["lang"]:
        return None
    rows = sorted(  # tasks end in any order
        (lang, windows[at : at + WINDOW])
        for lang, windows in zip(found["lang"], found["windows"])
        for at in range(0, len(windows), WINDOW)
    )
    languages = sorted({lang for lang, _ in rows})
    number = {lang: i for i, lang in enumerate(languages)}
    x = np.frombuffer(b"".join(w for _, w in rows), dtype=np.uint8).reshape(len(rows), -1)
    return train(x, np.array([number[lang] for lang, _ in rows]), languages)


def identify(docs: DataFrame, net: ByteNet | None, text_col: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` (0 to 1) to every row; all windows of the text count.

    ``und`` with score 0 for a text that is null, empty or without letters, and for all texts
    if there was nothing to train on. Only the text is read for the prediction; all columns
    are kept, and a column already named ``lang_pred`` or ``score`` is replaced. Repeated rows
    are predicted alike; an empty table gives no rows. Texts are scored in groups of bounded
    size, a very long one by itself.
    """
    ship_package(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    place = docs.columns.index(text_col)

    def run(batches):
        score = net.scorer() if net else None

        def flush(group):
            sizes = [len(w) for w in group if w is not None]
            out = [(UNDETERMINED, 0.0)] * len(group)
            if not sizes or score is None:
                return out
            stacked = np.concatenate([w for w in group if w is not None])
            weights = (stacked != 32).sum(axis=1) + 1e-9
            starts = np.cumsum([0, *sizes[:-1]])
            total = np.add.reduceat(score(stacked) * weights[:, None], starts, axis=0)
            mean = total / np.add.reduceat(weights, starts)[:, None]
            best = mean.argmax(axis=1)
            k = 0
            for i, w in enumerate(group):
                if w is not None:
                    out[i] = (net.languages[best[k]], float(min(1.0, mean[k, best[k]])))
                    k += 1
            return out

        for batch in in_parts(batches, place):
            found, group, held = [], [], 0
            for text in batch.column(place):
                data = plain_bytes(text.as_py())
                group.append(windows_of(data) if data else None)
                held += len(data)
                if held > 1 << 22:
                    found += flush(group)
                    group, held = [], 0
            found += flush(group)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array([p for p, _ in found], pa.string()),
                    pa.array([s for _, s in found], pa.float64()),
                ],
                [*batch.schema.names, "lang_pred", "score"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, lang_pred string, score double")


def held_out(id_col: str = "doc_id"):
    """The fold that is never learned from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def language_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = fit(docs.where(~held_out()))
    return identify(docs.select("doc_id", "text"), net).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score"
    )
