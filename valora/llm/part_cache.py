"""Token ids of the parts that texts are made of, kept by each worker."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import chain, repeat
from sys import getsizeof

import numpy as np

#: Bytes of parts and their ids that a worker keeps before it starts afresh.
KEPT_BYTES = 120 << 20
#: Longer parts (texts without spaces, encoded data) are encoded and not kept.
KEPT_PART = 64


#: From parts to their ids in a row, and how many ids each part has.
Encoder = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


def flat(found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    total = int(sizes.sum())
    return np.fromiter(chain.from_iterable(found), dtype="<u4", count=total), sizes


class PartCache:
    """Encodes lists of parts; each distinct part is encoded once while it is kept. What is kept
    is bounded in bytes, whatever the parts."""

    def __init__(self, encode_parts: Encoder, most: int = KEPT_BYTES) -> None:
        self.encode_parts = encode_parts
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.where: dict[str, int] = {}
        self.starts = np.zeros(1024, dtype=np.int64)
        self.sizes = np.zeros(1024, dtype=np.int64)
        self.ids = np.zeros(4096, dtype="<u4")
        self.used = 0
        self.held = 0

    def _room(self, name: str, size: int) -> None:
        array = getattr(self, name)
        if size > len(array):
            grown = np.zeros(max(size, 2 * len(array)), dtype=array.dtype)
            grown[: len(array)] = array
            setattr(self, name, grown)

    def _learn(self, parts: list[str]) -> None:
        for k in range(0, len(parts), 8192):
            some = parts[k : k + 8192]
            ids, sizes = self.encode_parts(some)
            at, end = len(self.where), len(self.where) + len(some)
            self._room("starts", end)
            self._room("sizes", end)
            self._room("ids", self.used + len(ids))
            self.ids[self.used : self.used + len(ids)] = ids
            self.sizes[at:end] = sizes
            self.starts[at:end] = self.used + np.cumsum(sizes) - sizes
            self.where.update(zip(some, range(at, end)))
            self.used += len(ids)

    def _forget(self, parts: list[str], used: int) -> None:
        """Take back the parts that were learned last, when ``used`` ids were held before."""
        for part in parts:
            del self.where[part]
        self.used = used
        if self.ids.nbytes > self.most:
            self.ids = self.ids[: max(4096, used)].copy()

    def encode(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The ids of each text, given as its parts; new parts of all are encoded together."""
        parts = list(chain.from_iterable(texts))
        passing: list[str] = []
        used = 0
        if not parts:
            return [np.zeros(0, dtype="<u4") for _ in texts]
        if self.held > self.most:
            self.clear()
        at = np.fromiter(map(self.where.get, parts, repeat(-1)), dtype=np.int64, count=len(parts))
        new = np.nonzero(at < 0)[0]
        if len(new):
            unknown = [parts[k] for k in new]
            distinct = sorted(set(unknown))
            short = [x for x in distinct if len(x) <= KEPT_PART]
            before = self.used
            self._learn(short)
            self.held += sum(map(getsizeof, short)) + 120 * len(short) + 4 * (self.used - before)
            passing = [x for x in distinct if len(x) > KEPT_PART]
            used = self.used
            self._learn(passing)
            at[new] = np.fromiter(map(self.where.__getitem__, unknown), np.int64, len(unknown))
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        within = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)
        ids = self.ids[np.repeat(self.starts[at], sizes) + within]
        if passing:
            self._forget(passing, used)
        last = np.cumsum([len(t) for t in texts])  # parts of the texts up to here
        return np.split(ids, np.concatenate([[0], ends])[last[:-1]])


def grouped(texts: Iterable[str], size: int = 1 << 19) -> Iterator[list[str]]:
    """The texts in groups of about ``size`` characters, so that memory stays small."""
    group: list[str] = []
    held = 0
    for text in texts:
        group.append(text)
        held += len(text)
        if held >= size:
            yield group
            group, held = [], 0
    if group:
        yield group
