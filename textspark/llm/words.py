"""Words of whole texts as numpy arrays, with 64-bit hashes and rolling hashes of word windows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: A word is a maximal run of anything but ASCII white space.
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
BASE = np.uint64(0x9E3779B97F4A7C15)
LARGEST_CACHE = 500_000


class HashCache(dict):
    """64-bit hashes of words; emptied when it has grown to LARGEST_CACHE words."""

    def __init__(self, seed: int = 0) -> None:
        super().__init__()
        self.seed = seed

    def __missing__(self, word: str) -> int:
        if len(self) >= LARGEST_CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"), self.seed)
        return value

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values after which every bit depends on all bits."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def windows(a: np.ndarray, n: int) -> np.ndarray:
    """Hash of each window of n consecutive entries of a (none if a is shorter).

    Prefix sums of a[i] * BASE**i give every window's polynomial in three passes over a, whatever n is;
    multiplying by the inverse power makes it independent of the place."""
    if len(a) < n:
        return np.empty(0, np.uint64)
    if n <= 6:
        h = a[: len(a) - n + 1].copy()
        for k in range(1, n):
            h = h * BASE + a[k : len(a) - n + 1 + k]
        return mixed(h)
    up, down = _powers(len(a))
    sums = np.empty(len(a) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(a * up[: len(a)], out=sums[1:])
    return mixed((sums[n:] - sums[:-n]) * down[: len(a) - n + 1])


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((BASE, _INVERSE)):
            grown = np.full(size, base, np.uint64)
            grown[0] = 1
            np.cumprod(grown, out=grown)
            _POWERS[k] = grown
    return _POWERS


def repeated(h: np.ndarray) -> np.ndarray:
    """True where a value occurs twice or more."""
    order = np.argsort(h)
    s = h[order]
    same = s[1:] == s[:-1]
    out = np.zeros(len(h), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """True for the n places that windows of ``length`` beginning at starts (a mask) cover."""
    at = np.flatnonzero(starts)
    edge = np.zeros(n + 1, np.int32)
    edge[at] += 1
    edge[at + length] -= 1
    return np.cumsum(edge)[:n] > 0


def slices(batch: pa.RecordBatch, column: int, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """batch in parts of about ``most`` characters of its text column, a row at least each."""
    sizes = np.fromiter((0 if not x.is_valid else len(x.as_buffer()) for x in batch.column(column)), np.int64, batch.num_rows)
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(size)
    if start < batch.num_rows:
        yield batch.slice(start)
