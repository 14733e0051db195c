"""Texts as flat arrays: the bytes of many texts in one array, where their words lie, and hashes of words and shingles.

Everything is done for all words at once in numpy, so that cost follows bytes, not Python objects.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np

#: Bytes whose hashes are worked out at once; only a longer word takes more.
STEP = 1 << 21
#: Fixed value: an odd multiplier, whose powers weigh the bytes of a word.
_BASE = 0x9E3779B97F4A7C15
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mixed(h: np.ndarray) -> np.ndarray:
    """64-bit numbers with their bits spread over the whole width."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def powers(base: int, n: int) -> np.ndarray:
    """base to the 0, 1, ... n - 1, modulo 2**64."""
    out = np.full(n, base & (1 << 64) - 1, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_POWERS, _INVERSES = powers(_BASE, STEP), powers(pow(_BASE, -1, 1 << 64), STEP)


@dataclass
class Words:
    """Words of a batch of texts: their first byte, the byte after them, and the number of their text."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    #: Words in each text, and each text's first byte.
    sizes: np.ndarray
    first: np.ndarray

    @staticmethod
    def of(texts: Sequence[str | None], blank: np.ndarray = _SPACE, lower: bool = True) -> Words:
        """What lies between bytes that are blank; A-Z count as lower case. Null is empty."""
        raw = [(t or "").encode("utf-8", "replace") for t in texts]
        data = np.frombuffer(b"\n".join([b"", *raw, b""]), dtype=np.uint8)
        edges = np.diff((~blank[data]).view(np.int8))
        start, end = np.flatnonzero(edges == 1) + 1, np.flatnonzero(edges == -1) + 1
        first = 1 + np.cumsum([0, *(len(r) + 1 for r in raw)])
        at = np.searchsorted(start, first)
        sizes = np.diff(at)
        return Words(LOWER[data] if lower else data, start, end, np.repeat(np.arange(len(raw)), sizes), sizes, first[:-1])

    def parts(self) -> Iterator[slice]:
        """Runs of words of about STEP bytes."""
        at = 0
        while at < len(self.start):
            to = max(at + 1, int(np.searchsorted(self.end, self.start[at] + STEP, side="right")))
            yield slice(at, to)
            at = to

    def hashes(self, most: int | None = None) -> np.ndarray:
        """A 64-bit hash of each word, or of its first `most` bytes: a polynomial in them, then mixed with their number."""
        out = np.empty(len(self.start), dtype=np.uint64)
        for part in self.parts():
            start, end = self.start[part], self.end[part]
            low, n = start[0], end[-1] - start[0]
            end = end if most is None else np.minimum(end, start + most)
            up, down = (_POWERS, _INVERSES) if n <= STEP else (powers(_BASE, n), powers(pow(_BASE, -1, 1 << 64), n))
            upto = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum((self.data[low : low + n].astype(np.uint64) + np.uint64(1)) * up[:n], out=upto[1:])
            own = (upto[end - low] - upto[start - low]) * down[start - low]
            out[part] = mixed(own + (end - start).astype(np.uint64) * np.uint64(_BASE))
        return out


def shingles(hashes: np.ndarray, sizes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every n words in a row of each text (sizes: its words), and how many each has; one, of all its words,
    where they are fewer than n, none where there are none."""
    weights = powers(_BASE, n + 1)[1:]
    count = np.where(sizes >= n, sizes - n + 1, np.minimum(sizes, 1))
    first = np.cumsum(sizes) - sizes
    at = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    width = np.repeat(np.minimum(sizes, n), count)
    out = width.astype(np.uint64)
    whole = not ((sizes > 0) & (sizes < n)).any()
    for k in range(n):
        if whole:
            out += hashes[at + k] * weights[k]
        else:
            inside = np.flatnonzero(width > k)
            out[inside] += hashes[at[inside] + k] * weights[k]
    return mixed(out), count


def distinct(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each run (sizes: their lengths), and how many each has."""
    run = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((hashes, run))
    hashes, run = hashes[order], run[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (run[1:] != run[:-1])
    return hashes[new], np.bincount(run[new], minlength=len(sizes))


def summed(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of the given sizes; 0 for an empty one."""
    upto = np.zeros(len(values) + 1, dtype=values.dtype)
    np.cumsum(values, out=upto[1:])
    ends = np.cumsum(sizes)
    return upto[ends] - upto[ends - sizes]
