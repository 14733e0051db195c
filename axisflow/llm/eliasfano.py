"""Elias-Fano sequences and a trigram trie over them, on memory-mapped arrays, with vectorised queries."""

from __future__ import annotations

import io
import tempfile

import numpy as np
from pyarrow import fs as pafs

def _select(words: np.ndarray, ones: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place of the rank-th (from 0) set bit; ones[i]: set bits before word i. Within a word, halves are told apart by their counts."""
    at = np.searchsorted(ones, rank, side="right") - 1
    left, x, place = (rank - ones[at]).astype(np.uint64), words[at], 64 * at
    for half in (32, 16, 8, 4, 2, 1):
        low = np.bitwise_count(x & np.uint64((1 << half) - 1)).astype(np.uint64)
        up = left >= low
        left -= low * up
        x = x >> (up * np.uint64(half))
        place += up * half
    return place


class EliasFano:
    """A non-decreasing sequence of n integers: `width` low bits of each packed, the high parts in unary.

    parts: the arrays low, high, ones, zeros, which may be memory maps."""

    def __init__(self, n: int, width: int, parts: dict[str, np.ndarray]):
        self.n, self.width, self.parts = n, width, parts

    @staticmethod
    def build(values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n, most = len(values), int(values[-1]) if len(values) else 0
        width = max(0, (most // max(n, 1)).bit_length() - 1)
        low = np.zeros(n * width // 64 + 2, dtype=np.uint64)
        if width:
            bits = values & np.uint64((1 << width) - 1)
            at = np.arange(n, dtype=np.uint64) * np.uint64(width)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(low, word, bits << shift)
            over = shift + np.uint64(width) > np.uint64(64)
            np.bitwise_or.at(low, word[over] + 1, bits[over] >> (np.uint64(64) - shift[over]))
        top = (values >> np.uint64(width)).astype(np.int64)
        place = top + np.arange(n)
        high = np.zeros((n + (most >> width) + 2) // 64 + 1, dtype=np.uint64)
        np.bitwise_or.at(high, place >> 6, np.uint64(1) << (place & 63).astype(np.uint64))
        count = np.bitwise_count(high).astype(np.int64)
        ones = np.concatenate([[0], np.cumsum(count)[:-1]])
        return EliasFano(n, width, {"low": low, "high": high, "ones": ones, "zeros": 64 * np.arange(len(high)) - ones})

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), dtype=np.uint64)
        low = self.parts["low"]
        at = i.astype(np.uint64) * np.uint64(self.width)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        out = low[word] >> shift
        over = shift > np.uint64(0)
        out[over] |= low[word[over] + 1] << (np.uint64(64) - shift[over])
        return out & np.uint64((1 << self.width) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The i-th values."""
        place = _select(self.parts["high"], self.parts["ones"], i)
        return (place - i).astype(np.uint64) << np.uint64(self.width) | self.lows(i)

    def find(self, x: np.ndarray) -> np.ndarray:
        """The place of each x by successor search, or -1 where the successor isn't x itself."""
        if not self.n:
            return np.full(len(x), -1, dtype=np.int64)
        x = x.astype(np.uint64)
        h = (x >> np.uint64(self.width)).astype(np.int64)
        inside = h < 64 * len(self.parts["high"]) - self.n - 1
        h = np.where(inside, h, 0)
        flipped, high, zeros = _Flipped(self.parts["high"]), self.parts["high"], self.parts["zeros"]
        start = np.where(h > 0, _select(flipped, zeros, np.maximum(h - 1, 0)) - (h - 1), 0)
        # a value's high part is followed by a set bit for each value that has it
        bit = start + h
        rest = high[bit >> 6] >> (bit & 63).astype(np.uint64)
        run = np.bitwise_count(rest & ~(rest + np.uint64(1))).astype(np.int64)
        end, cut = start + run, np.flatnonzero(run >= 64 - (bit & 63))
        end[cut] = _select(flipped, zeros, h[cut]) - h[cut]
        want, a, b = x & np.uint64((1 << self.width) - 1), start.copy(), end.copy()
        while (open_ := np.flatnonzero(a < b)).size:
            mid = (a[open_] + b[open_]) // 2
            less = self.lows(mid) < want[open_]
            a[open_[less]] = mid[less] + 1
            b[open_[~less]] = mid[~less]
        hit = inside & (a < end)
        hit[hit] = self.lows(a[hit]) == want[hit]
        return np.where(hit, a, -1)


class _Flipped:
    """Words with every bit inverted, read as needed."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return ~self.words[at]


class Children:
    """Sorted numbers below each of so many parents: monotone pointers to a parent's first child, and the children as one
    monotone sequence, each as its number plus the last value of the parent before."""

    def __init__(self, pointers: EliasFano, values: EliasFano):
        self.pointers, self.values = pointers, values

    @staticmethod
    def build(parent: np.ndarray, number: np.ndarray, parents: int) -> Children:
        """parent, number: of every child, sorted by both."""
        start = np.searchsorted(parent, np.arange(parents + 1))
        full = start[1:] > start[:-1]
        steps = np.zeros(parents, dtype=np.int64)
        steps[full] = number[start[1:][full] - 1] + 1
        return Children(EliasFano.build(start), EliasFano.build((np.cumsum(steps) - steps)[parent] + number))

    def first(self, parent: np.ndarray) -> np.ndarray:
        return self.pointers.get(parent).astype(np.int64)

    def find(self, parent: np.ndarray, number: np.ndarray) -> np.ndarray:
        """The place of each number below its parent, or -1."""
        if not len(parent) or not self.values.n:
            return np.full(len(parent), -1, dtype=np.int64)
        own, place = np.unique(parent, return_inverse=True)
        start, end = self.first(own), self.first(own + 1)
        base = np.zeros(len(own), dtype=np.int64)
        base[start > 0] = self.values.get(start[start > 0] - 1).astype(np.int64) + 1
        found = self.values.find(base[place] + number)
        return np.where((found >= start[place]) & (found < end[place]), found, -1)


class Levels:
    """Logarithms in 2**bits levels between the least and the greatest."""

    def __init__(self, floor: float, step: float, codes: np.ndarray):
        self.floor, self.step, self.codes = floor, step, codes

    @staticmethod
    def of(x: np.ndarray, bits: int) -> Levels:
        floor = float(x.min()) if len(x) else 0.0
        step = (float(x.max()) - floor) / ((1 << bits) - 1) if len(x) else 0.0
        return Levels(floor, step, np.rint((x - floor) / (step or 1.0)).astype(np.uint8 if bits <= 8 else np.uint16))

    def get(self, at: np.ndarray) -> np.ndarray:
        return self.floor + self.step * self.codes[at]


class Trie:
    """A trigram trie rooted at the middle word v.

    Level 1: the words v, with the weight of a context. Level 2: v's successors w, with log10 P(w | v), and the words u
    before v, with the weight of the context (u, v). Level 3: below each (u, v) its successors, as their ranks among
    v's, with log10 P(w | u v), so that a search is for the successor of a rank in its context. All of it lies in one
    file that has no name and goes with the process (in TMPDIR, about 4 bytes an n-gram of the shard), mapped from there.
    """

    def __init__(self, v, v_weight, parent, w, p2, u_parent, u, u_weight, node, rank, p3, bits: int = 8):
        """v: sorted; parent, w: pairs as places of v and words, sorted; u_parent, u: contexts likewise; node, rank:
        trigrams as places of contexts and ranks, sorted; the others: log10 weights and probabilities of these."""
        self.words = EliasFano.build(v)
        self.successors, self.contexts = Children.build(parent, w, len(v)), Children.build(u_parent, u, len(v))
        self.triples = Children.build(node, rank, len(u))
        self.levels = [Levels.of(x, bits) for x in (v_weight, p2, u_weight, p3)]
        self._map()

    def _sequences(self) -> list[EliasFano]:
        return [self.words, *(x for c in (self.successors, self.contexts, self.triples) for x in (c.pointers, c.values))]

    def _map(self) -> None:
        sequences = self._sequences()
        with tempfile.TemporaryFile() as f:
            arrays = [*(x.codes for x in self.levels), *(a for s in sequences for a in s.parts.values())]
            at = []
            for a in arrays:
                f.write(b"\0" * (-f.tell() % 8))
                at.append(f.tell())
                f.write(a.tobytes())
            f.write(b"\0" * 8)
            f.flush()
            rest = iter([np.memmap(f, dtype=a.dtype, mode="r", offset=o, shape=a.shape) if len(a) else a for a, o in zip(arrays, at)])
        for x in self.levels:
            x.codes = next(rest)
        for s in sequences:
            s.parts = {k: next(rest) for k in s.parts}

    def values(self, context: np.ndarray, v_of: np.ndarray, word: np.ndarray, alone: np.ndarray, pair_of: np.ndarray, before: np.ndarray) -> np.ndarray:
        """log10 P of trigrams. context: words v; v_of, word, alone: pairs as places of contexts, words and their own
        log10 P; pair_of, before: trigrams as places of pairs and the words u."""
        v_weight, p2, u_weight, p3 = self.levels
        level = self.words.find(context)
        parent = level[v_of]
        known = np.flatnonzero(parent >= 0)
        found = np.full(len(word), -1, dtype=np.int64)
        found[known] = self.successors.find(parent[known], word[known])
        log = alone.copy()
        log[known] += v_weight.get(parent[known])
        hit = found >= 0
        log[hit] = p2.get(found[hit])
        out = log[pair_of]
        inside = np.flatnonzero(parent[pair_of] >= 0)
        pair = pair_of[inside]
        node = self.contexts.find(parent[pair], before[inside])
        inside, pair, node = inside[node >= 0], pair[node >= 0], node[node >= 0]
        out[inside] += u_weight.get(node)
        seen = np.flatnonzero(found[pair] >= 0)
        inside, pair, node = inside[seen], pair[seen], node[seen]
        place = self.triples.find(node, found[pair] - self.successors.first(parent[pair]))
        out[inside[place >= 0]] = p3.get(place[place >= 0])
        return out

    def write(self, folder: str, name: str) -> None:
        """All levels as one NumPy archive."""
        system, path = pafs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        arrays = {f"level{i}": x.codes for i, x in enumerate(self.levels)} | {f"scale{i}": np.array([x.floor, x.step]) for i, x in enumerate(self.levels)}
        for i, s in enumerate(self._sequences()):
            arrays |= {f"{k}{i}": a for k, a in s.parts.items()} | {f"shape{i}": np.array([s.n, s.width])}
        held = io.BytesIO()
        np.savez(held, **arrays)
        with system.open_output_stream(f"{path}/{name}", compression=None) as out:
            out.write(held.getbuffer())

    @staticmethod
    def read(folder: str, name: str) -> Trie:
        system, path = pafs.FileSystem.from_uri(folder)
        with system.open_input_file(f"{path}/{name}") as data:
            got = np.load(io.BytesIO(data.read()))
        trie = Trie.__new__(Trie)
        s = [EliasFano(*got[f"shape{i}"].tolist(), {k: got[f"{k}{i}"] for k in ("low", "high", "ones", "zeros")}) for i in range(7)]
        trie.words, trie.successors, trie.contexts, trie.triples = s[0], Children(*s[1:3]), Children(*s[3:5]), Children(*s[5:7])
        trie.levels = [Levels(*got[f"scale{i}"].tolist(), got[f"level{i}"]) for i in range(4)]
        trie._map()
        return trie
