"""Packing token sequences: exact complements by hashed length sums, then best fit.

Texts become pieces of at most `capacity` ids. Only the histogram of piece lengths (at most `capacity` rows,
whatever the table's size) goes to the driver, which plans patterns: lists of lengths that share a sequence, each with
the number of sequences that use it. Pieces then find their slot by their rank among the pieces of their length.
"""

from __future__ import annotations

import functools
import os
import sys
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axisflow.llm.common import byte_letters, chunks_of, kept, some_at_a_time, text_or_empty, trimmed


def as_bytes(ids: list[int]) -> bytes:
    """Little-endian 32-bit ids."""
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


class ChunkIds:
    """Ids of texts from the library, asked once for each chunk between white space; little-endian 32-bit bytes.

    Right only for vocabularies that drop white space and case before anything else is decided, which is checked.
    """

    def __init__(self, path: str, memo: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.raw("a bc\nd") != self.raw("a") + self.raw("bc") + self.raw("d") or self.raw("Abc.") != self.raw("abc") + self.raw("."):
            raise ValueError("the vocabulary keeps white space or case, or joins marks to letters; chunks can't be told apart")
        self.memo, self.known, self.pieces = memo, {}, {}
        self.letters = dict(enumerate(byte_letters()))

    def raw(self, text: str) -> bytes:
        return as_bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    @staticmethod
    def plain(word: str) -> bool:
        """Whether it is one piece whatever its case: these go to the library's merges without its normalisers."""
        return word.isalpha() and (word.isascii() or max(word) < "\u0180" and "\u0130" not in word)

    def word(self, word: str) -> bytes:
        """Ids of a plain word in lower case."""
        letters = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return as_bytes([t.id for t in self.tokenizer.model.tokenize(letters)])

    def learn(self, chunks: set[str]) -> None:
        """Put chunks in `known`. One that is plain but for marks after it is its letters in lower case and the marks,
        which the vocabulary's pattern parts; these go in `pieces`, which outlives `known`: they are fewer than chunks.

        Letters below U+0180 but the dotted capital I have one lower case each and compose with nothing.
        """
        known, pieces, plain, rest = self.known, self.pieces, self.plain, []
        if len(pieces) + len(chunks) > self.memo:
            pieces.clear()
        for chunk in chunks:
            core = chunk.rstrip(".,;:!?|*&%$#")
            if not plain(core):
                rest.append(chunk)
                continue
            low = core.lower()
            if (ids := pieces.get(low)) is None:
                ids = pieces[low] = self.word(low)
            if len(core) < len(chunk):
                marks = chunk[len(core) :]
                if (more := pieces.get(marks)) is None:
                    more = pieces[marks] = self.raw(marks)
                ids += more
            known[chunk] = ids
        if rest:
            for chunk, got in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
                known[chunk] = as_bytes(got.ids)

    def of(self, texts: list[str]) -> Iterator[bytes]:
        chunks = [chunks_of(t) for t in texts]
        wanted = set(chain.from_iterable(chunks))
        # a difference with a dict looks up the few; one with its keys() would go through all that is remembered
        new = wanted.difference(self.known)
        if len(self.known) + len(new) > self.memo:
            self.known.clear()
            new = wanted
        self.learn(new)
        get = self.known.__getitem__
        for c in chunks:
            yield b"".join(map(get, c))


@functools.cache
def chunk_ids(path: str, memo: int) -> ChunkIds:
    """One vocabulary for each worker process; what it remembers goes at the end of a task."""
    return ChunkIds(path, memo)


def pieces_of(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str, text_col: str, memo: int) -> DataFrame:
    """One row per piece: the id, piece, start, length, ids_crc32. A narrow map."""
    kind = docs.schema[id_col].dataType
    end = int(end_id).to_bytes(4, "little")

    @trimmed
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = chunk_ids(path, memo)
        for batch in batches:
            texts, row, piece, start, length, crc = batch["text"], [], [], [], [], []
            for part in some_at_a_time(texts):
                for i, data in enumerate(ids.of(texts[part].tolist()), part.start):
                    data += end
                    n = len(data) // 4
                    for k, at in enumerate(range(0, n, capacity)):
                        own = data[4 * at : 4 * (at + capacity)]
                        row.append(i), piece.append(k), start.append(at), length.append(len(own) // 4), crc.append(zlib.crc32(own))
            yield pd.DataFrame({id_col: batch[id_col].iloc[row].to_numpy(), "piece": np.asarray(piece, "int32"), "start": np.asarray(start, "int64"), "length": np.asarray(length, "int64"), "ids_crc32": np.asarray(crc, "int64")})
        ids.known.clear(), ids.pieces.clear()

    # ids travel as text: pandas would make floats of whole numbers beside a null
    source = docs.select(F.col(id_col).cast("string").alias(id_col), text_or_empty(text_col).alias("text"))
    found = source.mapInPandas(cut, f"`{id_col}` string, piece int, start long, length long, ids_crc32 long")
    return found.withColumn(id_col, F.col(id_col).cast(kind))


class LengthSums:
    """Which sums one, two or three available lengths make: bit s of a word is set if some choice sums to s.

    Lengths only run out, so an index that is out of date says yes too often, never no; it is then made anew.
    """

    def __init__(self, counts: np.ndarray):
        self.counts, self.capacity = counts, len(counts) - 1
        self.renew()

    def renew(self) -> None:
        lengths = np.flatnonzero(self.counts).tolist()
        limit = (1 << (self.capacity + 1)) - 1
        self.one = self.two = self.three = 0
        for a in lengths:
            self.one |= 1 << a
        for a in lengths:
            self.two |= self.one << a
        self.two &= limit
        for a in lengths:
            self.three |= self.two << a
        self.three &= limit
        self.fresh = True

    def pair(self, gap: int) -> tuple[int, ...]:
        """The most uneven pair of available lengths that fills the gap."""
        low = np.arange(1, gap // 2 + 1)
        fits = low[(self.counts[low] > 0) & (self.counts[gap - low] > (low == gap - low))]
        return (gap - int(fits[0]), int(fits[0])) if len(fits) else ()

    def triple(self, gap: int) -> tuple[int, ...]:
        for a in np.flatnonzero(self.counts[: max(gap - 1, 0)])[::-1].tolist():
            if self.two >> (gap - a) & 1:
                self.counts[a] -= 1
                rest = self.pair(gap - a)
                self.counts[a] += 1
                if rest:
                    return (a, *rest)
        return ()

    def filling(self, gap: int) -> tuple[int, ...]:
        """One, two or three available lengths that fill the gap exactly, or none."""
        if self.counts[gap]:
            return (gap,)
        while (two := self.two >> gap & 1) or self.three >> gap & 1:
            if found := (two and self.pair(gap)) or self.triple(gap):
                return found
            if self.fresh:
                return ()
            self.renew()
        return ()


def plan_patterns(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Patterns (lengths, number of sequences) that use up the histogram {length: count}.

    The longest length left opens a sequence. A combination that fills the gap exactly is looked up; where there is
    none, the best fit, which is the longest length that goes in, narrows the gap and the lookup is repeated. A pattern
    is used as often as the counts allow, so the number of patterns depends on the lengths, not on the pieces.
    """
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        counts[length] += n
    patterns = [([capacity], int(counts[capacity]))] if counts[capacity] else []
    counts[capacity] = 0
    sums = LengthSums(counts)
    while (left := np.flatnonzero(counts)).size:
        items, gap = [int(left[-1])], capacity - int(left[-1])
        counts[items[0]] -= 1
        while gap:
            fill = sums.filling(gap)
            if not fill:
                fits = np.flatnonzero(counts[: gap + 1])
                if not fits.size:
                    break
                fill = (int(fits[-1]),)
            items += fill
            gap -= sum(fill)
            for x in fill:
                counts[x] -= 1
        times = Counter(items)
        for x, k in times.items():
            counts[x] += k
        m = min(int(counts[x]) // k for x, k in times.items())
        for x, k in times.items():
            counts[x] -= m * k
            sums.fresh &= bool(counts[x])
        patterns.append((items, m))
    return patterns


def slots_of(patterns: list[tuple[list[int], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys length << 44 | first rank, the first sequence and the offset of each slot."""
    used: Counter = Counter()
    rows, sequence = [], 0
    for items, m in patterns:
        offset = 0
        for x in items:
            rows.append((x << 44 | used[x], sequence, offset))
            used[x] += m
            offset += x
        sequence += m
    keys, first, offsets = (np.asarray(c, dtype=np.int64) for c in zip(*sorted(rows))) if rows else [np.zeros(0, np.int64)] * 3
    return keys, first, offsets


def placed(key: Column, slots) -> Column:
    """struct(sequence_id, offset) of the piece with the key length << 44 | rank."""

    @F.pandas_udf("sequence_id long, offset long")
    def place(key: pd.Series) -> pd.DataFrame:
        keys, first, offsets = slots.value
        k = key.to_numpy()
        at = np.searchsorted(keys, k, side="right") - 1
        return pd.DataFrame({"sequence_id": first[at] + (k - keys[at]), "offset": offsets[at]})

    return place(key)


def pack(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", memo: int = 250_000) -> DataFrame:
    """One row per piece: the id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is empty and gives one piece, the end id alone. Only texts longer than `capacity` ids are cut.
    Repeated rows and null ids are pieces of their own; other columns aren't read; an empty table gives no rows.
    Pieces of one length are interchangeable, so ties don't matter. The pieces (no ids) are written once to the shared
    folder; ranks then come from counts per partition and length, so that a length with a third of all pieces isn't
    gathered anywhere. The broadcast slots number at most a few times `capacity`, at any size of the table.
    """
    spark = docs.sparkSession
    pieces = kept(pieces_of(docs, path, capacity, end_id, id_col, text_col, memo)).withColumn("_part", F.spark_partition_id())
    counts = pieces.groupBy("_part", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = spark.sparkContext.broadcast(slots_of(plan_patterns(histogram, capacity)))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    order = Window.partitionBy("_part", "length").orderBy(id_col, "piece", "start", "ids_crc32")
    ranked = pieces.withColumn("_rank", F.row_number().over(order) - 1).join(starts, ["_part", "length"])
    key = F.shiftleft(F.col("length"), 44) + F.col("_before") + F.col("_rank")
    return ranked.withColumn("_at", placed(key, slots)).select(id_col, "piece", "start", "length", "ids_crc32", "_at.sequence_id", "_at.offset")
