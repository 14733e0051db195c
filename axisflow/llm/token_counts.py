"""Token counts by heap-and-linked-list byte-pair merging, without making identifiers.

A text's count is its number of initial symbols (bytes) minus the merges done. Merges never reach over
white space in this family of vocabularies, so counts are kept per white-space-free chunk in a bounded memo.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axisflow.llm.common import byte_letters, chunks_of, text_or_empty, trimmed


def merged_length(symbols: list[int], pairs: dict[int, int]) -> int:
    """How many symbols remain when the lowest-ranked adjacent pair, leftmost first, is merged until none is left.

    symbols: identifiers under 2**20. pairs: left << 20 | right -> rank << 20 | merged identifier.
    Heap entries are single integers, pair value << bits | place, so that they compare fast; an entry whose pair
    has gone since is recognised by the value kept for its place.
    """
    n = len(symbols)
    if n < 2:
        return n
    get = pairs.get
    value = [get(a << 20 | b, -1) for a, b in zip(symbols, symbols[1:])]
    value.append(-1)
    bits = n.bit_length()
    mask = (1 << bits) - 1
    heap = [v << bits | i for i, v in enumerate(value) if v >= 0]
    if not heap:
        return n
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    after, before, left = list(range(1, n + 1)), list(range(-1, n - 1)), n
    while heap:
        entry = pop(heap)
        i, v = entry & mask, entry >> bits
        if value[i] != v:
            continue
        j = after[i]
        new = symbols[i] = v & 0xFFFFF
        k = after[i] = after[j]
        value[j] = -1
        if k < n:
            before[k] = i
            v = value[i] = get(new << 20 | symbols[k], -1)
            if v >= 0:
                push(heap, v << bits | i)
        else:
            value[i] = -1
        h = before[i]
        if h >= 0:
            v = value[h] = get(symbols[h] << 20 | new, -1)
            if v >= 0:
                push(heap, v << bits | h)
        left -= 1
    return left


class TokenCounter(dict):
    """Counts by chunk: self[chunk] is the number of tokens of a chunk without white space."""

    def __init__(self, path: str, memo: int):
        spec = json.load(open(path, encoding="utf-8"))
        model, steps = spec["model"], (spec["normalizer"] or {}).get("normalizers", [])
        splits = [p for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", []) if p["type"] == "Split"]
        if model["type"] != "BPE" or not splits or splits[0]["behavior"] != "Removed" or not splits[0]["invert"]:
            raise ValueError("only vocabularies whose pattern drops white space are supported")
        ids, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.pairs = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.pairs[ids[a] << 20 | ids[b]] = rank << 20 | ids[a + b]
        letters = byte_letters()
        self.inner, self.last = [ids[c] for c in letters], [ids[c + end] for c in letters]
        self.nfc, self.lower = any(s["type"] == "NFC" for s in steps), any(s["type"] == "Lowercase" for s in steps)
        self.find = regex.compile(splits[0]["pattern"]["Regex"]).findall
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.cut = re.compile("|".join(map(re.escape, self.specials))) if self.specials else None
        self.memo, self.pieces = memo, {}

    def piece(self, piece: str) -> int:
        n = self.pieces.get(piece)
        if n is None:
            raw = piece.encode()
            symbols = [self.inner[b] for b in raw]
            symbols[-1] = self.last[raw[-1]]
            n = merged_length(symbols, self.pairs)
            if len(self.pieces) >= self.memo:
                self.pieces.clear()
            self.pieces[piece] = n
        return n

    def plain(self, chunk: str) -> int:
        if self.nfc and not chunk.isascii():
            chunk = unicodedata.normalize("NFC", chunk)
        if self.lower:
            chunk = chunk.replace("Σ", "σ").lower()  # letter by letter: no final sigma
        if chunk.isalpha():
            return self.piece(chunk)
        return sum(map(self.piece, self.find(chunk)))

    def __missing__(self, chunk: str) -> int:
        if self.cut and "<" in chunk:
            n = sum(map(self.plain, self.cut.split(chunk))) + len(self.cut.findall(chunk))
        else:
            n = self.plain(chunk)
        if len(self) >= self.memo:
            self.clear()
        if len(chunk) < 200:
            self[chunk] = n
        return n

    def count(self, text: str) -> int:
        return sum(map(self.__getitem__, chunks_of(text)))


@functools.cache
def counter(path: str, memo: int) -> TokenCounter:
    """One vocabulary for each worker process; what it remembers goes at the end of a task."""
    return TokenCounter(path, memo)


def token_count(text: Column, path: str, memo: int = 250_000) -> Column:
    """The number of tokens of a text column; memo bounds the chunks and the pieces that a task remembers, at some 100 bytes each."""

    @F.pandas_udf("long")
    @trimmed
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = counter(path, memo)
        for texts in batches:
            yield texts.map(own.count).astype("int64")
        own.clear(), own.pieces.clear()

    return count(text)


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    A null text is empty: 0 bytes, 0 tokens. Repeated rows and null ids each keep their row; other columns are not
    read; an empty table gives no rows. Strings of special tokens inside a text count as one token each. Texts of any
    length are counted whole. A narrow map: no shuffle, and memory that doesn't grow with the table.
    """
    text = text_or_empty(text_col)
    counted = docs.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), token_count(text, path).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
