"""Near duplicates by SimHash: pigeonhole blocks propose pairs of fingerprints, Hamming distance decides."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axisflow.llm.common import apart, kept, some_at_a_time, text_or_empty, trimmed
from axisflow.llm.graph import components

_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: str, words: int, seed: int) -> list[int]:
    """XXH64 of every shingle of a text; A-Z count as lower case. One shingle, the whole, where words are fewer."""
    own = text.encode("utf-8", "replace").lower().split()
    if not own:
        return []
    line, digest = b" ".join(own), xxhash.xxh64_intdigest
    if len(own) <= words:
        return [digest(line, seed)]
    lengths = np.fromiter(map(len, own), dtype=np.int64, count=len(own))
    ends = np.cumsum(lengths + 1) - 1
    return [digest(line[a:b], seed) for a, b in zip((ends - lengths).tolist(), ends[words - 1 :].tolist())]


def majorities(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One fingerprint per run of hashes (sizes: their lengths): bits that over half the run's hashes have set.

    Eight byte-wide counters are summed at once in a 64-bit word, in strips of at most 255 hashes.
    """
    out = np.zeros(len(sizes), dtype=np.uint64)
    runs = np.flatnonzero(sizes)
    if not len(runs):
        return out
    n = sizes[runs]
    strips = -(-n // 255)
    first = np.cumsum(strips) - strips
    place = np.arange(strips.sum()) - np.repeat(first, strips)
    starts = np.repeat(np.cumsum(n) - n, strips) + 255 * place
    found = np.zeros(len(runs), dtype=np.uint64)
    for j in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(j)) & _LANES, starts)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        most = (2 * counts > n[:, None]).astype(np.uint64)
        for byte in range(8):
            found |= most[:, byte] << np.uint64(8 * byte + j)
    out[runs] = found
    return out


#: Odd multipliers that make further 64-bit hashes of one.
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)


def mixed(h: np.ndarray, i: int) -> np.ndarray:
    """The i-th further hash of hashes."""
    h = (h ^ (h >> np.uint64(29))) * np.uint64(_MIX[i])
    return h ^ (h >> np.uint64(32))


@dataclass(frozen=True)
class Check:
    """A second, 256-bit fingerprint over shingles of `words` words; links must also be within `bits` of its bits.

    Of two texts with a Jaccard similarity of J, each bit differs with a chance of arccos(2J / (1 + J)) / pi, which
    for 0.8 is 39 bits of 256 on average, give or take 6, and for unlike texts about 128.
    """

    words: int = 5
    bits: int = 48


def fingerprints(text: Column, words: int = 4, seed: int = 42, check: Check | None = None) -> Column:
    """struct(fp, l0 to l3): the 64-bit SimHash of a text and, with `check`, the longer one, as signed longs; 0 without words."""
    names = ["fp", *(f"l{i}" for i in range(4 if check else 0))]

    @F.pandas_udf(", ".join(f"{c} long" for c in names))
    @trimmed
    def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = [[np.zeros(0, np.uint64)] for _ in names]
            for part in some_at_a_time(texts):
                for n in {words, check.words} if check else {words}:
                    lists = [shingle_hashes(t, n, seed) for t in texts[part]]
                    sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
                    flat = np.fromiter((h for own in lists for h in own), dtype=np.uint64, count=int(sizes.sum()))
                    if n == words:
                        out[0].append(majorities(flat, sizes))
                    if check and n == check.words:
                        for i in range(4):
                            out[i + 1].append(majorities(mixed(flat, i), sizes))
            yield pd.DataFrame({c: np.concatenate(x).view(np.int64) for c, x in zip(names, out)})

    return simhash(text)


def blocks_for(n: int, bits: int, bucket: int) -> int:
    """Blocks to split 64 bits into, so that a key (all but `bits` of the blocks) is shared by about `bucket` of n
    fingerprints at most; more fingerprints get longer keys, and more tables of them."""
    need = max(1, n // bucket).bit_length()
    return next(b for b in range(bits + 1, 65) if b >= 3 * bits or 64 * (b - bits) // b >= need)


def block_masks(blocks: int, bits: int) -> list[int]:
    """Masks, as signed longs, of every choice of blocks - bits blocks: two fingerprints that differ in at most
    `bits` bits differ in at most `bits` blocks, so they agree under one of these masks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    block = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [signed(sum(block[i] for i in chosen)) for chosen in combinations(range(blocks), blocks - bits)]


def masks_within(bits: list[int], blocks: int, agreeing: int) -> list[int]:
    """Masks of every choice of `agreeing` of the blocks that the given bits are split into."""
    edges = [len(bits) * i // blocks for i in range(blocks + 1)]
    block = [sum(1 << b for b in bits[x:y]) for x, y in zip(edges, edges[1:])]
    return [sum(block[i] for i in chosen) for chosen in combinations(range(blocks), agreeing)]


def spanning(fp: np.ndarray, longs: np.ndarray, bits: int, check: Check | None, patience: int | None = 64) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links, as places, that join whatever is linked within a group: a breadth-first forest, so fewer links than
    members however many pairs are close. A member is compared only with those not yet reached. Where that takes more
    than `patience` comparisons a member, as in a large group that shares its key by chance, what is open is split by
    further bits instead."""
    links, rest, work = [], np.arange(len(fp)), 0
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            if patience and work > patience * max(len(fp), 4096):
                open_ = np.concatenate([queue, rest])
                return links + [(open_[a], open_[b]) for a, b in finer(fp[open_], longs[open_], bits, check)]
            x = queue.pop()
            work += len(rest)
            near = np.bitwise_count(fp[rest] ^ fp[x]) <= bits
            if check and near.any():
                near[near] = np.bitwise_count(longs[rest[near]] ^ longs[x]).sum(axis=1) <= check.bits
            if near.any():
                reached = rest[near]
                links.append((np.full(len(reached), x), reached))
                queue.extend(reached.tolist())
                rest = rest[~near]
    return links


def finer(fp: np.ndarray, longs: np.ndarray, bits: int, check: Check | None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links as of spanning, by blocks of the bits in which the group differs."""
    varying = int(np.bitwise_or.reduce(fp ^ fp[0]))
    own = [b for b in range(64) if varying >> b & 1]
    if len(own) < 2 * bits:
        return spanning(fp, longs, bits, check, None)
    links = []
    for mask in masks_within(own, 2 * bits, bits):
        order = np.argsort(fp & np.uint64(mask), kind="stable")
        key = (fp & np.uint64(mask))[order]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(starts, len(key)))
        for at, size in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
            here = order[at : at + size]
            links += [(here[a], here[b]) for a, b in spanning(fp[here], longs[here], bits, check, None)]
    return links


def signed(m: int) -> int:
    return m - (1 << 64) if m >> 63 else m


def crowded_keys(keyed: DataFrame, keys: list[str], crowd: int) -> DataFrame | None:
    """Keys that, by every 64th node, are shared by about `crowd` rows or more, with `size`, that number; None if there are none.
    There are fewer of them than rows by a factor of `crowd`."""
    seen = keyed.where(F.pmod(F.xxhash64("node"), F.lit(64)) == 0).groupBy(*keys).agg((64 * F.count(F.lit(1))).alias("size"))
    found = kept(seen.where(F.col("size") >= crowd))
    return None if found.isEmpty() else found


def split_further(keyed: DataFrame, crowded: DataFrame, masks: list[int], bits: int, few: int) -> DataFrame:
    """keyed with the rows of crowded keys under longer keys: every choice of half the blocks of the bits that their key
    leaves out, so that close fingerprints still share one. As exact as before, and a hot key is many."""
    small = crowded.select("table", "key")
    small = F.broadcast(small) if small.count() <= few else small
    longer = [[signed(m % (1 << 64) | x) for x in masks_within([b for b in range(64) if not m >> b & 1], 2 * bits, bits)] for m in masks]
    own = F.element_at(F.array(*(F.array(*map(F.lit, x)) for x in longer)), F.col("table") + 1)
    inside = keyed.join(small, ["table", "key"], "left_semi").select("*", F.posexplode(own).alias("_i", "_m"))
    inside = inside.withColumns({"key": F.col("fp").bitwiseAND(F.col("_m")), "table": (F.col("table") + 1) * 1_000_000 + F.col("_i")}).select(keyed.columns)
    return keyed.join(small, ["table", "key"], "left_anti").select(keyed.columns).unionAll(inside)


def links_of(nodes: DataFrame, bits: int, n: int, bucket: int, check: Check | None, crowd: int = 200_000, few: int = 100_000) -> DataFrame:
    """a, b: links between nodes that connect what is connected. nodes: node, fp (and l0 to l3), n distinct rows.

    Fingerprints that share a key meet in one task, at 16 bytes each (48 with `check`); keys that about `crowd` or more
    share are split further first."""
    own = ["node", "fp", *(f"l{i}" for i in range(4 if check else 0))]
    masks = block_masks(blocks_for(n, bits, bucket), bits)
    keyed = nodes.select(*own, F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in masks))).alias("table", "key"))
    if n >= crowd and (crowded := crowded_keys(keyed, ["table", "key"], crowd)) is not None:
        keyed = split_further(keyed, crowded, masks, bits, few)

    @trimmed
    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["table", "key", *own]
        held: list[np.ndarray] = []  # rows of the last group, which may go on

        def pairs() -> pd.DataFrame:
            rows = np.ascontiguousarray(np.concatenate(held, axis=1))
            cuts = np.flatnonzero((np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0)) + 1
            starts, node, fp = np.concatenate([[0], cuts]), rows[2], rows[3].view(np.uint64)
            longs = rows[4:].view(np.uint64).T
            sizes = np.diff(np.append(starts, rows.shape[1]))
            two = starts[sizes == 2]
            close = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= bits]
            if check:
                close = close[np.bitwise_count(longs[close] ^ longs[close + 1]).sum(axis=1) <= check.bits]
            out = [(node[close], node[close + 1])]
            for at, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                here = slice(at, at + size)
                out += [(node[here][a], node[here][b]) for a, b in spanning(fp[here], longs[here], bits, check)]
            a, b = map(np.concatenate, zip(*out))
            return pd.DataFrame({"a": a, "b": b}).drop_duplicates()

        for batch in batches:
            rows = np.stack([batch[c].to_numpy(np.int64) for c in names])
            if not rows.shape[1]:
                continue
            last = (rows[0] == rows[0, -1]) & (rows[1] == rows[1, -1])
            if not last.all() or held and (held[-1][:2, -1] != rows[:2, -1]).any():
                held.append(rows[:, ~last])
                yield pairs()
                held.clear()
            held.append(rows[:, last])
        if held:
            yield pairs()

    return keyed.repartition("table", "key").sortWithinPartitions("table", "key").mapInPandas(link, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = 4, bits: int = 4, seed: int = 42, bucket: int = 1, check: Check | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, fingerprint (16 hex digits), component_id.

    Fingerprints that differ in at most `bits` bits are linked, if their longer ones pass `check` too; component_id is
    the smallest id that links reach, its own included. Null and empty texts have the fingerprint zero, which links
    like any other. Repeated rows keep their rows; null ids are never a component_id unless a component has no other;
    other columns aren't read; an empty table gives no rows. Copies are one node before any join, and a group of close
    fingerprints gives a spanning forest, not its pairs, so neither a third of all rows being copies nor thousands of
    near copies adds links.
    """
    names = ["fp", *(f"l{i}" for i in range(4 if check else 0))]
    prints = docs.select(F.col(id_col).alias("_id"), fingerprints(text_or_empty(text_col), words, seed, check).alias("f")).select("_id", "f.*")
    prints = kept(prints.withColumn("node", F.xxhash64(*names) if check else F.col("fp")))
    nodes = kept(prints.groupBy("node").agg(F.min("_id").alias("least"), *(F.first(c).alias(c) for c in names)))
    roots = components(links_of(nodes, bits, nodes.count(), bucket, check), "a", "b")
    rooted = nodes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id")).select(apart("root").alias("_r"), "component_id")
    named = rooted.join(ids, rooted["root"] == ids["_r"]).select("node", "component_id")
    return prints.join(named, "node").select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
