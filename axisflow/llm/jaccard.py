"""Near copies by SimHash and exact Jaccard similarity: pigeonhole blocks of the fingerprints propose pairs, bands of MinHashes
those that 64 bits can't reach, a 256-bit SimHash drops clearly unlike ones, shingles decide."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axisflow.llm.common import apart, kept, some_at_a_time, text_or_empty, trimmed
from axisflow.llm.flat import Words, distinct, mixed, shingles, summed
from axisflow.llm.graph import components
from axisflow.llm.simhash import Check, crowded_keys, links_of, majorities

#: Bits of the 64-bit SimHash within which its blocks propose every pair, as in op8, and about how many rows share a block's
#: key by chance: 5 tables up to 4 million documents, 15 up to 2e9, 35 up to 1e11.
BITS, BUCKET = 4, 1024
#: Bands of five MinHashes: a pair of similarity J shares one with a chance of 1 - (1 - J^5)^20, 0.9996 at 0.8.
BANDS, ROWS = 20, 5
#: Bits of 256 in which near copies differ at most: at similarity 0.8, 39 on average, give or take 6.
LOOSE = 72
#: Text hashes of members and crowded keys are broadcast up to this many, at 24 bytes each; beyond, joins are ordinary ones.
FEW = 1_000_000
#: Members of a band's bucket, and shingles of a loose group, that one task compares; more are dealt out to several parts,
#: all of which get about HUBS of the members, and what these leave apart is compared in every two parts.
CROWD, HELD, HUBS = 4096, 2_000_000, 64
_LONGS = tuple(f"l{i}" for i in range(4))

_rng = np.random.default_rng(42)
_FLIPS = _rng.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64)
_ODDS = _rng.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def band_keys(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A row of BANDS keys for each run of hashes (sizes: their lengths, none of them 0)."""
    starts = np.cumsum(sizes) - sizes
    keys = np.zeros((len(sizes), BANDS), dtype=np.uint64)
    if len(sizes):
        for i, (flip, odd) in enumerate(zip(_FLIPS, _ODDS)):
            least = np.minimum.reduceat((hashes ^ flip) * odd, starts)
            keys[:, i // ROWS] = mixed(keys[:, i // ROWS] ^ least)
    return keys


def sets_of(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's shingles, and how many each has."""
    w = Words.of(texts)
    return distinct(*shingles(w.hashes(), w.sizes, words))


def _prints(text: Column, words: int) -> Column:
    """struct(node, n, l0 to l3, keys): the hash of a text's set of shingles, its size, its 256-bit SimHash and its band keys; no keys without words."""

    @F.pandas_udf("node long, n long, l0 long, l1 long, l2 long, l3 long, keys array<long>")
    @trimmed
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = [pd.DataFrame({c: [] for c in ("node", "n", *_LONGS, "keys")})]
            for part in some_at_a_time(texts):
                flat, sizes = sets_of(texts[part].tolist(), words)
                own = pd.DataFrame({"node": mixed(summed(mixed(flat), sizes) + sizes.astype(np.uint64)).view(np.int64), "n": sizes})
                for i, c in enumerate(_LONGS):
                    own[c] = majorities(mixed(flat + np.uint64(i + 1)), sizes).view(np.int64)
                keys = np.zeros((len(sizes), BANDS), dtype=np.int64)
                keys[sizes > 0] = band_keys(flat, sizes[sizes > 0]).view(np.int64)
                own["keys"] = [k if n else k[:0] for k, n in zip(keys, sizes)]
                out.append(own)
            yield pd.concat(out[1:]) if len(out) > 1 else out[0]

    return prints(text)


def _sets(text: Column, words: int) -> Column:
    """The sorted distinct shingle hashes of a text, as bytes."""

    @F.pandas_udf("binary")
    @trimmed
    def sets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out: list[bytes] = []
            for part in some_at_a_time(texts):
                flat, sizes = sets_of(texts[part].tolist(), words)
                out += [x.tobytes() for x in np.split(flat, np.cumsum(sizes)[:-1])]
            yield pd.Series(out, dtype=object)

    return sets(text)


def _groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Batches, sorted by the keys, in pieces that cut no group."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        end = batch[keys].iloc[-1]
        last = (batch[keys] == end).all(axis=1).to_numpy()
        if not last.all() or held and (held[-1][keys].iloc[-1] != end).any():
            yield pd.concat([*held, batch[~last]], ignore_index=True)
            held = []
        held.append(batch[last])
    if held:
        yield pd.concat(held, ignore_index=True)


def _runs(rows: pd.DataFrame, keys: list[str]) -> Iterator[slice]:
    new = np.ones(len(rows), dtype=bool)
    new[1:] = np.any([rows[k].to_numpy()[1:] != rows[k].to_numpy()[:-1] for k in keys], axis=0)
    starts = np.flatnonzero(new)
    return (slice(a, b) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(rows)]))


def dealt(rows: DataFrame, key: str, crowded: DataFrame | None, share: int, few: int) -> DataFrame:
    """rows with `part`, 0 but for keys of `crowded` (key, size, every): their rows are dealt out by their nodes to so many
    parts that one has about `share` of the size, but for one in `every`, which goes to all parts and so joins them."""
    if crowded is None:
        return rows.withColumn("part", F.lit(0))
    c = crowded.select(F.col(key).alias("_k"), F.ceil(F.col("size") / share).cast("int").alias("_parts"), F.col("every").alias("_every"))
    c = F.broadcast(c) if c.count() <= few else c
    h = F.xxhash64("node", key)
    own = F.when(F.col("_parts").isNull(), F.array(F.lit(0))).when(F.pmod(h, F.col("_every")) == 0, F.sequence(F.lit(0), F.col("_parts") - 1)).otherwise(F.array(F.pmod(F.shiftright(h, 24), F.col("_parts")).cast("int")))
    return rows.join(c, F.col(key) == F.col("_k"), "left").select(*rows.columns, F.explode(own).alias("part"))


def crossed(rows: DataFrame, share: int, few: int) -> DataFrame:
    """rows (key, node, top, weight and others) of keys that have several tops, once for each cell (a, b), two parts of its
    key, to which its own belongs; so every two rows of a key with unlike tops meet in a cell. `side` is the row's part.

    A part weighs about `share`. A top that weighs more has parts of its own, which don't meet each other, so that a few
    rows beside a large top take cells in proportion to its size; what is left of a key takes cells by its square."""
    tops = kept(rows.groupBy("key", "top").agg(F.sum("weight").alias("w")))
    large = tops.where(F.col("w") > share).select("key", "top", "w", F.lit(1).alias("n"))
    small = tops.where(F.col("w") <= share).groupBy("key").agg(F.lit(None).cast("long").alias("top"), F.sum("w").alias("w"), F.count(F.lit(1)).alias("n"))
    by_key = Window.partitionBy("key")
    own = large.unionByName(small.select(large.columns)).withColumn("parts", F.ceil(F.col("w") / share))
    before = F.sum("parts").over(by_key.orderBy("top").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("parts")
    own = own.select("key", "top", "parts", before.alias("first"), F.sum("parts").over(by_key).alias("all"), F.sum("n").over(by_key).alias("n"))
    own = kept(own.where("n > 1").drop("n"))
    ranges = own.select(apart("key").alias("_key"), F.col("top").alias("_top"), F.struct("parts", "first", "all").alias("_own"))
    alone, common = ranges.where("_top IS NOT NULL"), ranges.where("_top IS NULL").select("_key", F.col("_own").alias("_common"))
    alone, common = (F.broadcast(x) if x.count() <= few else x for x in (alone, common))
    placed = rows.join(alone, (F.col("key") == F.col("_key")) & (F.col("top") == F.col("_top")), "left").select(*rows.columns, "_own")
    placed = placed.join(common, F.col("key") == F.col("_key"), "left").withColumn("_in", F.coalesce("_own", "_common")).where("_in IS NOT NULL")
    side = F.col("_in.first") + F.pmod(F.xxhash64("node", "key"), F.col("_in.parts"))
    met = placed.withColumn("side", side).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_in.all") - 1)))
    met = met.where("_own IS NULL OR _other < _in.first OR _other >= _in.first + _in.parts")
    return met.select(*rows.columns, "side", F.least("side", "_other").alias("a"), F.greatest("side", "_other").alias("b"))


def matrix_of(rows: pd.DataFrame, columns: tuple[str, ...]) -> np.ndarray:
    return np.stack([rows[c].to_numpy() for c in columns], axis=1).view(np.uint64)


def forest(longs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links, as places, that connect whatever is within LOOSE; fewer than members. A member is compared with those not yet reached."""
    rest = np.arange(len(longs))
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(longs[rest] ^ longs[x]).sum(axis=1) <= LOOSE
            if near.any():
                yield np.full(int(near.sum()), x), rest[near]
                queue.extend(rest[near].tolist())
                rest = rest[~near]


def across(tops: np.ndarray, sides: np.ndarray, near: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links, as places, that join whatever near(x, others), a mask, finds of the other side of a cell (of the one side where
    all are of it), where members of one top are joined already. A member is compared with those not yet reached."""
    rest, two = np.arange(len(tops)), len(sides) and (sides != sides[0]).any()
    while len(rest):
        first = tops[rest] == tops[rest[0]]
        queue, rest = rest[first].tolist(), rest[~first]
        while queue and len(rest):
            x = queue.pop()
            others = rest[sides[rest] != sides[x]] if two else rest
            found = others[near(x, others)] if len(others) else others
            if len(found):
                yield np.full(len(found), x), found
                reached = np.isin(tops[rest], tops[found])
                queue.extend(rest[reached].tolist())
                rest = rest[~reached]


def _by_blocks(nodes: DataFrame, few: int) -> DataFrame:
    """a, b: links that connect whatever is within BITS of the SimHash and within LOOSE of the longer one, none missed: the step of op8."""
    prints = nodes.where("n > 0").withColumn("fp", F.col("l0"))
    return links_of(prints, BITS, nodes.count(), BUCKET, Check(bits=LOOSE), few=few)


def _banded(nodes: DataFrame) -> DataFrame:
    return nodes.select("node", *_LONGS, F.explode("keys").alias("key"))


def _by_bands(keyed: DataFrame, crowded: DataFrame | None, crowd: int, few: int) -> DataFrame:
    """a, b: fewer links than members of each part of a band's bucket, that connect what is within LOOSE there."""
    keyed = dealt(keyed, "key", crowded and crowded.withColumn("every", F.greatest(F.floor(F.col("size") / HUBS), F.lit(1))), crowd, few)

    @trimmed
    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _groups(batches, ["key", "part"]):
            node, own, out = rows["node"].to_numpy(), matrix_of(rows, _LONGS), [(np.zeros(0, np.int64),) * 2]
            for here in _runs(rows, ["key", "part"]):
                if here.stop - here.start > 1:
                    out += [(node[here][a], node[here][b]) for a, b in forest(own[here])]
            a, b = map(np.concatenate, zip(*out))
            yield pd.DataFrame({"a": a, "b": b}).drop_duplicates()

    return keyed.repartition("key", "part").sortWithinPartitions("key", "part").mapInPandas(link, "a long, b long").distinct()


_CELL = ["key", "a", "b"]


def _between_parts(keyed: DataFrame, crowded: DataFrame, roots: DataFrame, crowd: int, few: int) -> DataFrame:
    """node, root: links between the roots of members of crowded buckets that are within LOOSE, over all parts of a bucket."""
    own = crowded.select(apart("key").alias("_key"))
    own = F.broadcast(own) if own.count() <= few else own
    rows = keyed.join(own, F.col("key") == F.col("_key"), "left_semi").join(roots.select(F.col("node").alias("_node"), "root"), F.col("node") == F.col("_node"), "left")
    rows = kept(rows.select("key", "node", F.coalesce("root", "node").alias("top"), F.lit(1).cast("long").alias("weight"), *_LONGS))

    @trimmed
    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _groups(batches, _CELL):
            top, side, own, out = rows["top"].to_numpy(), rows["side"].to_numpy(), matrix_of(rows, _LONGS), [(np.zeros(0, np.int64),) * 2]
            for here in _runs(rows, _CELL):
                longs = own[here]
                near = lambda x, others: np.bitwise_count(longs[others] ^ longs[x]).sum(axis=1) <= LOOSE
                out += [(top[here][a], top[here][b]) for a, b in across(top[here], side[here], near)]
            a, b = map(np.concatenate, zip(*out))
            yield pd.DataFrame({"node": a, "root": b}).drop_duplicates()

    cells = crossed(rows, max(crowd // 2, 1), few)
    return kept(cells.repartition(*_CELL).sortWithinPartitions(*_CELL).mapInPandas(link, "node long, root long").distinct())


class Sets:
    """Sorted sets of a group, for exact similarities of one with many.

    Where it takes at most `room` bytes, members of a set that others have too are bits of a row, so that an
    intersection is a count of bits; else sets are searched."""

    def __init__(self, sets: list[np.ndarray], room: int = 1 << 26):
        self.sets, self.sizes = sets, np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
        flat = np.concatenate(sets)
        _, place, times = np.unique(flat, return_inverse=True, return_counts=True)
        common = times > 1
        width = -(-int(common.sum()) // 64)
        self.bits = None
        if width * len(sets) * 8 <= room:
            inside = common[place]
            column, row = (np.cumsum(common) - 1)[place[inside]], np.repeat(np.arange(len(sets)), self.sizes)[inside]
            self.bits = np.zeros((len(sets), width), dtype=np.uint64)
            np.bitwise_or.at(self.bits, (row, column >> 6), np.uint64(1) << (column & 63).astype(np.uint64))

    def shared(self, x: int, others: np.ndarray) -> np.ndarray:
        if self.bits is not None:
            return np.bitwise_count(self.bits[others] & self.bits[x]).sum(axis=1, dtype=np.int64)
        own, sizes = self.sets[x], self.sizes[others]
        flat = np.concatenate([self.sets[i] for i in others])
        hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
        return np.add.reduceat(hit.astype(np.int64), np.cumsum(sizes) - sizes)

    def similar(self, x: int, others: np.ndarray, tenths: int) -> np.ndarray:
        """Which others have a Jaccard similarity of at least tenths / 10 with x. No set is empty."""
        n, m = self.sizes[x], self.sizes[others]
        out = 10 * np.minimum(n, m) >= tenths * np.maximum(n, m)
        if out.any():
            both = self.shared(x, others[out])
            out[out] = 10 * both >= tenths * (n + m[out] - both)
        return out


def clusters(longs: np.ndarray, sets: list[np.ndarray], tenths: int, room: int = 1 << 26) -> np.ndarray:
    """For each member of a group, the place of the first member that exact links reach."""
    root, rest, own = np.arange(len(sets)), np.arange(len(sets)), Sets(sets, room)
    while len(rest):
        first, queue, rest = rest[0], [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(longs[rest] ^ longs[x]).sum(axis=1) <= LOOSE
            if near.any():
                near[near] = own.similar(x, rest[near], tenths)
                root[rest[near]] = first
                queue.extend(rest[near].tolist())
                rest = rest[~near]
    return root


def _decided(members: DataFrame, tenths: int) -> DataFrame:
    """node, top: of each node of a part of a loose component, a node for its exact one there. members: root, part, node, l0 to l3, shingles."""

    @trimmed
    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _groups(batches, ["root", "part"]):
            node, own, sets = rows["node"].to_numpy(), matrix_of(rows, _LONGS), rows["shingles"]
            for here in _runs(rows, ["root", "part"]):
                yield pd.DataFrame({"node": node[here], "top": node[here][clusters(own[here], [np.frombuffer(s, np.uint64) for s in sets.iloc[here]], tenths)]})

    return members.repartition("root", "part").sortWithinPartitions("root", "part").mapInPandas(decide, "node long, top long")


def crowded_of(members: DataFrame) -> DataFrame:
    """root, size, every: the shingles of each root's members, and which of them go to all parts."""
    return members.groupBy("root").agg(F.sum("n").alias("size"), F.greatest(F.floor(F.count(F.lit(1)) / HUBS), F.lit(1)).alias("every"))


def united(tops: DataFrame) -> DataFrame:
    """node, top: one row a node, with the least node that links of node and top reach."""
    roots = components(tops, "node", "top")
    return kept(tops.select("node").distinct().join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("top")))


def _candidates(members: DataFrame, tops: DataFrame, crowded: DataFrame, tenths: int, held: int, few: int) -> DataFrame:
    """Members of crowded components in the cells of two parts in which the 256 bits and the sizes of an unlike top's member
    allow for an exact link, so that only their shingles are dealt out to cells."""
    own = crowded.select(apart("root").alias("_root"))
    own = F.broadcast(own) if own.count() <= few else own
    rows = members.join(own, F.col("root") == F.col("_root"), "left_semi").join(tops, "node")
    rows = kept(rows.select(F.col("root").alias("key"), "node", "top", F.col("n").alias("weight"), "text_hash", *_LONGS))
    cells = crossed(rows, max(held // 2, 1), few)

    @trimmed
    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _groups(batches, _CELL):
            own, found = matrix_of(rows, _LONGS), np.zeros(len(rows), dtype=bool)
            top, n, side = (rows[c].to_numpy() for c in ("top", "weight", "side"))
            for here in _runs(rows, _CELL):
                one, other = (np.flatnonzero(side[here] == rows[c].iloc[here.start]) + here.start for c in ("a", "b"))
                tops, sizes, longs = top[other], n[other], own[other]
                for x in one.tolist():
                    near = (tops != top[x]) & (10 * np.minimum(sizes, n[x]) >= tenths * np.maximum(sizes, n[x]))
                    near[near] = np.bitwise_count(longs[near] ^ own[x]).sum(axis=1) <= LOOSE
                    found[other[near]] = True
                    found[x] |= near.any()
            yield rows[found]

    return kept(cells.repartition(*_CELL).sortWithinPartitions(*_CELL).mapInPandas(meet, cells.schema))


def _decided_between(candidates: DataFrame, tenths: int) -> DataFrame:
    """node, top: exact links between tops, over all cells. candidates: those of _candidates with their shingles."""

    @trimmed
    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _groups(batches, _CELL):
            top, side, own, sets = rows["top"].to_numpy(), rows["side"].to_numpy(), matrix_of(rows, _LONGS), rows["shingles"]
            for here in _runs(rows, _CELL):
                longs, exact = own[here], Sets([np.frombuffer(s, np.uint64) for s in sets.iloc[here]])

                def near(x: int, others: np.ndarray) -> np.ndarray:
                    out = np.bitwise_count(longs[others] ^ longs[x]).sum(axis=1) <= LOOSE
                    if out.any():
                        out[out] = exact.similar(x, others[out], tenths)
                    return out

                for a, b in across(top[here], side[here], near):
                    yield pd.DataFrame({"node": top[here][a], "top": top[here][b]}).drop_duplicates()

    return candidates.repartition(*_CELL).sortWithinPartitions(*_CELL).mapInPandas(decide, "node long, top long").distinct()


def near_copies(docs: DataFrame, words: int = 5, tenths: int = 8, few: int = FEW, crowd: int = CROWD, held: int = HELD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, the text's xxhash64 as `text_hash`, component_id and component_text_hash.

    Texts are linked if their sets of `words`-word shingles have a Jaccard similarity of at least tenths / 10;
    component_id is the smallest id that links reach (null if there is none), component_text_hash the smallest hash of
    its texts there. Pairs are proposed by the SimHash of the shingles, all of those within BITS of 64 bits, and by bands,
    as a similarity of 0.8 is some 10 bits; pairs that neither proposes are missed (BANDS has the chance); every link is exact. Texts without
    words are copies of each other. Null ids, repeated rows and ties keep their rows; an empty table gives none; other
    columns aren't read.

    Shingles are worked out again for members of loose components only, and a loose component is decided where its
    shingles are, by a search that compares a member with those not reached. Buckets of about `crowd` members or more and
    components of over `held` shingles are dealt out to parts, to all of which the same few members go, so that no
    task gathers a group without bound. What this leaves apart is compared in a cell of every two parts, so that
    the result is the same for any `crowd` and `held`: no pair of a bucket or a component is left out for its size. That
    takes rows by the square of a group's size, but for groups and parts of them that are joined by then.
    """
    own = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_t"))
    prints = kept(own.select("_id", F.xxhash64("_t").alias("text_hash"), _prints(F.col("_t"), words).alias("f")).select("_id", "text_hash", "f.*"))
    columns = ["text_hash", "n", *_LONGS, "keys"]
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "text_hash"))
    nodes = kept(prints.groupBy("node").agg(first.alias("least"), F.min(F.struct(*columns)).alias("f")).select("node", "least", "f.*"))
    keyed = _banded(nodes)
    busy = crowded_keys(keyed, ["key"], crowd)
    roots = components(_by_blocks(nodes, few).unionByName(_by_bands(keyed, busy, crowd, few)), "a", "b")
    if busy is not None and not (more := _between_parts(keyed, busy, roots, crowd, few)).isEmpty():
        roots = components(roots.unionByName(more), "node", "root")
    roots = roots.unionAll(roots.select("root", "root").distinct())
    members = kept(nodes.join(roots, "node").select("node", "root", *columns[:-1]))

    def with_shingles(rows: DataFrame, wanted: DataFrame) -> DataFrame:
        wanted = F.broadcast(wanted) if wanted.count() <= few else wanted
        texts = own.withColumn("text_hash", F.xxhash64("_t")).join(wanted, "text_hash", "left_semi")
        texts = texts.groupBy("text_hash").agg(F.first("_t").alias("_t")).select("text_hash", _sets(F.col("_t"), words).alias("shingles"))
        return rows.join(texts, "text_hash")

    crowded = kept(crowded_of(members).where(F.col("size") > held))
    some = not crowded.isEmpty()
    tops = kept(_decided(with_shingles(dealt(members, "root", crowded if some else None, held, few), members.select("text_hash")), tenths))
    if some:  # parts of a component meet in the members that all of them have, then every two of them in a cell
        tops = united(tops)
        candidates = _candidates(members, tops, crowded, tenths, held, few)
        if not candidates.isEmpty():
            tops = united(tops.unionByName(_decided_between(with_shingles(candidates, candidates.select("text_hash").distinct()), tenths)))
    rooted = kept(nodes.join(tops, "node", "left").select("node", "least", F.coalesce("top", "node").alias("top")))
    ids = rooted.groupBy("top").agg(F.min("least").alias("first")).select(apart("top").alias("_top"), "first")
    firsts = rooted.join(ids, rooted["top"] == ids["_top"]).select("node", "first")
    return prints.join(firsts, "node").select(F.col("_id").alias(id_col), "text_hash", F.col("first._id").alias("component_id"), F.col("first.text_hash").alias("component_text_hash"))
