"""Language-model scoring with a trigram model in Elias-Fano tries.

Texts are read once into blocks, a file each: distinct words as hashes, tokens as numbers of these. Words meet by hash
and get global numbers and counts. Then every (u, v, w) goes to the shard of its middle word v, where bigrams (v, w),
trigrams and contexts (u, v) are all counted; the shard builds its trie of the training ones and answers each block's
distinct trigrams with codes of their log10 probability, in the order they came in. What moves is packed by block and
shard, and each distinct word or trigram of a block moves once.

P(w | u v) = (c(uvw) + m3 P(w | v)) / (c(uv) + m3), P(w | v) = (c(vw) + m2 P(w)) / (c(v) + m2), P(w) = (c(w) + 1) / (N + V + 1).

A word v that is a context too often for one shard is split by u; its c(vw), which then no shard has whole, are counted
by an exchange of their own first.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from axisflow.llm.common import crc_mod, fresh_folder, kept, removed, some_at_a_time, text_or_empty, trimmed
from axisflow.llm.eliasfano import Trie
from axisflow.llm.flat import Words, mixed

#: Hash of the end token.
END = np.uint64(1)
#: Number of the contexts before the first token; words count from 1.
BEGIN = 0
#: Codes a unit of log10 in answers.
FINE = 2000


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value: their types and lengths, then their bytes, the first of all numbers first."""
    head = ";".join(f"{a.dtype.str},{len(a)}" for a in arrays).encode()
    planes = (np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(b"\n".join([head, b"".join(planes)]))


def unpacked(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    head, _, _ = raw.partition(b"\n")
    out, at = [], len(head) + 1
    for kind, n in (x.split(",") for x in head.decode().split(";")):
        kind, n = np.dtype(kind), int(n)
        planes = np.frombuffer(raw, dtype=np.uint8, count=n * kind.itemsize, offset=at)
        out.append(np.ascontiguousarray(planes.reshape(kind.itemsize, n).T).view(kind).reshape(n))
        at += n * kind.itemsize
    return out


def narrow(a: np.ndarray) -> np.ndarray:
    """The array in the narrowest unsigned type that holds it."""
    most = int(a.max()) if len(a) else 0
    return a.astype(next(t for t in ("u1", "u2", "u4", "u8") if most < 1 << 8 * int(t[1])))


def sums_by(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of the given sizes, none of them empty."""
    return np.add.reduceat(values, np.cumsum(sizes) - sizes) if len(sizes) else np.zeros(0)


def changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before in a column; true for the first row."""
    out = np.ones(len(columns[0]), dtype=bool)
    if len(out):
        out[1:] = False
        for c in columns:
            out[1:] |= c[1:] != c[:-1]
    return out


def order_of(*columns: np.ndarray) -> np.ndarray:
    """The order of rows by columns of numbers from 0, the first of most weight; ties in any order."""
    bits = [int(c.max()).bit_length() if len(c) else 0 for c in columns]
    if sum(bits) > 63:
        return np.lexsort(columns[::-1])
    key = np.zeros(len(columns[0]), dtype=np.uint64)
    for c, n in zip(columns, bits):
        key = key << np.uint64(n) | c.astype(np.uint64)
    return np.argsort(key)


def write_file(folder: str, sections: list[bytes]) -> str:
    """A new file of the sections, each after its length; its name. Files of lost attempts are named by no row."""
    system, path = pafs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    name = uuid.uuid4().hex
    with system.open_output_stream(f"{path}/{name}", compression=None) as out:
        for s in sections:
            out.write(len(s).to_bytes(8, "little") + s)
    return name


def read_sections(folder: str, name: str, *which: int) -> list[bytes]:
    system, path = pafs.FileSystem.from_uri(folder)
    out = {}
    with system.open_input_file(f"{path}/{name}") as data:
        for i in range(max(which) + 1):
            n = int.from_bytes(data.read(8), "little")
            if i in which:
                out[i] = data.read(n)
            else:
                data.seek(data.tell() + n)
    return [out[i] for i in which]


def blocks_of(docs: DataFrame, folder: str, chars: int, folds: int, out_fold: int, id_col: str, text_col: str) -> DataFrame:
    """block (numbers from 0), file, trained (training texts), words (distinct ones). A file's sections: distinct words
    (hashes, training counts), texts (held out, tokens of each, tokens as places of words), ids as JSON."""
    # ids travel as text: pandas would make floats of whole numbers beside a null
    source = docs.select(F.col(id_col).cast("string").alias("id"), (crc_mod(id_col, folds) == out_fold).alias("held"), text_or_empty(text_col).alias("text"))

    @trimmed
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, held, sizes, tokens, total, k = [], [], [], [], 0, 0

        def block() -> pd.DataFrame:
            n, out = np.concatenate(sizes), np.asarray(held)
            words, own = np.unique(np.concatenate(tokens), return_inverse=True)
            counts = np.bincount(own[np.repeat(~out, n)], minlength=len(words))
            file = write_file(folder, [packed(words, narrow(counts)), packed(out.astype("u1"), narrow(n), narrow(own)), zstandard.ZstdCompressor(level=1).compress(json.dumps(ids).encode())])
            one = {"part": TaskContext.get().partitionId(), "k": k, "file": file, "trained": int((~out).sum()), "words": len(words)}
            for x in (ids, held, sizes, tokens):
                x.clear()
            return pd.DataFrame([one])

        for batch in batches:
            for part in some_at_a_time(batch["text"]):
                w = Words.of(batch["text"].iloc[part].tolist())
                ends = np.cumsum(w.sizes + 1) - 1
                found = np.empty(len(w.start) + len(ends), dtype=np.uint64)
                inside = np.ones(len(found), dtype=bool)
                inside[ends] = False
                found[inside], found[ends] = w.hashes(), END
                tokens.append(found)
                sizes.append(w.sizes + 1)
                ids += batch["id"].iloc[part].tolist()
                held += batch["held"].iloc[part].tolist()
                total += len(w.data)
                if total >= chars:
                    yield block()
                    total, k = 0, k + 1
        if ids:
            yield block()

    found = kept(source.mapInPandas(read, "part int, k int, file string, trained long, words long"))
    counts = found.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition that was read
    starts = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return kept(found.join(F.broadcast(starts), "part").select((F.col("start") + F.col("k")).cast("int").alias("block"), "file", "trained", "words"))


def by_key(batches: Iterator[pd.DataFrame], key: str) -> Iterator[tuple[int, list]]:
    """(key, its rows) from rows sorted by key."""
    now, held = None, []
    for batch in batches:
        for r in batch.itertuples(index=False):
            k = getattr(r, key)
            if held and k != now:
                yield now, held
                held = []
            now = k
            held.append(r)
    if held:
        yield now, held


def counted(blocks: DataFrame, keys_of: Callable[[tuple], tuple[np.ndarray, np.ndarray]], shards: int) -> DataFrame:
    """block, shard, found (packed: each key's place within the shard and its count over all blocks, for the block's keys
    in the shard's range), and for each shard a row of block -1 whose found has its number of keys, of those with a
    count, and the sum of counts. keys_of(row): the block's distinct keys, sorted 64-bit hashes, and their counts there.

    A shard is a range of hashes; a block has at most one row for it, and none where it has no key, so rows never outnumber keys."""
    cuts = np.array([(i << 64) // shards for i in range(1, shards)], dtype=np.uint64)

    @trimmed
    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                keys, counts = keys_of(r)
                at = np.concatenate([[0], np.searchsorted(keys, cuts), [len(keys)]])
                full = np.flatnonzero(np.diff(at))
                yield pd.DataFrame({"shard": full.astype("int32"), "block": np.full(len(full), r.block, "int32"), "part": [packed(keys[at[s] : at[s + 1]], counts[at[s] : at[s + 1]]) for s in full.tolist()]})

    @trimmed
    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for shard, rows in by_key(batches, "shard"):
            parts = [unpacked(r.part) for r in rows]
            distinct, place = np.unique(np.concatenate([h for h, _ in parts]), return_inverse=True)
            counts = np.bincount(place, weights=np.concatenate([c for _, c in parts]), minlength=len(distinct)).astype(np.int64)
            ends = np.cumsum([len(h) for h, _ in parts])[:-1]
            found = [packed(narrow(p), narrow(counts[p])) for p in np.split(place, ends)]
            found.append(packed(np.array([len(distinct), (counts > 0).sum(), counts.sum()], dtype=np.int64)))
            yield pd.DataFrame({"block": np.array([*(r.block for r in rows), -1], "int32"), "shard": np.int32(shard), "found": found})

    parts = blocks.mapInPandas(split, "shard int, block int, part binary")
    return parts.repartitionById(shards, "shard").sortWithinPartitions("shard", "block").mapInPandas(merge, "block int, shard int, found binary")


def with_blocks(blocks: DataFrame, answers: DataFrame, n: int) -> DataFrame:
    """Each block's row (shard null) and its answers in order of shards, a partition for each of the n blocks."""
    null = F.lit(None)
    rows = blocks.select("block", null.cast("int").alias("shard"), null.cast("binary").alias("found"), *blocks.columns[1:])
    more = answers.select("block", "shard", "found", *(null.cast(blocks.schema[c].dataType).alias(c) for c in blocks.columns[1:]))
    return rows.unionAll(more).repartitionById(n, "block").sortWithinPartitions("block", "shard")


def spread(numbers: np.ndarray) -> np.ndarray:
    """Numbers made even by mixing their bits."""
    return mixed(numbers.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))


def pairs_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mixed(spread(v) + w.astype(np.uint64))


class Block:
    """A block's tokens with their words before: number, count of the words from the exchange, `texts` those of training."""

    def __init__(self, body: bytes, number: np.ndarray, count: np.ndarray, texts: int):
        self.held, sizes, own = unpacked(body)
        self.sizes = sizes.astype(np.int64)
        self.own, self.count = own, count
        first = np.cumsum(self.sizes) - self.sizes
        kind = np.int32 if len(number) and max(number.max(), count.max(), texts) < 1 << 31 else np.int64
        self.w = number.astype(kind)[own]
        self.v, self.u, self.seen = np.empty_like(self.w), np.empty_like(self.w), np.empty_like(self.w)
        self.v[1:], self.seen[1:] = self.w[:-1], count.astype(kind)[own[:-1]]
        self.v[first], self.seen[first] = BEGIN, texts
        self.u[1:] = self.v[:-1]
        self.u[first] = BEGIN

    def crowded(self, hot: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens after words that are contexts `hot` times or more; keys of the distinct pairs; the pair of each token."""
        at = np.flatnonzero(self.seen >= hot)
        keys, place = np.unique(pairs_key(self.v[at], self.w[at]), return_inverse=True)
        return at, keys, place

    def trained(self) -> np.ndarray:
        return np.repeat(self.held == 0, self.sizes)

    def arranged(self, shards: int, hot: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The order of tokens by shard, v, w and u, their shards, and where a trigram is another than the one before."""
        key = spread(self.v)
        crowded = self.seen >= hot
        key[crowded] = mixed(key[crowded] + spread(self.u[crowded]))
        shard = (key % np.uint64(shards)).astype(np.int64)
        # places of words in the block are in the order of their numbers, and shorter
        w = self.own.astype(np.int64) + 1
        v, u = np.zeros_like(w), np.zeros_like(w)
        first = np.cumsum(self.sizes) - self.sizes
        v[1:] = w[:-1]
        v[first] = BEGIN
        u[1:] = v[:-1]
        u[first] = BEGIN
        order = order_of(shard, v, w, u)
        shard = shard[order]
        return order, shard, changes(shard, self.v[order], self.w[order], self.u[order])

    def parts(self, shards: int, hot: int, given: np.ndarray, tokens: int) -> list[tuple[int, bytes]]:
        """(shard, its contexts, pairs and trigrams of this block, packed). given: c(vw) of the pairs of crowded()."""
        at, _, place = self.crowded(hot)
        whole = np.zeros(len(self.w), dtype=np.int64)
        whole[at] = given[place]
        order, shard, new = self.arranged(shards, hot)
        trained = sums_by(self.trained()[order].astype(np.int64), np.diff(np.append(np.flatnonzero(new), len(new))))
        order, shard = order[new], shard[new]
        v, w, u = self.v[order], self.w[order], self.u[order]
        new_context, new_pair = changes(shard, v), changes(shard, v, w)
        pair, context = np.flatnonzero(new_pair), np.flatnonzero(new_context)
        code = np.rint(np.log10(self.count[self.own[order[pair]]] + 1.0) * (255 / math.log10(tokens + 2))).astype("u1")
        triples_of = np.diff(np.append(pair, len(v)))
        pairs_of = np.diff(np.append(np.searchsorted(pair, context), len(pair)))
        bounds = [np.searchsorted(x, np.arange(shards + 1)) for x in (shard[context], shard[pair], shard)]
        out = []
        for s in np.unique(shard).tolist():
            c, p, t = (slice(b[s], b[s + 1]) for b in bounds)
            own = v[context[c]]
            out.append((s, packed(narrow(np.diff(own, prepend=0)), narrow(self.seen[order[context[c]]]), narrow(pairs_of[c]), narrow(w[pair[p]]), code[p], narrow(whole[order[pair[p]]]), narrow(triples_of[p]), narrow(u[t]), narrow(trained[t]))))
        return out

    def scores(self, shards: int, hot: int, codes: np.ndarray) -> np.ndarray:
        """Each text's log10 probability; codes: the answers for the trigrams in their order."""
        order, _, new = self.arranged(shards, hot)
        log = np.empty(len(order))
        log[order] = codes[np.cumsum(new) - 1] / -FINE
        return sums_by(log, self.sizes)


def read_part(part: bytes) -> dict[str, np.ndarray]:
    """A part's arrays: context, seen, of contexts; v_of, word, code, given, of pairs; pair_of, before, trained, of trigrams."""
    gaps, seen, pairs_of, word, code, given, triples_of, before, trained = (a.astype(np.int64) for a in unpacked(part))
    return {
        "context": np.cumsum(gaps), "seen": seen, "v_of": np.repeat(np.arange(len(gaps)), pairs_of), "word": word, "code": code, "given": given,
        "pair_of": np.repeat(np.arange(len(word)), triples_of), "before": before, "trained": trained,
    }


def shard_trie(parts: list[bytes], m2: float, m3: float, tokens: int, distinct: int, bits: int) -> Trie:
    """The trie of a shard's training n-grams with their smoothed probabilities and the weights of contexts."""
    contexts, pairs, triples = [], [], []
    for p in parts:
        x = read_part(p)
        known, t = x["seen"] > 0, x["trained"] > 0
        contexts.append(np.stack([x["context"][known], x["seen"][known]]))
        v = x["context"][x["v_of"]]
        own = x["given"] > 0
        own[x["pair_of"][t]] = True
        pairs.append(np.stack([v[own], x["word"][own], x["given"][own], x["code"][own]]))
        pair = x["pair_of"][t]
        triples.append(np.stack([v[pair], x["word"][pair], x["before"][t], x["trained"][t]]))
    v, seen = np.concatenate(contexts, axis=1)
    v, at = np.unique(v, return_index=True)
    seen = seen[at]
    pv, pw, given, code = np.concatenate(pairs, axis=1)
    order = order_of(pv, pw)
    order = order[changes(pv[order], pw[order])]
    pv, pw, given, code = pv[order], pw[order], given[order], code[order]
    tv, tw, tu, times = np.concatenate(triples, axis=1)
    order = order_of(np.searchsorted(v, tv), tw, tu)
    tv, tw, tu, times = tv[order], tw[order], tu[order], times[order]
    new = np.flatnonzero(changes(tv, tw, tu))
    times = np.add.reduceat(times, new) if len(new) else times
    tv, tw, tu = tv[new], tw[new], tu[new]
    new = changes(tv, tw)
    # each trigram's pair: pairs hold all of them, in the same order
    pair = np.searchsorted(np.searchsorted(v, pv) << 40 | pw, np.searchsorted(v, tv[new]) << 40 | tw[new])[np.cumsum(new) - 1] if len(tv) else np.zeros(0, np.int64)
    count = np.maximum(given, np.bincount(pair, weights=times, minlength=len(pv)).astype(np.int64))
    parent = np.searchsorted(v, pv)
    alone = 10 ** (code * (math.log10(tokens + 2) / 255)) / (tokens + distinct + 1)
    p2 = (count + m2 * alone) / (seen[parent] + m2)
    order = order_of(np.searchsorted(v, tv), tu, pair)
    tv, tu, pair, times = tv[order], tu[order], pair[order], times[order]
    new = changes(tv, tu)
    node = np.cumsum(new) - 1
    whole = np.bincount(node, weights=times, minlength=int(new.sum())) if len(node) else np.zeros(0)
    p3 = (times + m3 * p2[pair]) / (whole[node] + m3)
    first = np.searchsorted(parent, np.arange(len(v)))
    log = np.log10
    return Trie(v, log(m2 / (seen + m2)), parent, pw, log(p2), np.searchsorted(v, tv[new]), tu[new], log(m3 / (whole + m3)), node, pair - first[parent[pair]], log(p3), bits)


def answers_of(trie: Trie, part: bytes, tokens: int, distinct: int) -> np.ndarray:
    """Codes of the log10 probabilities of a part's trigrams."""
    x = read_part(part)
    alone = x["code"] * (math.log10(tokens + 2) / 255) - math.log10(tokens + distinct + 1)
    log = trie.values(x["context"], x["v_of"], x["word"], alone, x["pair_of"], x["before"])
    return np.rint(np.clip(-FINE * log, 0, 65535)).astype("u2")


def score_texts(docs: DataFrame, m2: float = 1000.0, m3: float = 3.0, folds: int = 7, out_fold: int = 2, shards: int | None = None, block_chars: int = 8_000_000, bits: int = 8, shard_tokens: int = 1_500_000, shard_words: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text", tries: str | None = None) -> DataFrame:
    """One row per input row: the id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows with crc32(id) modulo `folds` other than `out_fold` train the model, all are scored. A null text is empty: its
    one token is the end. Repeated rows each count and keep their row; a null id counts as the empty text for the fold;
    other columns aren't read; an empty table gives no rows. Words are told apart by 64-bit hashes. base_score is exact;
    in score, the logarithms that the tries hold have 2**bits levels, the single words' 256.

    A task holds one block (about `block_chars` characters or one text) or one shard; without `shards`, there are as many
    as shuffle partitions, and at least one for `shard_words` of the blocks' distinct words or `shard_tokens` training tokens. The
    driver gets three numbers a shard. With `tries`, a folder, each shard's trie is also written there, as a file named by its number.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType
    folder = fresh_folder(spark, "lm")
    blocks = blocks_of(docs, folder, block_chars, folds, out_fold, id_col, text_col)
    n, texts, all_words = blocks.agg(F.count(F.lit(1)), F.coalesce(F.sum("trained"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    n = max(n, 1)
    parallel = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    word_shards = shards or max(parallel, all_words // shard_words)

    def words_in(r) -> tuple[np.ndarray, np.ndarray]:
        hashes, counts = unpacked(read_sections(folder, r.file, 0)[0])
        return hashes, counts

    words = kept(counted(blocks.select("block", "file"), words_in, word_shards))
    totals = {r["shard"]: unpacked(r["found"])[0] for r in words.where("block = -1").collect()}
    per_shard = np.array([totals.get(s, np.zeros(3, np.int64)) for s in range(word_shards)])
    base = np.cumsum(per_shard[:, 0]) - per_shard[:, 0] + 1
    distinct, tokens = int(per_shard[:, 1].sum()), int(per_shard[:, 2].sum())
    pair_shards = shards or max(parallel, tokens // shard_tokens)
    hot = max(2, tokens // (2 * pair_shards))

    @trimmed
    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block, rows in by_key(batches, "block"):
            found = [(int(r.shard), *unpacked(r.found)) for r in rows if r.found is not None]
            own = np.concatenate([p.astype(np.int64) + base[s] for s, p, _ in found])
            numbers = write_file(folder, [packed(narrow(own), narrow(np.concatenate([c for *_, c in found])))])
            yield pd.DataFrame({"block": [block], "file": [next(r.file for r in rows if r.found is None)], "numbers": [numbers]})

    numbered = kept(with_blocks(blocks.select("block", "file"), words.where("block >= 0"), n).mapInPandas(number, "block int, file string, numbers string"))

    def block_of(r) -> Block:
        numbers, counts = unpacked(read_sections(folder, r.numbers, 0)[0])
        return Block(read_sections(folder, r.file, 1)[0], numbers, counts, texts)

    def crowded_in(r) -> tuple[np.ndarray, np.ndarray]:
        b = block_of(r)
        at, keys, place = b.crowded(hot)
        return keys, narrow(np.bincount(place, weights=b.trained()[at], minlength=len(keys)).astype(np.int64))

    @trimmed
    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block, rows in by_key(batches, "block"):
            given = np.concatenate([np.zeros(0, np.int64), *(unpacked(r.found)[1].astype(np.int64) for r in rows if r.found is not None)])
            out = block_of(next(r for r in rows if r.found is None)).parts(pair_shards, hot, given, tokens)
            yield pd.DataFrame({"shard": np.array([s for s, _ in out], "int32"), "block": np.int32(block), "part": [p for _, p in out]})

    @trimmed
    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for shard, rows in by_key(batches, "shard"):
            trie = shard_trie([r.part for r in rows], m2, m3, tokens, distinct, bits)
            if tries:
                trie.write(tries, f"{shard}.trie")
            yield pd.DataFrame({"block": np.array([r.block for r in rows], "int32"), "shard": np.int32(shard), "found": [packed(answers_of(trie, r.part, tokens, distinct)) for r in rows]})

    @trimmed
    def total(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, rows in by_key(batches, "block"):
            top = next(r for r in rows if r.found is None)
            b = block_of(top)
            ids = json.loads(zstandard.ZstdDecompressor().decompress(read_sections(folder, top.file, 2)[0]))
            share = np.log10((b.count + 1.0) / (tokens + distinct + 1))
            score = b.scores(pair_shards, hot, np.concatenate([unpacked(r.found)[0] for r in rows if r.found is not None]))
            known, exact = sums_by((b.count > 0)[b.own].astype(np.int64), b.sizes), sums_by(share[b.own], b.sizes)
            yield pd.DataFrame({"id": pd.Series(ids, dtype=object), "held_out": b.held.astype(bool), "n_tokens": b.sizes, "n_known": known, "train_tokens": tokens, "base_score": exact, "score": score})

    given = counted(numbered, crowded_in, parallel).where("block >= 0")
    parts = with_blocks(numbered, given, n).mapInPandas(emit, "shard int, block int, part binary")
    answered = parts.repartitionById(pair_shards, "shard").sortWithinPartitions("shard", "block").mapInPandas(answer, "block int, shard int, found binary")
    done = kept(with_blocks(numbered, answered, n).mapInPandas(total, "id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"))
    removed(spark, folder)
    return done.select(F.col("id").cast(kind).alias(id_col), *done.columns[1:])
