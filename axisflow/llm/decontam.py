"""Benchmark decontamination: size-partitioned MinHash containment search, verified on exact shingles.

Items are put into classes by their number of shingles. For each class, documents are cut into blocks of a length
suited to it, and the smallest hashes of each block are its MinHash sketch (bottom k). k is set so that a document that
holds the wanted share of an item's shingles shows one of them in a sketch but for the stated chance of a miss.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axisflow.llm.common import kept, text_or_empty

#: What lies between the words that are compared: lower-cased runs of letters and digits.
BETWEEN = r"[^\p{L}\p{N}]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), BETWEEN), "")


def with_shingle_hashes(df: DataFrame, words: str, n: int, out: str) -> DataFrame:
    """df with `out`: the hash of every n words in a row; empty where words are fewer."""
    df = df.withColumn("_h", F.transform(words, lambda w: F.xxhash64(w)))
    starts = F.slice("_h", F.lit(1), F.greatest(F.size("_h") - (n - 1), F.lit(0)))
    return df.withColumn(out, F.transform(starts, lambda x, i: F.xxhash64(x, *(F.get("_h", i + k) for k in range(1, n))))).drop("_h")


def exact_shingles(words: Column, n: int) -> Column:
    """The distinct shingles as texts. Read only where `words` is a stored column."""
    at = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.array_join(F.slice(words, i, n), " ")))


def sketch_length(block: int, least: int, threshold: float, miss: float) -> int:
    """How many of a block's smallest hashes to keep: each of the threshold * least shared shingles is kept with a
    chance of kept / block, and all are missed with a chance of `miss` at most."""
    shared = max(1, math.ceil(threshold * least))
    return min(block, math.ceil(block * (1 - miss ** (1 / shared))))


def marked(h: Column, c: int | Column) -> Column:
    """A hash that only agrees with hashes of the same class."""
    return h.bitwiseXOR(F.xxhash64(F.lit(c) if isinstance(c, int) else c))


def sketched(texts: DataFrame, classes: list[int], words: int, threshold: float, miss: float) -> DataFrame:
    """_id, _t, _hash: the marked hashes of the sketches of all blocks of every class.

    A document's sketches are one array, made where its hashes are, so no block is a row and a text's cost follows its
    length. Only what the next join finds is ever copied with its text."""
    d = texts.withColumn("_w", words_of(F.col("_t")))
    d = with_shingle_hashes(d, "_w", words, "_s").withColumn("_once", F.size(F.array_distinct("_s")) == F.size("_s"))

    def sketches(c: int, block_of) -> Column:
        block = 2 << c
        k = sketch_length(block, (1 << c) // 2 + 1, threshold, miss)
        at = F.sequence(F.lit(0), F.floor(F.greatest(F.size("_s") - 1, F.lit(0)) / block).cast("int"))
        least = F.flatten(F.transform(at, lambda i: F.slice(F.sort_array(block_of(F.slice("_s", i * block + 1, block))), F.lit(1), F.lit(k))))
        return F.transform(least, lambda h: marked(h, c))

    own = F.when(F.col("_once"), F.concat(*(sketches(c, lambda b: b) for c in classes))).otherwise(F.concat(*(sketches(c, F.array_distinct) for c in classes)))
    # outer, and no filter on arrays: Spark would put their whole definitions into a filter, once for every use of them
    return d.select("_id", "_t", own.alias("_k")).select("_id", "_t", F.explode_outer("_k").alias("_hash"))


def contained(docs: DataFrame, items: DataFrame, words: int = 5, threshold: float = 0.8, miss: float = 1e-6, few: int = 500_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc id, item id, n_shared, n_item, containment: pairs in which the document holds at least `threshold` of the
    item's distinct shingles of `words` words.

    Null texts are empty. Items of fewer than `words` words have no shingle and are in no pair. Rows that repeat an id
    count once a pair, with the largest containment; a null id is an id. Other columns aren't read; an empty table on
    either side gives no rows. Documents are read whole: every shingle lies in one block of each class.

    Items are the broadcast side, in turns of about `few` hashes (some 60 bytes each, with their shingles): more items
    mean more passes over the documents, never another plan. Documents' hashes are looked up where they are; only texts in
    which one is found are shuffled, once for each item, which spreads a passage that a third of all rows hold. No pair of
    documents is ever made.
    """
    held = items.select(F.col(item_col).alias("_item"), words_of(text_or_empty(item_text_col)).alias("_w"))
    held = with_shingle_hashes(held, "_w", words, "_s").withColumn("_s", F.array_distinct("_s"))
    held = kept(held.select("_item", "_s", exact_shingles(F.col("_w"), words).alias("_exact"), F.ceil(F.log2(F.greatest(F.size("_s"), F.lit(1)).cast("double"))).cast("int").alias("_class"))).where(F.size("_s") > 0)
    sizes = {r["_class"]: r["n"] for r in held.groupBy("_class").agg(F.sum(F.size("_s")).alias("n")).collect()}
    texts = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_t"))
    turns = max(1, -(-sum(sizes.values()) // few))

    def checked(own: DataFrame) -> DataFrame:
        index = own.select("_item", "_class", F.explode("_s").alias("_h")).select("_item", marked(F.col("_h"), F.col("_class")).alias("_hash"))
        found = sketched(texts, sorted(sizes), words, threshold, miss).join(F.broadcast(index), "_hash").select("_id", "_item", "_t").distinct()
        both = found.select("_id", F.col("_item").alias("_own"), words_of(F.col("_t")).alias("_w")).withColumn("_mine", exact_shingles(F.col("_w"), words))
        pairs = both.join(F.broadcast(own.select("_item", "_exact")), F.col("_own").eqNullSafe(F.col("_item")))
        return pairs.select("_id", "_item", F.size(F.array_intersect("_mine", "_exact")).cast("long").alias("n_shared"), F.size("_exact").cast("long").alias("n_item"))

    if sizes:
        each = [held.where(F.pmod(F.xxhash64("_exact"), F.lit(turns)) == i) for i in range(turns)] if turns > 1 else [held]
        scored = reduce(DataFrame.unionAll, map(checked, each))
    else:
        scored = texts.where(F.lit(False)).select("_id", F.lit(None).cast(items.schema[item_col].dataType).alias("_item"), F.lit(0).cast("long").alias("n_shared"), F.lit(1).cast("long").alias("n_item"))
    scored = scored.where(F.col("n_shared") >= F.ceil(threshold * F.col("n_item") - 1e-9))
    best = scored.groupBy("_id", "_item", "n_item").agg(F.max("n_shared").alias("n_shared"))
    return best.select(F.col("_id").alias(id_col), F.col("_item").alias(item_col), "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))
