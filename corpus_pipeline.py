"""From raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents. A stage drops rows for their texts: rows that share a
doc_id, or have none, are told apart by their texts. Columns beside those of documents go through unread.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axisflow.llm import decontam, jaccard, packing, pii, toxicity
from axisflow.llm.common import kept, removed, stored, table, text_or_empty

#: Keys to drop are broadcast up to this many, at 16 bytes each; beyond, the join is an ordinary one.
FEW = 1_000_000


def joined(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """docs left_anti or left_semi rows of `keys` that agree in all columns of keys, null with null."""
    own = keys.select(*(F.col(c).alias(f"_key{i}") for i, c in enumerate(keys.columns)))
    own = F.broadcast(own) if own.count() <= FEW else own
    return docs.join(own, reduce(and_, (F.col(c).eqNullSafe(F.col(f"_key{i}")) for i, c in enumerate(keys.columns))), how).select(docs.columns)


def with_text_hash(docs: DataFrame) -> DataFrame:
    """docs with text_hash, which tells rows apart whose doc_id repeats or is null."""
    return docs.withColumn("text_hash", F.xxhash64(text_or_empty("text")))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from the labels, doesn't reject.

    The score is of the text alone: null and empty texts get that of a text without words, repeated rows get the same,
    a null doc_id doesn't matter but that its label can't be learned. An empty table gives no rows; without labels, or
    with clean ones only, all rows stay."""
    model = spark.sparkContext.broadcast(toxicity.train(docs, table(spark, sf_dir, "labels")))
    rows = docs.select(F.struct(*docs.columns).alias("row"), toxicity.scored(text_or_empty("text"), model).alias("tagged"))
    return rows.where("tagged.score < 0.5").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least doc_id, of each group of near copies.

    Near copies have a Jaccard similarity of at least 0.8 over five words: pigeonhole blocks of their SimHashes propose
    pairs, as in op8, bands of MinHashes those whose SimHashes differ in more bits, shingles decide. Rows that repeat a doc_id are told apart by their texts; of rows with the same of both one stays, as of
    several rows of a group with the least doc_id that with the least text hash. A null doc_id is larger than any other.
    Null, empty and blank texts are one group. An empty table gives no rows.
    """
    found = kept(jaccard.near_copies(docs).withColumn("stays", F.expr("doc_id <=> component_id AND text_hash = component_text_hash")))
    hashed, rows = with_text_hash(docs), found.select("doc_id", "text_hash", "stays")
    left = joined(hashed, kept(rows.where("NOT stays").select("doc_id", "text_hash").distinct()), "left_anti")
    repeated = kept(rows.where("stays").groupBy("doc_id", "text_hash").count().where("count > 1").drop("count"))
    if not repeated.isEmpty():
        left = joined(left, repeated, "left_anti").unionByName(joined(left, repeated, "left_semi").dropDuplicates(["doc_id", "text_hash"]))
    return left.select(docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't hold a benchmark item, whatever their doc_id; null and empty texts hold none.

    All rows with a text that holds one go, repeated or not. An empty table gives no rows, an empty benchmark all."""
    hashed = with_text_hash(docs)
    leaks = decontam.contained(hashed, table(spark, sf_dir, "benchmark"), id_col="text_hash")
    return joined(hashed, kept(leaks.select("text_hash").distinct()), "left_anti").select(docs.columns)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind, and n_chars of the text that is left.

    A null text stays null and has null n_chars; every row stays, also repeated ones and those without a doc_id; where
    spans overlap, they become one, named by the first. An empty table gives no rows."""
    clean = docs.withColumn("text", pii.redact(F.col("text")))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else clean


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' ids and their places in sequences of 4096.

    A null or empty text is one piece, the end id alone; repeated rows and null ids are pieces of their own; pieces of
    one length are interchangeable. An empty table gives no rows."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_copies), ("decontamination", drop_benchmark_leaks), ("pii", redact_pii), ("packing", pack_sequences)]

#: Neither the model nor the fingerprints nor the tokenizer can be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, from the table documents. What a stage has written goes when the next has read it."""
    docs, path = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        before = path
        docs, path = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before:
            removed(spark, before)
    return docs
