"""The queries of the text operators, with production parameters, and their SQL."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F

from axisflow.llm import decontam, lm, packing, pii, quality, simhash, sql, token_counts, toxicity, urls, warc
from axisflow.llm.common import table


def op1_token_counts(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_warc_normaliser(spark, sf_dir):
    return warc.archive_pages(table(spark, sf_dir, "pages"), least=100)


def op3_pii_spans(spark, sf_dir):
    return pii.find_pii(table(spark, sf_dir, "documents")).drop("scored")


def op4_minhash_containment(spark, sf_dir):
    return decontam.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_distribution_divergence(spark, sf_dir):
    return quality.judge(table(spark, sf_dir, "documents")).drop("class_distance", "word_distance")


def op9_crf_toxicity(spark, sf_dir):
    scored = toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    offsets = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return scored.withColumn("spans", offsets)


def op10_elias_fano_lm(spark, sf_dir):
    return lm.score_texts(table(spark, sf_dir, "documents"))


#: The rules of op6: host, path, verdict.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op6_url_range_join(spark, sf_dir):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge_urls(table(spark, sf_dir, "pages"), rules, otherwise="allow")


def op7_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, bits=4, seed=42)


QUERIES = (op1_token_counts, op2_warc_normaliser, op3_pii_spans, op4_minhash_containment, op5_distribution_divergence, op6_url_range_join, op7_best_fit_packing, op8_simhash_near_dedup, op9_crf_toxicity, op10_elias_fano_lm)


def queries() -> dict:
    return {**{q.__name__: q for q in QUERIES}, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    return {"op2_warc_normaliser": sql.OP2, "op4_minhash_containment": sql.OP4, "op5_distribution_divergence": sql.op5(), "op6_url_range_join": sql.OP6}
