"""The stages, each against what it should keep."""

import random

import pytest

import corpus_pipeline as cp
from axisflow.llm import pii
from tests.llm.test_duplicates import plain_leaks

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_names():
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_dedup", "decontamination", "pii", "packing"]
    assert cp.ORACLE_SQL is None


def test_toxic_documents_go_and_clean_ones_stay(spark):
    sf = SF.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r["doc_id"] for r in cp.drop_toxic(spark, docs, sf).select("doc_id").collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    clean, toxic = [r["doc_id"] in kept for r in labels if not r["toxic"]], [r["doc_id"] in kept for r in labels if r["toxic"]]
    assert sum(clean) >= 0.98 * len(clean) and sum(toxic) <= 0.4 * len(toxic)  # some 40 toxic texts to learn from


def test_one_of_each_group_of_copies_stays(spark, docs_of):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows = []
    for g in range(20):
        base = [word() for _ in range(150)]
        near = list(base)
        near[70] = word()
        rows += [(10 * g + 3, " ".join(base)), (10 * g + 1, " ".join(base)), (10 * g + 2, " ".join(near)), (10 * g + 5, " ".join(word() for _ in range(150)))]
    rows += [(11, rows[5][1]), (None, "a text without an id"), (None, rows[0][1])]
    out = cp.drop_near_copies(spark, docs_of(*rows), SF).collect()
    assert sorted(r["doc_id"] for r in out if r["doc_id"] is not None) == sorted([10 * g + k for g in range(20) for k in (1, 5)])
    assert [r["text"] for r in out if r["doc_id"] is None] == ["a text without an id"]  # the other is a copy of the first


def test_leaks_go(spark, docs):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    all_docs = [(r["doc_id"], r["text"]) for r in docs.collect()]
    leaks = {d for d, *_ in plain_leaks(all_docs, items)}
    out = cp.drop_benchmark_leaks(spark, docs, SF)
    assert out.columns == COLUMNS and {r["doc_id"] for r in out.collect()} == {d for d, _ in all_docs} - leaks and leaks


def test_personal_data_is_replaced(spark, docs):
    out = cp.redact_pii(spark, docs, SF)
    assert out.columns == COLUMNS
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in out.collect():
        found = pii.spans_in(before[r["doc_id"]], 0.5, 40)
        assert r["text"] == pii.redacted(before[r["doc_id"]], found) and r["n_chars"] == len(r["text"])


def test_run(spark):
    rows = cp.run(spark, SF)
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and rows.count() > 100


@pytest.mark.parametrize("k", range(5))
def test_odd_and_empty_rows(spark, odd, empty, k):
    name, stage = cp.STAGES[k]
    out = stage(spark, odd, SF)
    if name != "packing":
        assert out.columns == odd.columns
    assert {r["doc_id"] for r in out.select("doc_id").collect()} <= {1, 2, 3, 4, 5, 6, 7, None} and out.count() > 0
    assert stage(spark, empty, SF).count() == 0
