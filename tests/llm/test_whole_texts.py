"""What lies far into a text, and rows whose ids are null or repeated."""

import random

import corpus_pipeline as cp
from axisflow.llm import pii, toxicity

SF = "/root/testdata/sf0.001"


def test_training_texts_are_whole(spark, docs_of):
    labels = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, toxic int")
    docs = docs_of(*((i, "word " * 5000 + f"end{i}") for i in range(40)))
    texts, _ = toxicity.training_sample(docs, labels, 3000, 60_000_000, 5, "doc_id", "text", "toxic")
    assert len(texts) > 20 and all("end" in t for t in texts)
    few, _ = toxicity.training_sample(docs, labels, 3000, 100_000, 5, "doc_id", "text", "toxic")
    assert len(few) == 4 and all("end" in t for t in few)


def test_rows_are_told_apart_by_their_texts(spark, docs_of):
    rng = random.Random(4)
    text = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(100))
    one, two, three = text(), text(), text()
    docs = docs_of((1, one), (1, two), (1, two), (2, one), (3, three), (3, three + " tail"), (0, two))
    assert sorted((r["doc_id"], r["text"]) for r in cp.drop_near_copies(spark, docs, SF).collect() if r["doc_id"] != 3) == [(0, two), (1, one)]
    assert sum(r["doc_id"] == 3 for r in cp.drop_near_copies(spark, docs, SF).collect()) == 1
    leak = next(r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len(r["text"].split()) > 20)
    docs = docs_of((1, one), (1, leak), (None, leak), (None, two))
    assert sorted((r["text"] for r in cp.drop_benchmark_leaks(spark, docs, SF).collect())) == sorted([one, two])


def test_long_secrets_and_accounts_of_every_country_are_found():
    for n in (20, 200, 201, 5000):
        key = ("aB3" * n)[:n]
        assert [(x["kind"], x["end"] - x["start"]) for x in pii.spans_in(f"token {key} end", 0.5, 40)] == [("secret", n)]
    for account in ("GE29 NB00 0000 0101 9049 17", "BG80 BNBG 9661 1020 3456 78", "GR16 0110 1250 0000 0001 2300 695", "SA03 8000 0000 6080 1016 7519"):
        assert [x["kind"] for x in pii.spans_in(f"iban {account}.", 0.5, 40)] == ["iban"]
    assert pii.spans_in("iban BG81 BNBG 9661 1020 3456 78.", 0.5, 40) == []
