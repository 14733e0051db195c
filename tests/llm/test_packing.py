import random
import time
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from axisflow.llm import packing
from tests.llm.conftest import ODD

PATH = public_tokenizers.path("word_bpe_49k.json")


def sequences(patterns):
    return [items for items, m in patterns for _ in range(m)]


@pytest.mark.parametrize("seed", range(6))
def test_patterns_use_every_piece_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 4096])
    histogram = {rng.randint(1, capacity): rng.choice([1, 2, 7, 1000]) for _ in range(rng.randint(1, 200))}
    used = defaultdict(int)
    for items, m in packing.plan_patterns(histogram, capacity):
        assert sum(items) <= capacity and m > 0
        for x in items:
            used[x] += m
    assert dict(used) == histogram


def test_exact_complements_are_found():
    singles = packing.plan_patterns({6: 2, 4: 2}, 10)
    assert sequences(singles) == [[6, 4], [6, 4]]
    assert len(sequences(packing.plan_patterns({5: 1, 3: 1, 2: 1, 4: 1, 6: 1}, 10))) == 2
    assert len(sequences(packing.plan_patterns({7: 1, 1: 3}, 10))) == 1  # a triple
    assert len(sequences(packing.plan_patterns({1: 1_000_000}, 10))) == 100_000
    assert packing.plan_patterns({}, 10) == []


def check(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pack(spark, odd, empty):
    library = Tokenizer.from_file(PATH)
    rows = packing.pack(odd, PATH, capacity=64).collect()
    want = defaultdict(int)
    for i, t in ODD:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 64):
            want[i, k // 64, k, len(ids[k : k + 64]), zlib.crc32(packing.as_bytes(ids[k : k + 64]))] += 1
    got = defaultdict(int)
    for r in rows:
        got[r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]] += 1
    assert got == want
    total = sum(r["length"] for r in rows)
    assert check(rows, 64) <= -(-total // 64) + 1
    assert packing.pack(empty, PATH).count() == 0


def test_pack_reaches_the_lower_bound(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = packing.pack(docs, PATH).collect()
    assert check(rows, 4096) <= -(-sum(r["length"] for r in rows) // 4096) + 1


def test_what_is_remembered_costs_nothing_for_further_texts():
    ids = packing.ChunkIds(PATH, 2_000_000)
    ids.known.update((f"chunk{i}", b"") for i in range(1_000_000))
    want = ids.raw("Two words, twice.")
    began = time.process_time()
    assert all(got == want for _ in range(300) for got in ids.of(["Two words, twice."]))
    assert time.process_time() - began < 1
