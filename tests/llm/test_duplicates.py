"""Near copies, components and benchmark leaks against brute force."""

import random

import numpy as np
import pytest
import regex
import xxhash

from axisflow.llm import decontam, queries, simhash
from axisflow.llm.graph import components
from tests.compare import oracle, same
from tests.llm.conftest import LONG, ODD

SF = "/root/testdata/sf0.001"


def plain_fingerprint(t, words=4):
    w = [x for x in regex.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t)) if x]
    shingles = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or ([" ".join(w)] if w else [])
    counts = np.zeros(64, dtype=np.int64)
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        counts += [h >> b & 1 for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def plain_components(ids, linked, pairs=None):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in pairs if pairs is not None else ((i, j) for i in range(len(ids)) for j in range(i) if linked(i, j)):
        a, b = sorted((find(i), find(j)))
        parent[b] = a
    groups = {}
    for i, own in enumerate(ids):
        groups.setdefault(find(i), []).append(own)
    return [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(ids))]


def close(fps, bits):
    return lambda i, j: (fps[i] ^ fps[j]).bit_count() <= bits


def test_every_row_by_brute_force(spark, odd):
    rows = simhash.near_duplicates(odd).collect()
    fps = [plain_fingerprint(t or "") for _, t in ODD]
    want = plain_components([i for i, _ in ODD], close(fps, 4))
    expected = sorted(((i, f"{f:016x}", c) for (i, _), f, c in zip(ODD, fps, want)), key=repr)
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows), key=repr) == expected


def test_documents_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = sorted(texts)
    fps = [plain_fingerprint(texts[i]) for i in ids]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert [got[i] for i in ids] == plain_components(ids, close(fps, 4))
    wide = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs, bits=9, bucket=64).collect()}
    assert [wide[i] for i in ids] == plain_components(ids, close(fps, 9))


def test_masks_catch_every_close_pair():
    rng = random.Random(2)
    for bits, n, bucket in ((4, 100, 1), (4, 1 << 20, 1), (4, 1 << 30, 1), (8, 1 << 18, 64)):
        masks = simhash.block_masks(simhash.blocks_for(n, bits, bucket), bits)
        for _ in range(300):
            diff = sum(1 << b for b in rng.sample(range(64), rng.randint(0, bits)))
            assert any(diff & (m % (1 << 64)) == 0 for m in masks)


def test_a_dense_group_gives_a_forest(spark):
    rng = random.Random(3)
    base = rng.getrandbits(64)
    fps = {base}
    for _ in range(3000):
        fps.add(base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f, f) for f in signed], "node long, fp long")
    links = simhash.links_of(nodes, 4, len(fps), 1, None)
    assert links.count() < 5 * len(fps)
    split = components(simhash.links_of(nodes, 4, len(fps), 1, None, crowd=500), "a", "b")
    assert {r["root"] for r in split.collect()} == {min(signed)} and split.count() == len(fps) - 1
    roots = components(links, "a", "b")
    assert {r["root"] for r in roots.collect()} == {min(signed)} and roots.count() == len(fps) - 1


def test_a_group_that_shares_a_key_by_chance_is_split_by_further_bits():
    rng = np.random.default_rng(9)
    fp = rng.integers(0, 1 << 40, 6000, dtype=np.uint64)
    fp[3000:] = fp[:3000] ^ (np.uint64(1) << rng.integers(0, 40, 3000).astype(np.uint64))
    longs = np.zeros((len(fp), 0), dtype=np.uint64)
    plain = simhash.spanning(fp, longs, 4, None, None)
    for patience in (1, 64):
        found = simhash.spanning(fp, longs, 4, None, patience)
        assert all((np.bitwise_count(fp[a] ^ fp[b]) <= 4).all() for a, b in found)
        groups = [plain_components(range(len(fp)), None, [(int(x), int(y)) for a, b in links for x, y in zip(a, b)]) for links in (plain, found)]
        assert groups[0] == groups[1]


def test_chains_and_stars_become_components(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    edges = spark.createDataFrame([*chain, *star, (5, 5), (None, 3), (2000, 2001), (2001, 2000)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{1000 + i: 1000 for i in range(1, 300)}, 2001: 2000}
    assert components(edges.where("false"), "a", "b").count() == 0


def test_empty_table(empty):
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.near_duplicates(empty, words=2, bits=8, bucket=64, check=simhash.Check()).count() == 0


def test_check_keeps_unlike_texts_apart(spark, docs_of):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows, want = [], {}
    for g in range(30):
        base = [word() for _ in range(200)]
        for k in range(4):
            own = list(base)
            for p in rng.sample(range(200), k):
                own[p] = word()
            rows.append((10 * g + k, " ".join(own)))
            want[10 * g + k] = 10 * g
    got = simhash.near_duplicates(docs_of(*rows), words=2, bits=8, bucket=64, check=simhash.Check()).collect()
    assert all(r["component_id"] // 10 == r["doc_id"] // 10 for r in got)
    assert sum(r["component_id"] == want[r["doc_id"]] for r in got) >= 0.95 * len(want)


def shingles(t):
    w = regex.findall(r"[\p{L}\p{N}]+", t.lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def plain_leaks(docs, items):
    out = set()
    for d, t in docs:
        mine = shingles(t or "")
        for i, x in items:
            own = shingles(x or "")
            if own and len(own & mine) >= 0.8 * len(own) - 1e-9:
                out.add((d, i, len(own & mine), len(own)))
    return out


def test_leaks_by_brute_force(spark, docs_of):
    rng = random.Random(11)
    word = lambda: rng.choice(["alpha", "beta", "Gamma", "δέλτα", "epsilon"]) + str(rng.randrange(400))
    items = [(i, " ".join(word() for _ in range(rng.randint(1, 150)))) for i in range(40)] + [(40, None), (41, ""), (42, "one two three four"), (None, " ".join(word() for _ in range(20))), (43, "same " * 30), (43, "same " * 30)]
    docs = list(ODD)
    for d in range(100, 180):
        own = [word() for _ in range(rng.randint(0, 3000))]
        for _, x in rng.sample(items[:40], rng.randint(0, 3)):
            part = x.split()
            for p in range(len(part)):
                if rng.random() < 0.03:
                    part[p] = word()
            at = rng.randint(0, len(own))
            own[at:at] = [p.upper() + "," if rng.random() < 0.3 else p for p in part]
        docs.append((d, " ".join(own)))
    docs += [(181, items[43][1]), (None, items[5][1]), (182, "Same, " * 500)]
    for few in (500_000, 700):  # one turn, and several
        got = decontam.contained(docs_of(*docs), spark.createDataFrame(items, "item_id long, text string").repartition(2), few=few).collect()
        assert {(r["doc_id"], r["item_id"], r["n_shared"], r["n_item"]) for r in got} == plain_leaks(docs, items)
        assert len(got) == len(plain_leaks(docs, items))


def test_leaks_of_empty_tables(spark, docs_of, empty):
    items = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert decontam.contained(empty, items).count() == 0
    assert decontam.contained(docs_of((1, LONG)), items.where("false")).count() == 0


def test_the_plan_has_no_python(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    plan = decontam.contained(docs, items)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian"))


def test_sketches_are_long_enough():
    for c in range(12):
        block, least = 2 << c, (1 << c) // 2 + 1
        k = decontam.sketch_length(block, least, 0.8, 1e-6)
        assert 0 < k <= block and (k == block or (1 - k / block) ** -(-8 * least // 10) <= 1e-6)


@pytest.mark.parametrize("name", ["op4_minhash_containment", "op5_distribution_divergence"])
def test_query_equals_sql(spark, name):
    same(queries.queries()[name](spark, SF).toPandas(), oracle(SF, queries.oracle_sql()[name]))
