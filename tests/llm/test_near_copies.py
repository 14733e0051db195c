"""Near copies by exact Jaccard similarity, with replaced and appended passages."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as cp
from axisflow.llm import jaccard

SF = "/root/testdata/sf0.001"


def similarity(a, b):
    x, y = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def edited(n=150, seed=5):
    """Pairs of similarity 0.8 to 0.85 by one replaced or appended passage; then pairs of 0.7 to 0.79."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    near, far = [], []
    for g in range(n):
        base = [word() for _ in range(rng.randint(80, 500))]
        for found, (low, high) in ((near, (0.8, 0.85)), (far, (0.7, 0.79))):
            for k in range(1, len(base)):
                new = [word() for _ in range(k)]
                other = base + new if g % 2 else base[:20] + new + base[20 + k :]
                if similarity(" ".join(base), " ".join(other)) < high:
                    break
            assert low <= similarity(" ".join(base), " ".join(other)) < high
            found.append((" ".join(base), " ".join(other)))
    return near, far


def test_recall_of_replaced_and_appended_passages(spark, docs_of):
    near, far = edited()
    rows = [(2 * i + k, t) for i, pair in enumerate(near) for k, t in enumerate(pair)]
    out = {r["doc_id"] for r in cp.drop_near_copies(spark, docs_of(*rows), SF).collect()}
    assert {2 * i for i in range(len(near))} <= out
    assert sum(2 * i + 1 not in out for i in range(len(near))) >= 0.99 * len(near)
    rows = [(2 * i + k, t) for i, pair in enumerate(far) for k, t in enumerate(pair)]
    assert cp.drop_near_copies(spark, docs_of(*rows), SF).count() == len(rows)


def test_links_chain_and_members_are_compared_with_all(spark, docs_of):
    word = lambda i: f"w{i}"
    # steps of 10 words of 200: neighbours have 0.9, ends much less
    rows = [(i, " ".join(map(word, range(10 * i, 10 * i + 200)))) for i in range(12)]
    for few in (jaccard.FEW, 0):
        got = jaccard.near_copies(docs_of(*rows, (50, "other"), (51, ""), (52, None), (53, "OTHER")), few=few).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == {**{i: 0 for i in range(12)}, 50: 50, 53: 50, 51: 51, 52: 51}


def test_crowded_groups_are_dealt_out(spark, docs_of):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base, rows = [word() for _ in range(100)], []
    for i in range(400):
        own = list(base)
        own[rng.randrange(100)] = word()
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, " ".join(word() for _ in range(60))) for i in range(50)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_copies(docs_of(*rows), crowd=64, held=4000).collect()}
    assert all(got[i] == (0 if i < 400 else i) for i in got)


def test_pairs_inside_a_crowded_loose_group_are_found(spark, docs_of):
    # all texts share 100 words, so they are loosely alike; only the two of a pair share their last 25 words too
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base, rows = [word() for _ in range(100)], []
    for i in range(250):
        own = base + [word() for _ in range(25)]
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join([*own, word()]))]
    assert similarity(rows[0][1], rows[2][1]) < 0.8 <= similarity(rows[0][1], rows[1][1])
    for few in (jaccard.FEW, 0):
        got = {r["doc_id"]: r["component_id"] for r in jaccard.near_copies(docs_of(*rows), held=30_000, few=few).collect()}
        assert got == {i: i - i % 2 for i in got}


def test_no_pair_is_left_out_where_all_bands_are_crowded(spark, docs_of, monkeypatch):
    # all texts have one band and no other, and nearly none goes to all parts; the two of a pair alone are alike: of the first
    # 60 texts all are one loose group, dealt out by `held`, of the others a pair is a group, proposed by the dealt-out band
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base, rows = [word() for _ in range(100)], []
    for i in range(100):
        own, more = (base + [word() for _ in range(25)], 1) if i < 30 else ([word() for _ in range(100)], 20)
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join([*own, *(word() for _ in range(more))]))]
    assert similarity(rows[0][1], rows[2][1]) < 0.8 <= similarity(rows[98][1], rows[99][1])
    real = jaccard._prints
    monkeypatch.setattr(jaccard, "_prints", lambda text, words: real(text, words).withField("keys", F.array(F.lit(7).cast("long"))))
    monkeypatch.setattr(jaccard, "HUBS", 1)
    for bounds in ({"crowd": 1}, {"held": 1000, "few": 0}):
        got = {r["doc_id"]: r["component_id"] for r in jaccard.near_copies(docs_of(*rows), **bounds).collect()}
        assert got == {i: i - i % 2 for i, _ in rows}, (bounds, sum(got[i] != i - i % 2 for i in got))


def test_sets_count_alike_with_and_without_bits():
    rng = np.random.default_rng(7)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 200), dtype=np.uint64)) for _ in range(40)]
    a, b, others = jaccard.Sets(sets), jaccard.Sets(sets, room=0), np.arange(40)
    assert a.bits is not None and b.bits is None
    for x in range(40):
        want = [len(np.intersect1d(sets[x], s)) for s in sets]
        assert a.shared(x, others).tolist() == b.shared(x, others).tolist() == want


def test_the_simhash_proposes_whatever_is_within_its_bits(spark, docs_of, monkeypatch):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows = []
    for g in range(120):
        base = [word() for _ in range(rng.randint(100, 400))]
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join([*base, word()]))]
    real = jaccard._prints
    monkeypatch.setattr(jaccard, "_prints", lambda text, words: real(text, words).withField("keys", F.array().cast("array<long>")))  # no bands
    docs = docs_of(*rows, (1000, ""), (1001, None))
    fp = {r["doc_id"]: r["l0"] for r in docs.select("doc_id", real(F.coalesce("text", F.lit("")), 5).alias("f")).select("doc_id", "f.l0").collect()}
    close = {2 * g for g in range(120) if ((fp[2 * g] ^ fp[2 * g + 1]) % 2**64).bit_count() <= 4}
    assert len(close) >= 90
    out = {r["doc_id"] for r in cp.drop_near_copies(spark, docs, SF).collect()}
    assert out == {i for i, _ in rows if i - 1 not in close} | {1000}
