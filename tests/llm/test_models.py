"""The toxicity field and the language model."""

import collections
import math
import re
import zlib

import numpy as np
import pytest

from axisflow.llm import lm, toxicity
from axisflow.llm.eliasfano import Children, EliasFano, Trie
from axisflow.llm.flat import Words, distinct, shingles
from tests.llm.conftest import ODD

SF = "/root/testdata/sf0.01"


def test_forward_backward_by_enumeration():
    rng = np.random.default_rng(1)
    f = toxicity.Field(transitions=rng.normal(size=(2, 2)), start=0.7)
    lengths = np.array([1, 4, 6, 2])
    starts = np.cumsum(lengths) - lengths
    e = rng.normal(size=lengths.sum())
    got = toxicity.marginals(*toxicity.forward_backward(e, starts, lengths, f))
    for s, n in zip(starts, lengths):
        weight = np.zeros((n, 2))
        for tags in np.ndindex(*(2,) * n):
            w = math.exp(f.start * tags[0] + sum(e[s + i] * t for i, t in enumerate(tags)) + sum(f.transitions[a, b] for a, b in zip(tags, tags[1:])))
            for i, t in enumerate(tags):
                weight[i, t] += w
        assert got[s : s + n] == pytest.approx(weight[:, 1] / weight.sum(axis=1))


def plain_emission(words, i, f):
    """Features of the i-th of a chain's words, without arrays."""
    top = 1 << 64

    def mix(h):
        h = (h ^ h >> 33) * 0xFF51AFD7ED558CCD % top
        h = (h ^ h >> 29) * 0xC4CEB9FE1A85EC53 % top
        return h ^ h >> 32

    step = 0x9E3779B97F4A7C15
    place = lambda h, kind: mix((h + (kind + 1) * step) % top) >> 64 - toxicity.BITS
    raw = [w.encode() for w in words]
    low = [bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in raw]
    word = [mix((sum((b + 1) * pow(step, k, top) for k, b in enumerate(w)) + len(w) * step) % top) for w in low]
    big = [65 <= b <= 90 for b in raw[i]]
    shape = min(len(raw[i]), 15) + 16 * big[0] + 32 * all(big) + 64 * any(48 <= b <= 57 for b in raw[i])
    places = [place(word[i], 0), place(shape, 1), place(word[i - 1] if i else 0, 2), place(word[i + 1] if i + 1 < len(words) else 0, 3)]
    letters = [1, *low[i], 1]
    for n in toxicity.GRAMS:
        for at in range(len(letters) - n + 1):
            h = 0
            for b in letters[at : at + n]:
                h = (h * step + b) % top
            places.append(place(h, n))
    return f.bias + sum(float(f.weights[p]) for p in places)


def test_scores_by_brute_force(spark, docs_of):
    rng = np.random.default_rng(3)
    f = toxicity.Field(rng.normal(scale=0.4, size=1 << toxicity.BITS).astype(np.float32), -1.0, rng.normal(size=(2, 2)), 0.3, np.array([-1.0, 2.0, 0.5, 0.2]))
    texts = ["You STUPID clown, go. Éa b2 éa!", "one", "", "a-b c.\nd e f g; h", None]
    rows = docs_of(*enumerate(texts))
    got = rows.select("doc_id", toxicity.scored(toxicity.text_or_empty("text"), spark.sparkContext.broadcast(f)).alias("s")).collect()
    for r in got:
        m, spans = [], []
        for sentence in re.finditer(r"[^.!?\n]+", texts[r["doc_id"]] or ""):
            found = [(x.start() + sentence.start(), x.end() + sentence.start(), x[0]) for x in re.finditer(r"[A-Za-z0-9\x80-\U0010ffff]+", sentence[0])]
            words = [w for *_, w in found]
            e, weight = [plain_emission(words, i, f) for i in range(len(words))], np.zeros((len(words), 2))
            for tags in np.ndindex(*(2,) * len(words)):
                w = math.exp(f.start * tags[0] + sum(x * t for x, t in zip(e, tags)) + sum(f.transitions[a, b] for a, b in zip(tags, tags[1:]))) if tags else 0
                for i, t in enumerate(tags):
                    weight[i, t] += w
            p = weight[:, 1] / weight.sum(axis=1)
            m += p.tolist()
            spans += [(a, b, round(x, 4)) for (a, b, _), x in zip(found, p.tolist()) if x >= 0.5]
        total = sum(x for x in m if x > 0.02)
        score = 1 / (1 + math.exp(-(f.logistic @ [1, max(m, default=0), math.log1p(total), min(total, 3)])))
        assert r["s"]["score"] == pytest.approx(score, abs=1e-6)
        assert [(x["start"], x["end"], pytest.approx(x["p"], abs=2e-4)) for x in r["s"]["spans"]] == spans


def test_flat_words_and_shingles():
    texts = ["The cat  sat\ton THE mat", "", None, "a", "x" * 5000 + " y z", "\u00e9 \u0085\u00a0 b"]
    w = Words.of(texts)
    plain = [(t or "").encode().lower().split() for t in texts]
    assert [bytes(w.data[a:b]) for a, b in zip(w.start, w.end)] == [x for own in plain for x in own] and w.sizes.tolist() == list(map(len, plain))
    h = w.hashes()
    assert len(set(h.tolist())) == len({x for own in plain for x in own}) and h[0] == h[4]
    s, n = shingles(h, w.sizes, 3)
    assert n.tolist() == [4, 0, 0, 1, 1, 1 if len(plain[5]) < 4 else len(plain[5]) - 2] and len(set(s.tolist())) == len(s)
    d, k = distinct(np.array([5, 3, 5, 9, 9], dtype=np.uint64), np.array([3, 0, 2]))
    assert d.tolist() == [3, 5, 9] and k.tolist() == [2, 0, 1]


def test_chains_are_cut():
    ends = np.zeros(200, bool)
    ends[[9, 149, 199]] = True
    starts, lengths = toxicity.chains(ends)
    assert starts.tolist() == [0, 10, 74, 138, 150] and lengths.tolist() == [10, 64, 64, 12, 50]


def test_held_out_accuracy_and_offsets(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    known = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = toxicity.score_documents(docs, labels).collect()
    assert len(rows) == len(texts) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    out = [(known[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in known]
    clean, toxic = [p for y, p in out if not y], [p for y, p in out if y]
    assert sum(clean) <= 0.03 * len(clean) and sum(toxic) >= 0.6 * len(toxic)
    words = collections.Counter(texts[r["doc_id"]][s["start"] : s["end"]].lower() for r in rows for s in r["spans"])
    assert words.most_common(1)[0][1] > 5 and not any(c.isspace() for w in words for c in w)


def test_held_out_accuracy_with_more_labels():
    """At sf0.1, without Spark: recall, and what links between neighbouring tags add."""
    import duckdb

    rows = duckdb.sql(f"SELECT doc_id, text, toxic FROM '{SF[:-2]}1/documents.parquet' JOIN '{SF[:-2]}1/labels.parquet' USING (doc_id) ORDER BY hash(doc_id)").fetchall()
    out = [zlib.crc32(str(i).encode()) % 5 == 0 for i, *_ in rows]
    train, test = [r for r, o in zip(rows, out) if not o], [r for r, o in zip(rows, out) if o]
    f = toxicity.fit([t or "" for _, t, _ in train], np.array([y for *_, y in train]))
    y, p = np.array([y for *_, y in test]), toxicity.logistic(toxicity.summaries([t or "" for _, t, _ in test], f) @ f.logistic) >= 0.5
    assert p[y == 1].mean() >= 0.9 and p[y == 0].mean() <= 0.02


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs, labels = (spark.read.parquet(f"{SF.replace('0.01', '0.001')}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    a, b = ({r["doc_id"]: r["score"] for r in toxicity.score_documents(docs, x).collect()} for x in (labels, flipped))
    assert a == b


def test_toxicity_on_odd_rows(spark, odd, empty):
    one = spark.createDataFrame([(4, 1), (5, 0), (6, 0), (7, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    for labels in (one, one.where("toxic = 1"), one.where("false")):
        rows = toxicity.score_documents(odd, labels).collect()
        assert collections.Counter(r["doc_id"] for r in rows) == collections.Counter(i for i, _ in ODD)
        blank = {r["score"] for r in rows if r["doc_id"] in (1, 2, 3)}
        assert len(blank) == 1 and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score_documents(empty, one).count() == 0


@pytest.mark.parametrize("n, top", [(0, 1), (1, 5), (5, 3), (1000, 10**6), (1000, 1000), (3000, 2**50), (3000, 40)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n)
    v = np.sort(rng.integers(0, top, n))
    e = EliasFano.build(v)
    assert not n or (e.get(np.arange(n)).astype(np.int64) == v).all()
    x = np.concatenate([v, rng.integers(0, top + 50, 2000), [2 * top, 100 * top]])
    found, known = e.find(x), set(v.tolist())
    assert all((b >= 0) == (a in known) and (b < 0 or v[b] == a) for a, b in zip(x.tolist(), found.tolist()))


def test_children():
    rng = np.random.default_rng(4)
    key = np.unique(rng.integers(0, 50, 800) * 10**6 + rng.integers(0, 300, 800))
    c = Children.build(key // 10**6, key % 10**6, 60)
    parent, number, place = rng.integers(0, 60, 5000), rng.integers(0, 900, 5000), {k: i for i, k in enumerate(key.tolist())}
    assert c.find(parent, number).tolist() == [place.get(p * 10**6 + n, -1) for p, n in zip(parent.tolist(), number.tolist())]
    assert (Children.build(key[:0], key[:0], 3).find(parent % 3, number) == -1).all()


def plain_score(one, two, three, contexts, texts, t, m2=1000.0, m3=3.0):
    n, v = sum(one.values()), len(one)
    p, out = [0, 0, *t], 0.0
    for u, x, w in zip(p, p[1:], p[2:]):
        p2 = (two[x, w] + m2 * (one[w] + 1) / (n + v + 1)) / ((texts if x == 0 else one[x]) + m2)
        out += math.log10((three[u, x, w] + m3 * p2) / ((texts if u == x == 0 else contexts[u, x]) + m3))
    return out


def check(rows, table):
    tokens = [(i, [*(t or "").encode().lower().split(), None]) for i, t in table]
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    one, two, three, contexts = (collections.Counter() for _ in range(4))
    for i, t in tokens:
        if not out(i):
            p = [0, 0, *t]
            one.update(t), two.update(zip(p[1:], p[2:])), three.update(zip(p, p[1:], p[2:])), contexts.update(zip(p, p[1:-1]))
    n, v, texts = sum(one.values()), len(one), sum(not out(i) for i, _ in tokens)
    want = collections.defaultdict(list)
    for i, t in tokens:
        base = sum(math.log10((one[x] + 1) / (n + v + 1)) for x in t)
        want[i].append((out(i), len(t), sum(one[x] > 0 for x in t), n, base, plain_score(one, two, three, contexts, texts, t)))
    got = collections.defaultdict(list)
    for r in rows:
        got[r["doc_id"]].append((r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]))
    assert got.keys() == want.keys()
    for i in want:
        for a, b in zip(sorted(got[i]), sorted(want[i]), strict=True):
            assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], rel=1e-9) and abs(a[5] - b[5]) <= 0.02 * a[1] + 1e-6


def test_lm_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF.replace('0.01', '0.001')}/documents.parquet").repartition(3)
    table = [(r["doc_id"], r["text"]) for r in docs.collect()]
    # 5 shards split the commonest words, 200 leave most of them whole
    for shards in (5, 200):
        check(lm.score_texts(docs, block_chars=100_000, shards=shards).collect(), table)


def test_lm_gains_on_held_out_texts(spark):
    rows = lm.score_texts(spark.read.parquet(f"{SF}/documents.parquet")).where("held_out").collect()
    assert len(rows) > 100 and sum(r["score"] - r["base_score"] for r in rows) >= 0.5 * sum(r["n_tokens"] for r in rows)


def test_tries_are_written(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"a b c{i % 3} a b d") for i in range(30)], "doc_id long, text string")
    assert lm.score_texts(docs, shards=3, tries=f"file://{tmp_path}").count() == 30
    files = [p.name for p in tmp_path.iterdir() if p.name.endswith(".trie")]
    tries = [Trie.read(f"file://{tmp_path}", f) for f in files]
    # three words c, a, b, d, the end and the beginning, as contexts (but the end, which is none)
    assert sum(t.words.n for t in tries) >= 7 and all(len(t.levels[3].codes) == t.triples.values.n for t in tries)


def test_lm_on_odd_rows(spark, odd, empty):
    check(lm.score_texts(odd, block_chars=10, shards=3).collect(), ODD)
    check(lm.score_texts(odd).collect(), ODD)
    assert lm.score_texts(empty).count() == 0


def test_packed_arrays_round_trip():
    arrays = [np.arange(5, dtype="u2"), np.zeros(0), np.array([1.5]), lm.narrow(np.array([1 << 40]))]
    back = lm.unpacked(lm.packed(*arrays))
    assert all(a.dtype == b.dtype and (a == b).all() for a, b in zip(arrays, back))
