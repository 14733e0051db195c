"""Operators that read each text by itself: tokens, personal data, quality."""

import collections
import hashlib
import random
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from axisflow.llm import packing, pii, quality, token_counts
from tests.llm.conftest import LONG, ODD

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    letters = "abcXYZ ÉéßΣσςİıſ's0123 \t\n\x0b\x1c\x1f\x85\xa0#$.,!中文٣é²Ⅷ😀\u200b\ufeff_ª"
    return ["".join(rng.choice(letters) if rng.random() < 0.97 else rng.choice(["<|endoftext|>", "'ll", "'RE"]) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_counts_equal_the_library(library):
    counter = token_counts.TokenCounter(PATH, 1000)
    for t in odd_texts(3000):
        assert counter.count(t) == len(library.encode(t, add_special_tokens=False).ids), t


def test_chunk_ids_equal_the_library(library):
    texts = odd_texts(3000, 2)
    for t, got in zip(texts, packing.ChunkIds(PATH, 500).of(texts)):
        assert got == packing.as_bytes(library.encode(t, add_special_tokens=False).ids), t


def test_merging_takes_the_leftmost_of_equal_pairs():
    pairs = {1 << 20 | 1: 0 << 20 | 5, 5 << 20 | 5: 1 << 20 | 6}
    assert [token_counts.merged_length([1] * n, pairs) for n in range(6)] == [0, 1, 1, 2, 1, 2]


def test_count_tokens_on_odd_rows(odd, empty, library):
    rows = token_counts.count_tokens(odd, PATH).collect()
    want = collections.Counter((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in ODD)
    assert collections.Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in rows) == want
    assert {r["doc_id"] for r in rows if r["over_limit"]} == {6}
    assert token_counts.count_tokens(empty, PATH).count() == 0


def plain_spans(t):
    out = []
    patterns = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))
    for place, (kind, p) in enumerate(patterns):
        for m in re.finditer(p, t):
            digits = re.sub("[^0-9]", "", m[0])
            total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and (not 12 <= len(digits) <= 19 or total % 10) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), place, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(out)]


def test_base_spans_equal_plain_patterns():
    rng = random.Random(3)
    for i in range(20_000):
        t = "".join(rng.choice("a.@-+_0123456789 ()é" if i % 2 else "0123456789.+ @a") for _ in range(rng.randint(0, 40)))
        assert [f"{x['kind']}:{x['start']}:{x['end']}" for x in pii.spans_in(t, 0.5, 40) if x["kind"] in pii.BASE] == plain_spans(t), t


def test_long_runs_take_no_more_than_their_length():
    for t in ("a" * 300_000, "1" * 300_000, "1." * 100_000, "+1" * 100_000, "a@" * 100_000, "A1" * 100_000, "@" * 100_000):
        pii.spans_in(t, 0.5, 40)


def test_added_kinds_need_their_checks_and_context():
    kinds = lambda t: [x["kind"] for x in pii.spans_in(t, 0.5, 40)]
    assert kinds("Konto DE89 3704 0044 0532 0130 00.") == ["iban"]
    assert kinds("Konto DE88 3704 0044 0532 0130 00.") == []
    assert kinds("call (717) 555-0202 now") == ["local_phone"] and kinds("size (717) 555-0202 now") == []
    key = "254ca002228af484f240146ffd26ba4415598ee8"
    assert kinds(f'token = "{key}"') == ["secret"] and kinds(f"then {key}") == [] and kinds(f"sample token {key}") == ["secret"]


def test_recall_by_kind(spark, docs_of):
    """Personal data of every kind, planted in prose: at least nine of ten are found, and prose alone has none."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    prose = lambda: " ".join(word() for _ in range(60))
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card():
        head = "4" + digits(14)
        return next(head + d for d in "0123456789" if pii.luhn(head + d))

    def iban():
        account = digits(18)
        check = 98 - int(account + "131400") % 97  # D and E are 13 and 14
        return f"account DE{check:02d}{account}"

    kinds = {"email": lambda: f"{word()}@{word()}.org", "ip": lambda: ".".join(str(rng.randrange(256)) for _ in range(4)), "card": card, "phone": lambda: f"+1 ({digits(3)}) 555-{digits(4)}", "iban": iban, "local_phone": lambda: f"call {digits(3)}-{digits(3)}-{digits(4)}", "secret": lambda: "token " + "".join(rng.choice("0123456789abcdef") for _ in range(40))}
    rows = [(100 * k + i, f"{prose()} {make()} {prose()}") for k, make in enumerate(kinds.values()) for i in range(40)] + [(1000 + i, prose()) for i in range(40)]
    got = {r["doc_id"]: r for r in pii.find_pii(docs_of(*rows)).collect()}
    for k, kind in enumerate(kinds):
        assert sum(got[100 * k + i][f"n_{kind}"] > 0 for i in range(40)) >= 36, kind
    assert all(got[1000 + i]["n_spans"] == 0 for i in range(40))


def test_many_spans_take_no_more_than_their_number():
    text = "token " + " ".join(f"a{i:021d}" for i in range(20_000))
    assert len([x for x in pii.spans_in(text, 0.0, 40) if x["kind"] == "secret"]) == 20_000


def test_redaction():
    assert pii.redacted("é a@b.co 1.2.3.4 x", pii.spans_in("é a@b.co 1.2.3.4 x", 0.5, 40)) == "é <EMAIL> <IP> x"


def test_find_pii_on_odd_rows(spark, odd, empty, docs_of):
    rows = pii.find_pii(odd).collect()
    assert len(rows) == len(ODD) and {r["base_sha256"] for r in rows} == {hashlib.sha256(b"").hexdigest()}
    assert pii.find_pii(empty).count() == 0
    got = pii.find_pii(docs_of((1, "x 4111 1111 1111 1111 +1 (717) 555-0202"))).first()
    assert (got["n_card"], got["n_phone"], got["spans"]) == (1, 1, "card:2:21,phone:22:39")


def plain_quality(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    times = collections.Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if times[x] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_quality_counts_equal_plain_counts(spark, docs_of, empty):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("ab|#é") * rng.randint(0, 2) + rng.choice([" ", "\n", "\x0b", "\x85", ""]) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    rows = [*enumerate(texts), *((i if i is None else i + 1000, t) for i, t in ODD if t != LONG), (2000, LONG)]
    got = quality.judge(docs_of(*rows)).collect()
    want = collections.Counter((i, *plain_quality(t or "")) for i, t in rows)
    assert collections.Counter((r["doc_id"], *(r[c] for c in BASE)) for r in got) == want
    assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) for r in got)
    assert not any(r["kept"] and r["base_failed"] for r in got)
    assert quality.judge(empty).count() == 0


def test_quality_verdict_follows_the_labels(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    labels = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/labels.parquet")
    rows = quality.judge(docs).where("NOT base_failed").join(labels, "doc_id").collect()
    good, bad = [r["kept"] for r in rows if r["quality"]], [r["kept"] for r in rows if not r["quality"]]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_js_distance(spark):
    f = lambda *x: F.array(*(F.lit(float(v)) for v in x))
    r = spark.range(1).select(quality.js_distance(f(1, 0), f(0, 1)), quality.js_distance(f(1, 3), f(2, 6)), quality.js_distance(f(0, 0), f(1, 1))).first()
    assert tuple(r) == pytest.approx((1.0, 0.0, 0.0))
