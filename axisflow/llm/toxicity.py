"""Toxicity by a linear-chain conditional random field over words.

Labels mark documents, so tokens are labelled across two halves of the training texts: a word of a toxic text of one
half counts as a toxic token if it, or a beginning of it, is found in the other half's toxic texts far more often than
in its others. A field for each half is fitted to such labels; its features are the word, its shape, its letter
sequences and the words beside it, hashed into one table, and not what made the labels. The model is the mean of both.
Tags follow one another along sentences; marginals come from the forward-backward recursion, for many sentences at a
time. A document's score is a logistic function of its largest marginal and of the number of toxic tokens expected,
fitted on marginals that each half's field gives to the other half.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axisflow.llm.common import crc_mod, some_at_a_time, text_or_empty, trimmed
from axisflow.llm.flat import LOWER, Words, mixed

#: Longest run of words that one chain holds; longer sentences go on in the next chain.
CHAIN = 64
#: Features are hashed into a table of 2 to the power of BITS weights.
BITS = 18
#: Lengths of letter sequences, the edges of a word counted as letters, and of beginnings, in bytes.
GRAMS = (3, 4, 5)
BEGINNINGS = range(4, 9)
#: Fixed value: an odd multiplier for sequences of letters.
_STEP = 0x9E3779B97F4A7C15

_BETWEEN = np.ones(256, dtype=bool)
_BETWEEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_STOPS = np.zeros(256, dtype=bool)
_STOPS[[10, 33, 46, 63]] = True


@dataclass
class Field:
    """weights: of tag 1 by hashed feature; bias: of tag 1 for every token; transitions[i, j] from tag i to tag j; start
    for tag 1; logistic: weights of a document's summary."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(1 << BITS, dtype=np.float32))
    bias: float = -4.0
    transitions: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: float = 0.0
    logistic: np.ndarray = field(default_factory=lambda: np.zeros(4))


def chains(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of chains, given which tokens end a sentence or a document."""
    last = np.flatnonzero(ends)
    first = np.concatenate([[0], last[:-1] + 1])
    length = last - first + 1
    k = -(-length // CHAIN)
    part = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
    starts = np.repeat(first, k) + CHAIN * part
    return starts, np.minimum(np.repeat(first + length, k) - starts, CHAIN)


class Tokens:
    """Tokens of a batch of texts (runs of ASCII letters and digits and of other bytes above them) and their chains."""

    def __init__(self, texts: list[str]):
        self.words = Words.of(texts, _BETWEEN, lower=False)
        self.raw, self.words.data = self.words.data, LOWER[self.words.data]
        self.n = len(self.words.start)
        if self.n:
            stops = np.cumsum(_STOPS[self.raw], dtype=np.int32)
            ends = np.ones(self.n, dtype=bool)
            ends[:-1] = (stops[self.words.start[1:]] > stops[self.words.end[:-1] - 1]) | (self.words.text[1:] != self.words.text[:-1])
            self.starts, self.lengths = chains(ends)
        else:
            self.starts = self.lengths = np.zeros(0, dtype=np.int64)

    def shapes(self) -> np.ndarray:
        """Length up to 15 bytes, whether the first letter is a capital, whether all are, and whether there is a digit."""
        w, big, digit = self.words, np.zeros(len(self.raw) + 1, dtype=np.int32), np.zeros(len(self.raw) + 1, dtype=np.int32)
        np.cumsum((self.raw >= 65) & (self.raw <= 90), out=big[1:])
        np.cumsum((self.raw >= 48) & (self.raw <= 57), out=digit[1:])
        length, capitals = w.end - w.start, big[w.end] - big[w.start]
        first = big[w.start + 1] - big[w.start]
        return (np.minimum(length, 15) + 16 * first + 32 * (capitals == length) + 64 * (digit[w.end] > digit[w.start])).astype(np.uint64)

    def features(self) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
        """Places in the table, and the token of each; without these, one for every token."""
        word = self.words.hashes()
        inner = np.ones(self.n, dtype=bool)
        inner[self.starts] = False
        left, right = np.zeros(self.n, dtype=np.uint64), np.zeros(self.n, dtype=np.uint64)
        left[1:][inner[1:]], right[:-1][inner[1:]] = word[:-1][inner[1:]], word[1:][inner[1:]]
        for kind, h in enumerate((word, self.shapes(), left, right)):
            yield place_of(h, kind), None
        w = self.words
        n = w.end - w.start + 2
        first = np.cumsum(n) - n
        own = np.repeat(np.arange(self.n, dtype=np.int32), n)
        letter = w.data[np.arange(n.sum()) - np.repeat(first - w.start + 1, n)].astype(np.uint64)
        letter[first] = letter[first + n - 1] = 1
        left_over = np.repeat((first + n).astype(np.int32), n) - np.arange(n.sum(), dtype=np.int32)
        h = letter
        for k in range(2, max(GRAMS) + 1):
            h = h[:-1] * np.uint64(_STEP) + letter[k - 1 :]
            if k in GRAMS:
                whole = left_over[: len(h)] >= k
                yield place_of(h[whole], k), own[: len(h)][whole]

    def emissions(self, f: Field) -> np.ndarray:
        e = np.full(self.n, f.bias)
        for place, token in self.features() if self.n else ():
            e += f.weights[place] if token is None else np.bincount(token, weights=f.weights[place], minlength=self.n)
        return e

    def marginals(self, f: Field) -> np.ndarray:
        """The marginal of tag 1 for every token."""
        return marginals(*forward_backward(self.emissions(f), self.starts, self.lengths, f))

    def signs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Hashes of each word and of each beginning that it has, and the tokens they belong to."""
        yield self.words.hashes(), np.arange(self.n)
        length = self.words.end - self.words.start
        for k in BEGINNINGS:
            longer = np.flatnonzero(length > k)
            yield mixed(self.words.hashes(k)[longer] + np.uint64(k)), longer

    def offsets(self, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last code points of tokens within their texts, end exclusive."""
        w, upto = self.words, np.zeros(len(self.raw) + 1, dtype=np.int32)
        np.cumsum((self.raw & 0xC0) != 0x80, out=upto[1:])
        base = upto[w.first[w.text[token]]]
        return upto[w.start[token]] - base, upto[w.end[token]] - base


def place_of(h: np.ndarray, kind: int) -> np.ndarray:
    """The place in the table of a hash of the kind: 0 to 3 the word, its shape, its neighbours; else a length of sequences."""
    return (mixed(h + np.uint64((kind + 1) * _STEP % (1 << 64))) >> np.uint64(64 - BITS)).astype(np.int32)


def forward_backward(e: np.ndarray, starts: np.ndarray, lengths: np.ndarray, f: Field) -> tuple[np.ndarray, np.ndarray]:
    """For every token, tag 1's share of the normalised forward and backward messages; e: odds of tag 1 by emission."""
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    active = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right") if len(lengths) else []
    t, w = np.exp(f.transitions), np.exp(np.clip(e, -30, 30))
    p, q = np.empty(len(e)), np.full(len(e), 0.5)
    for step, n in enumerate(active):
        at = starts[:n] + step
        if step:
            before = p[at - 1]
            one, zero = ((1 - before) * t[0, 1] + before * t[1, 1]) * w[at], (1 - before) * t[0, 0] + before * t[1, 0]
        else:
            one, zero = math.exp(f.start) * w[at], 1.0
        p[at] = one / (one + zero)
    for step in range(len(active) - 1, 0, -1):
        at = starts[: active[step]] + step
        one, zero = q[at] * w[at], 1 - q[at]
        b1, b0 = t[1, 0] * zero + t[1, 1] * one, t[0, 0] * zero + t[0, 1] * one
        q[at - 1] = b1 / (b1 + b0)
    return p, q


def marginals(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return p * q / (p * q + (1 - p) * (1 - q))


def summary(m: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """For each of n documents: 1, its largest marginal, the log of 1 + the toxic tokens expected, that number at most 3."""
    most, total = np.zeros(n), np.bincount(doc, weights=np.where(m > 0.02, m, 0.0), minlength=n)
    np.maximum.at(most, doc, m)
    return np.stack([np.ones(n), most, np.log1p(total), np.minimum(total, 3)], axis=1)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def read(texts: list[str]) -> Iterator[tuple[slice, Tokens]]:
    for part in some_at_a_time(pd.Series(texts, dtype=object)):
        yield part, Tokens(texts[part])


def learned_odds(texts: list[str], toxic: np.ndarray, z: float = 1.64, least: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of signs that are in `least` toxic texts or more, and the lower confidence bounds over 0.5 of the
    log-odds of their document counts."""

    def seen(y: int) -> Iterator[np.ndarray]:
        for _, t in read([x for x, own in zip(texts, toxic.tolist()) if own == y]):
            for h, token in t.signs():
                doc = t.words.text[token]
                order = np.lexsort((doc, h))
                h, doc = h[order], doc[order]
                yield h[np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])] if len(h) else h

    own, a = np.unique(np.concatenate([np.zeros(0, np.uint64), *seen(1)]), return_counts=True)
    own, a = own[a >= least], a[a >= least]
    b = np.zeros(len(own))
    for h in seen(0) if len(own) else ():
        at = np.minimum(np.searchsorted(own, h), len(own) - 1)
        b += np.bincount(at[own[at] == h], minlength=len(own))
    n1, n0 = int(toxic.sum()), int(len(toxic) - toxic.sum())
    bound = np.log((a + 0.5) / (n1 + 1)) - np.log((b + 0.5) / (n0 + 1)) - z * np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
    return own[bound > 0.5], bound[bound > 0.5]


def found_in(t: Tokens, known: np.ndarray) -> np.ndarray:
    """Which tokens have a sign among the sorted hashes."""
    out = np.zeros(t.n, dtype=bool)
    for h, token in t.signs() if len(known) else ():
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        out[token[known[at] == h]] = True
    return out


def chosen_chains(texts: list[str], toxic: np.ndarray, known: np.ndarray, stride: int):
    """What a field is fitted on: places, their tokens, labels, chain starts and lengths, of all chains that hold a known
    sign and of every stride-th of the others."""
    places, owners, labels, lengths, n = [], [], [], [], 0
    for part, t in read(texts):
        if not t.n:
            continue
        known_here = found_in(t, known)
        use = np.add.reduceat(known_here.astype(np.int64), t.starts) > 0
        use[np.flatnonzero(~use)[::stride]] = True
        token = np.repeat(use, t.lengths)
        number = np.where(token, n + np.cumsum(token) - 1, -1)
        for place, owner in t.features():
            mine = number if owner is None else number[owner]
            places.append(place[mine >= 0])
            owners.append(mine[mine >= 0].astype(np.int32))
        labels.append((known_here & (toxic[part][t.words.text] == 1))[token])
        lengths.append(t.lengths[use])
        n += int(token.sum())
    if not n:
        return (np.zeros(0, np.int32),) * 2 + (np.zeros(0),) + (np.zeros(0, np.int64),) * 2
    lengths = np.concatenate(lengths)
    return np.concatenate(places), np.concatenate(owners), np.concatenate(labels).astype(np.float64), np.cumsum(lengths) - lengths, lengths


def fitted(place: np.ndarray, owner: np.ndarray, y: np.ndarray, starts: np.ndarray, lengths: np.ndarray, chained: bool, rounds: int = 50, rate: float = 0.08, ridge: float = 1e-5) -> Field:
    """The field of largest likelihood of the labels, with a ridge, by gradient steps over all chains."""
    f = Field()
    if not len(y):
        return f
    inner = np.ones(len(y), bool)
    inner[starts] = False
    b = np.flatnonzero(inner)
    a = b - 1
    seen = np.array([[((y[a] == k) & (y[b] == j)).sum() for j in (0, 1)] for k in (0, 1)])
    size = 1 << BITS
    theta, m1, m2 = np.concatenate([np.zeros(size), [f.bias], np.zeros(5)]), 0.0, 0.0
    for i in range(1, rounds + 1):
        f.bias, f.transitions, f.start = float(theta[size]), theta[size + 1 : size + 5].reshape(2, 2), float(theta[size + 5])
        e = f.bias + np.bincount(owner, weights=theta[place], minlength=len(y))
        p, q = forward_backward(e, starts, lengths, f)
        m = marginals(p, q)
        g = np.empty_like(theta)
        g[:size] = np.bincount(place, weights=(y - m)[owner], minlength=size)
        g[size] = (y - m).sum()
        t, w = np.exp(f.transitions), np.exp(np.clip(e, -30, 30))
        pair = np.empty((2, 2, len(a)))
        for k in (0, 1):
            for j in (0, 1):
                pair[k, j] = (p[a] if k else 1 - p[a]) * t[k, j] * (w[b] * q[b] if j else 1 - q[b])
        pair /= pair.sum(axis=(0, 1))
        g[size + 1 : size + 5] = (seen - pair.sum(axis=2)).ravel() if chained else 0.0
        g[size + 5] = (y[starts] - m[starts]).sum() if chained else 0.0
        g = g / len(y) - ridge * theta
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        theta = theta + rate * (m1 / (1 - 0.9**i)) / (np.sqrt(m2 / (1 - 0.999**i)) + 1e-8)
    f.weights, f.bias = theta[:size].astype(np.float32), float(theta[size])
    f.transitions, f.start = theta[size + 1 : size + 5].reshape(2, 2), float(theta[size + 5])
    return f


def fit(texts: list[str], toxic: np.ndarray, stride: int = 16, chained: bool = True) -> Field:
    """The field for labelled texts. One class alone gives a field whose score is that class for every text.

    Each half's field is fitted on all chains that hold a sign of the other half and on every stride-th of its others;
    odds and the score's weights come from all texts. chained=False leaves out what links neighbouring tags."""
    f = Field()
    if not len(texts) or toxic.min() == toxic.max():
        f.logistic = np.array([8.0 if len(texts) and toxic.min() else -8.0, 0, 0, 0])
        return f
    half = np.arange(len(texts)) % 2
    own = [([t for t, h in zip(texts, half) if h == k], toxic[half == k]) for k in (0, 1)]
    known = [learned_odds(*o)[0] for o in own]
    fields = [fitted(*chosen_chains(*own[k], known[1 - k], stride), chained) for k in (0, 1)]
    z = np.concatenate([summaries(own[k][0], fields[1 - k]) for k in (0, 1)])
    y = np.concatenate([own[0][1], own[1][1]])
    for name in ("weights", "bias", "transitions", "start"):
        setattr(f, name, (getattr(fields[0], name) + getattr(fields[1], name)) / 2)
    weights = np.zeros(4)
    for _ in range(30):  # Newton's method with a small ridge
        h = logistic(z @ weights)
        weights += np.linalg.solve((z * (h * (1 - h))[:, None]).T @ z + 0.1 * np.eye(4), z.T @ (y - h) - 0.1 * weights)
    f.logistic = weights
    return f


def summaries(texts: list[str], f: Field) -> np.ndarray:
    return np.concatenate([np.zeros((0, 4)), *(summary(t.marginals(f), t.words.text, part.stop - part.start) for part, t in read(texts))])


def scored(text: Column, model, threshold: float = 0.5) -> Column:
    """struct(score, spans: array of struct(start, end, p)) of a text: offsets in code points of tokens whose marginal
    reaches the threshold."""

    @F.pandas_udf("score double, spans array<struct<start int, end int, p double>>")
    @trimmed
    def tag(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        f = model.value
        for texts in batches:
            score, spans = [np.zeros(0)], []
            for part in some_at_a_time(texts):
                t = Tokens(texts[part].tolist())
                m = t.marginals(f)
                n = part.stop - part.start
                score.append(logistic(summary(m, t.words.text, n) @ f.logistic))
                found: list[list] = [[] for _ in range(n)]
                hit = np.flatnonzero(m >= threshold)
                if len(hit):
                    for doc, start, end, p in zip(t.words.text[hit].tolist(), *(x.tolist() for x in t.offsets(hit)), m[hit].tolist()):
                        found[doc].append({"start": start, "end": end, "p": round(p, 4)})
                spans += found
            yield pd.DataFrame({"score": np.concatenate(score), "spans": spans})

    return tag(text)


def training_sample(docs: DataFrame, labels: DataFrame, most: int, chars: int, folds: int, id_col: str, text_col: str, label_col: str) -> tuple[list[str], np.ndarray]:
    """Texts and labels of the labelled training rows with the least hashes of their ids, null texts as empty.

    Labels of at most `most` ids are taken, and of the rows that have these, in the order of the hashes, the texts, so
    many rows at most and none once `chars` characters are reached. Texts are whole. Rows that repeat an id come in the
    order of their texts' hashes, so the sample is the same at every run. Only the sample reaches the driver."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_l")).agg(F.max(label_col).alias("_y"))
    chosen = known.where(crc_mod("_l", folds) != 0).orderBy(F.xxhash64("_l"), "_l").limit(most)
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_t")).join(F.broadcast(chosen), F.col("_id") == F.col("_l"))
    sizes = rows.select(F.xxhash64("_id").alias("_h"), F.xxhash64("_t").alias("_x"), F.length("_t").alias("_n"))
    total, last = 0, None
    for r in sizes.orderBy("_h", "_x").limit(most).collect():
        if total >= chars:
            break
        total, last = total + r["_n"], (r["_h"], r["_x"])
    if last is None:
        return [], np.zeros(0, dtype=np.int64)
    order = F.struct(F.xxhash64("_id").alias("h"), F.xxhash64("_t").alias("x"))
    got = rows.where(order <= F.struct(F.lit(last[0]).alias("h"), F.lit(last[1]).alias("x"))).orderBy(F.xxhash64("_id"), F.xxhash64("_t")).limit(most).select("_t", "_y").collect()
    return [r["_t"] for r in got], np.asarray([int(r["_y"] > 0) for r in got], dtype=np.int64)


def train(docs: DataFrame, labels: DataFrame, most: int = 3000, chars: int = 60_000_000, folds: int = 5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Field:
    """A field fitted on a bounded sample of the labelled rows outside fold 0."""
    return fit(*training_sample(docs, labels, most, chars, folds, id_col, text_col, label_col))


def score_documents(docs: DataFrame, labels: DataFrame, most: int = 3000, folds: int = 5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: the id, held_out (crc32 of the id modulo `folds` is 0), score, predicted, spans, and the columns `keep`.

    Labels of held-out rows are never read for learning, and nothing but the text is an input of a score. Null and
    empty texts get the score of a text without tokens. Repeated rows and null ids keep their rows; other columns
    aren't read; an empty table gives no rows; without labels, or with one class only, every text gets the same score.
    Fitting takes at most `most` labelled rows, whole, and no more of them after 60,000,000 characters; every text is scored whole, in a narrow map.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, most, folds=folds, id_col=id_col, text_col=text_col, label_col=label_col))
    out = docs.select(F.col(id_col), *keep, (crc_mod(id_col, folds) == 0).alias("held_out"), scored(text_or_empty(text_col), model).alias("_s"))
    return out.select(id_col, *keep, "held_out", F.col("_s.score").alias("score"), (F.col("_s.score") >= 0.5).cast("int").alias("predicted"), F.col("_s.spans").alias("spans"))
