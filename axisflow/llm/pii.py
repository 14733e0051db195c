"""Personal data: patterns propose spans, checksums and ranges confirm them, words nearby move the score."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axisflow.llm.common import text_or_empty, trimmed

#: Base kinds, then the kinds that the method adds; spans with one start are listed in this order.
BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "local_phone", "secret")
KINDS = BASE + ADDED

#: Score of a confirmed span before its context is read.
SCORES = {"email": 0.9, "ip": 0.8, "card": 0.8, "phone": 0.8, "iban": 0.7, "local_phone": 0.3, "secret": 0.3}
#: Words that raise the score of a kind, and words that lower any score.
CONTEXT = {
    "email": ("email", "e-mail", "mail", "contact", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "adresse"),
    "card": ("card", "visa", "mastercard", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "telefono"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "local_phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "telefono"),
    "secret": ("token", "key", "secret", "password", "passwort", "apikey", "api_key"),
}
AGAINST = ("example", "sample", "dummy", "isbn", "order", "version")
#: Lengths of account numbers by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28,
    "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HN": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26,
    "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28,
    "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25,
    "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}

_AFTER_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
_LOCAL_PHONE = re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
_SECRET = re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{20,}(?![A-Za-z0-9_+/=-])")
_WORD = re.compile(r"[^\W\d]+(?:-[^\W\d]+)?")

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    """Every second digit from the right is doubled, its own digits added; the sum ends in 0."""
    doubled = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
    own = [ord(c) - 48 for c in reversed(digits)]
    return (sum(own[::2]) + sum(doubled[d] for d in own[1::2])) % 10 == 0


def mod97(account: str) -> bool:
    """The first four characters moved to the end, letters as 10 to 35: the number leaves 1 modulo 97."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches of name@host.host: driven by each @, so that long runs of letters cost their length once."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_SET:
            start -= 1
        if start < at and (m := _AFTER_AT.match(text, at)):
            end = m.end()
            yield start, end
        at = text.find("@", max(end, at + 1))


def addresses(text: str) -> Iterator[Span]:
    """Every four parts, from the left, of a run of dotted numbers; the four are dropped if one is over 255."""
    for m in _DOTTED.finditer(text):
        if m[0].count(".") < 3:
            continue
        parts, start = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield start, end
            start = end + 1


def cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        if len(m[0]) >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[Span]:
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            yield m.span()


def ibans(text: str) -> Iterator[Span]:
    for m in _IBAN.finditer(text):
        wanted, seen = IBAN_LENGTHS.get(m[0][:2], 0), 0
        for i, c in enumerate(m[0]):
            seen += c != " "
            if seen == wanted:
                if mod97(m[0][: i + 1].replace(" ", "")) and not text[m.start() + i + 1 : m.start() + i + 2].isalnum():
                    yield m.start(), m.start() + i + 1
                break


def local_phones(text: str) -> Iterator[Span]:
    return (m.span() for m in _LOCAL_PHONE.finditer(text))


def secrets(text: str) -> Iterator[Span]:
    """Long runs that mix letters and digits; only words nearby make one count."""
    return (m.span() for m in _SECRET.finditer(text) if any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0]))


PROPOSERS: dict[str, Callable[[str], Iterator[Span]]] = dict(zip(KINDS, (emails, addresses, cards, phones, ibans, local_phones, secrets)))


def score(text: str, kind: str, start: int, end: int, reach: int) -> float:
    """The kind's score, 0.4 more if a word of the kind's context is within `reach` characters, 0.2 less for a word
    that speaks against it; at most 1."""
    near = set(_WORD.findall(text[max(0, start - reach) : start].lower())) | set(_WORD.findall(text[end : end + reach].lower()))
    return round(min(1.0, SCORES[kind] + 0.4 * any(w in near for w in CONTEXT[kind]) - 0.2 * any(w in near for w in AGAINST)), 3)


def merged(spans: list[Span]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that spans cover."""
    starts, ends = [], []
    for a, b in sorted(spans):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def spans_in(text: str, threshold: float, reach: int) -> list[dict]:
    """All spans of a text. Base spans stay whatever their score; an added one needs the threshold and free room, which
    is looked up by bisection."""
    found, taken = [], []
    for kind in KINDS:
        starts, ends = merged(taken) if kind in ADDED else ([], [])
        for start, end in PROPOSERS[kind](text):
            s = score(text, kind, start, end, reach)
            before = bisect_left(starts, end) - 1
            if kind in BASE or s >= threshold and (before < 0 or ends[before] <= start):
                found.append({"kind": kind, "start": start, "end": end, "score": s})
        taken = [(x["start"], x["end"]) for x in found]
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(found, key=lambda x: (x["start"], order[x["kind"]], x["end"]))


def _worth_reading(text: Column) -> Column:
    """The text, or null where it has neither an @ nor a digit, without which there is no span of any kind."""
    return F.when(text.rlike("[@0-9]"), text)


def spans(text: Column, threshold: float = 0.5, reach: int = 40) -> Column:
    """array<struct<kind, start, end, score>> of a text: code points, end exclusive, by start, then kind as in KINDS."""

    @F.pandas_udf("array<struct<kind string, start int, end int, score double>>")
    @trimmed
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([spans_in(t, threshold, reach) if t else [] for t in texts], dtype=object)

    return find(_worth_reading(text))


def joined(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def find_pii(docs: DataFrame, threshold: float = 0.5, reach: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, n_email, n_ip, n_card, n_phone, base_sha256, spans, then n_iban, n_local_phone, n_secret, n_spans (all kinds) and scored.

    A null text is empty: counts 0, no spans, the digest of the empty string. Repeated rows and null ids keep their
    rows; other columns aren't read; an empty table gives no rows. scored holds the spans with their scores. A narrow
    map: no shuffle; every proposer takes time in proportion to the text, however long its words are.
    """
    found = docs.select(F.col(id_col), spans(text_or_empty(text_col), threshold, reach).alias("scored"))
    of = lambda kind: F.size(F.filter("scored", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("scored", lambda x: x["kind"].isin(*BASE))
    return found.select(id_col, *(of(k).alias(f"n_{k}") for k in BASE), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("scored")).alias("spans"), *(of(kind).alias(f"n_{kind}") for kind in ADDED), F.size("scored").cast("long").alias("n_spans"), "scored")


def redacted(text: str, found: list[dict]) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one, named by the first."""
    out, at = [], 0
    for x in found:
        if x["start"] >= at:
            out += [text[at : x["start"]], f"<{x['kind'].upper()}>"]
        at = max(at, x["end"])
    return "".join([*out, text[at:]])


def redact(text: Column, threshold: float = 0.5, reach: int = 40) -> Column:
    """The text without its personal data; null stays null."""

    @F.pandas_udf("string")
    @trimmed
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([redacted(t, spans_in(t, threshold, reach)) if t else None for t in texts], dtype=object)

    return F.coalesce(clean(_worth_reading(text)), text)
