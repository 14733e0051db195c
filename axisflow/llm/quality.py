"""Quality rules: counts within a text, then its distance from what is usual in its language.

Everything is built-in functions. A text's character classes and common words make two histograms; each is
compared, by Jensen-Shannon distance, with the sum over those texts of its language that pass the base rules.
"""

from __future__ import annotations

from functools import reduce
from operator import add

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axisflow.llm.common import BLANK, kept, text_or_empty

#: Common words of English, German, French and Spanish, as they stand within a sentence.
COMMON_WORDS = (
    "the of and to in a is that for was on with as "
    "der die und den von zu das mit sich des auf ist nicht "
    "de la le et les un une du que est pour pas dans "
    "el y los del se las por con para"
).split()
#: Character classes, by pattern; further classes are symbols, blanks, and whatever is left.
CLASSES = ("[a-z]+", "[A-Z]+", "[0-9]+", "[.,;:!?'\"()-]+")
SYMBOLS = "[#*$%&|<>]+"


def _removed(text: Column, pattern: str) -> Column:
    """How many characters the pattern's matches have."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _shifted(a: Column, n: Column, first: int, less: int) -> Column:
    return F.slice(a, F.lit(first), F.greatest(n - less, F.lit(0)))


def _bound(x: Column, use) -> Column:
    """use(x), with x worked out once however often `use` names it."""
    return F.transform(F.array(x), use)[0]


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


#: xxhash64 of the common words, as Spark's function has it, and a divisor by which all of them leave another remainder.
_COMMON = [h - (1 << 64) if (h := xxhash.xxh64_intdigest(w.encode(), 42)) >> 63 else h for w in COMMON_WORDS]
_APART = next(p for p in range(len(_COMMON), 1 << 16) if len({h % p for h in _COMMON}) == len(_COMMON))
#: A letter for each common word.
_LETTERS = [chr(33 + i) for i in range(len(_COMMON))]


def _common_counts(h: Column) -> Column:
    """How often each common word is among the word hashes, then how many others there are.

    Known words become a letter each, of one short text, in which letters are counted by taking them out."""
    letter = [""] * _APART
    for own, c in zip(_COMMON, _LETTERS):
        letter[own % _APART] = c
    known = F.transform(F.filter(h, lambda x: x.isin(_COMMON)), lambda x: F.get(F.array(*map(F.lit, letter)), F.pmod(x, F.lit(_APART)).cast("int")))
    long = lambda c: c.cast("long")
    counts = lambda s: F.array(*(long(F.length(s) - F.length(F.replace(s, F.lit(c), F.lit("")))) for c in _LETTERS), long(F.size(h) - F.length(s)))
    return _bound(F.array_join(known, ""), counts)


def text_features(docs: DataFrame, id_col: str, text_col: str, group_col: str | None) -> DataFrame:
    """The id, group, n_words, the four counts of the base rules, n_chars, base_failed, and the histograms classes and common.

    Words are told apart by 64-bit hashes. Repeats are found within the row: window hashes are compared through a set
    first, and only where one occurs twice are they sorted with their places, so that a text of n words costs n log n at
    most. Small letters are taken out first; the other classes are counted in what is left.
    """
    group = F.col(group_col).cast("string") if group_col else F.lit(None).cast("string")
    d = docs.select(F.col(id_col).alias("_id"), group.alias("_group"), text_or_empty(text_col).alias("t"))
    d = d.withColumns({"h": F.transform(F.array_remove(F.split("t", BLANK), ""), lambda w: F.xxhash64(w)), "rest": F.translate("t", "abcdefghijklmnopqrstuvwxyz", "")})
    d = d.withColumn("n", F.size("h"))
    d = d.withColumn("g", F.transform(_shifted(F.col("h"), F.col("n"), 1, 2), lambda x, i: F.xxhash64(x, F.get("h", i + 1), F.get("h", i + 2))))
    twice = F.size(F.array_distinct("g")) < F.size("g")
    d = d.withColumn("s", F.when(twice, F.array_sort(F.transform("g", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    same = F.zip_with(_shifted(F.col("s"), F.size("s"), 2, 1), _shifted(F.col("s"), F.size("s"), 1, 1), lambda b, a: F.when(a["x"] == b["x"], F.array(a["i"], b["i"])))
    d = d.withColumn("q", F.when(F.col("s").isNotNull(), F.array_sort(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull()))))))
    steps = F.zip_with(_shifted(F.col("q"), F.size("q"), 2, 1), _shifted(F.col("q"), F.size("q"), 1, 1), lambda b, a: F.least(b - a, F.lit(3)))
    repeated = F.when(F.col("q").isNotNull(), F.aggregate(steps, F.lit(3), lambda s, x: s + x)).otherwise(0)
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    long = lambda c: c.cast("long")
    rest = F.col("rest")
    classes = [F.length("t") - F.length(rest), *(_removed(rest, p) for p in CLASSES[1:]), _removed(rest, SYMBOLS), _removed(rest, BLANK)]
    # a slice, as of a plain array Spark would put each entry's expression into every use of it
    d = d.select(
        "_id", "_group", long(F.col("n")).alias("n_words"), long(repeated).alias("n_repeat_words"), long(F.length("t")).alias("n_chars"),
        _bound(lines, lambda x: long(F.size(x) - F.size(F.array_distinct(x)))).alias("n_dup_lines"), F.slice(F.array(*map(long, classes)), 1, len(classes)).alias("c"), _common_counts(F.col("h")).alias("common"),
    )
    left = F.col("n_chars") - reduce(add, (F.col("c")[i] for i in range(len(CLASSES) + 2)))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    symbols, blanks = F.col("c")[len(CLASSES)], F.col("c")[len(CLASSES) + 1]
    return d.select(
        "_id", "_group", "n_words", (F.col("n_chars") - blanks).alias("word_chars"), symbols.alias("n_symbols"), "n_dup_lines", "n_repeat_words",
        "n_chars", failed.alias("base_failed"), F.concat("c", F.array(left)).alias("classes"), "common",
    )


def js_distance(p: Column, q: Column) -> Column:
    """The square root of the Jensen-Shannon divergence, base 2, of two histograms; 0 if one is empty. Linear in their length."""
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    def of(z: Column) -> Column:
        terms = F.zip_with(p, q, lambda a, b: part(a / z["p"], (a / z["p"] + b / z["q"]) / 2) + part(b / z["q"], (a / z["p"] + b / z["q"]) / 2))
        return F.when((z["p"] > 0) & (z["q"] > 0), F.sqrt(F.greatest(_total(terms) / 2, F.lit(0.0)))).otherwise(0.0)

    return _bound(F.struct(_total(p).alias("p"), _total(q).alias("q")), of)


def references(features: DataFrame, typical: Column) -> DataFrame:
    """The summed histograms of each group's typical texts; one row a group, zeros where there is none."""
    sums = lambda c, k: F.array(*(F.sum(F.when(typical, F.col(c)[i]).otherwise(0)).cast("double") for i in range(k)))
    return features.groupBy("_group").agg(sums("classes", len(CLASSES) + 3).alias("r_classes"), sums("common", len(COMMON_WORDS) + 1).alias("r_common"))


def with_distances(features: DataFrame, usual: DataFrame) -> DataFrame:
    usual = kept(usual)
    few = usual.count() <= 4096
    own = features.drop("class_distance", "word_distance")
    both = own.join(F.broadcast(usual) if few else usual, own["_group"].eqNullSafe(usual["_group"]), "left").drop(usual["_group"])
    distance = lambda c, r: js_distance(F.col(c).cast("array<double>"), F.col(r))
    return both.withColumns({"class_distance": distance("classes", "r_classes"), "word_distance": distance("common", "r_common")}).drop("r_classes", "r_common")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_col: str | None = "lang", least_words: int = 50, least_chars: int = 200, most_class: float = 0.28, most_word: float = 0.24, most_class_with_word: float = 0.125) -> DataFrame:
    """One row per input row: the id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, class_distance, word_distance.

    base_failed: under 50 words, or more than half of the words in repeated windows. A text is not kept if it failed,
    if its character classes are over `most_class` from its language's, or if its common words are over `most_word`
    and its classes over `most_class_with_word`. Distances count only from `least_chars` characters and `least_words`
    words on. A language's references are the sums over its texts that pass the base rules and lie within `most_class` of
    the sums over all that pass them, so that junk isn't its own norm; where there is none, distances are 0. A null text
    is empty; a null language is a language of its own; repeated rows and null ids keep their
    rows; other columns aren't read; an empty table gives no rows. Features (no texts) are written once to the shared
    folder, so texts are read once; references are pre-aggregated sums, broadcast if they are at most 4096 rows, else joined.
    """
    features = kept(text_features(docs, id_col, text_col, group_col))
    passed = ~F.col("base_failed")
    first = with_distances(features, references(features, passed))
    both = with_distances(features, references(first, passed & (F.col("class_distance") <= most_class)))
    odd = (F.col("n_chars") >= least_chars) & (F.col("class_distance") > most_class)
    odd |= (F.col("n_chars") >= least_chars) & (F.col("n_words") >= least_words) & (F.col("word_distance") > most_word) & (F.col("class_distance") > most_class_with_word)
    both = both.withColumn("kept", ~(F.col("base_failed") | odd))
    return both.select(F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")
