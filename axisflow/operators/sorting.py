"""Sorting rows and tables, positions in a global order, and checks of sorted results.

Spark's order holds: null first, NaN last, and the two zeros equal. No size is refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axisflow.functions.lineage import kept
from axisflow.operators.reduce import radix_histogram, radix_offsets, radix_rank


def sorted_row(v: Column, descending: bool = False) -> Column:
    return F.sort_array(v, asc=not descending)


def argsorted_row(v: Column) -> Column:
    """struct(values, indices) of an array; equal values keep their order."""
    pairs = F.array_sort(F.transform(v, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    return F.struct(F.transform(pairs, lambda e: e["x"]).alias("values"), F.transform(pairs, lambda e: e["i"].cast("long")).alias("indices"))


def merged_rows(a: Column, b: Column, descending: bool = False) -> Column:
    """One sorted array of two."""
    return sorted_row(F.concat(a, b), descending)


def with_positions(df: DataFrame, *order: str | Column) -> DataFrame:
    """df with pos, each row's place from 0 in the global order, without a window over all rows.

    Rows are dealt out by ranges and sorted within these; the sorted table is kept, so that its partitions can't change
    between counting and numbering; then each partition starts where those before it end. Ties get distinct places; a
    salt as the last key lets ranges part them, however many they are."""
    keys = [*(F.col(c) if isinstance(c, str) else c for c in order), F.col("_salt")]
    salted = df.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id()))
    spread = kept(salted.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_salt")).withColumn("_id", F.monotonically_increasing_id())
    part = F.shiftright("_id", 33)
    counts = spread.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    placed = spread.withColumn("_p", part).join(F.broadcast(before), "_p")  # as many rows as partitions
    return placed.select(*df.columns, (F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).alias("pos"))


def sort_table(df: DataFrame, *columns: str, descending: bool = False) -> DataFrame:
    return df.orderBy(*(F.col(c).desc() if descending else F.col(c).asc() for c in columns))


def argsort_table(df: DataFrame, key: str, index: str) -> DataFrame:
    """pos, value, index: a stable argsort of the rows by key, equal keys in order of index."""
    return with_positions(df.select(F.col(key).alias("value"), F.col(index).alias("index")), "value", "index").select("pos", "value", "index")


def radix_pass(df: DataFrame, key: str, pos: str, step: int, block_size: int = 256) -> DataFrame:
    """df with pos set to each row's place after one stable pass by the step-th 4-bit digit of key.

    A full sort is one global orderBy; this is the single pass, for checks and partial orders."""
    block = F.floor(F.col(pos) / block_size).cast("long")
    before = radix_offsets(radix_histogram(df, key, block, step)).select("block", "digit", "before")
    ranked = radix_rank(df, key, pos, block, step).join(before, ["block", "digit"])
    return ranked.select(*((F.col("before") + F.col("rank")).alias(pos) if c == pos else F.col(c) for c in df.columns))


def ordered_bits(x: Column) -> Column:
    """A float's 32 bits as a whole number of the same order (negative numbers before positive ones)."""

    @F.pandas_udf("long")
    def bits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            u = x.to_numpy(np.float32).view(np.uint32)
            yield pd.Series(np.where(u >> 31, ~u, u | np.uint32(1 << 31)).astype(np.int64))

    return bits(x.cast("float"))


def float_of_bits(u: Column) -> Column:
    """The float of which ordered_bits made the number."""

    @F.pandas_udf("float")
    def floats(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            u = x.to_numpy(np.int64).astype(np.uint32)
            yield pd.Series(np.where(u >> 31, u & np.uint32((1 << 31) - 1), ~u).astype(np.uint32).view(np.float32))

    return floats(u)


def first_descent(df: DataFrame, pos: str = "pos", value: str = "x") -> DataFrame:
    """One row: first_descent, the first place whose value is less than the one before, or null.

    Neighbours meet by a join on places, which any number of tasks share."""
    a = df.select((F.col(pos) + 1).alias("_p"), F.col(value).alias("_a"))
    b = df.select(F.col(pos).alias("_p"), F.col(value).alias("_b"))
    return a.join(b, "_p").where("_b < _a").agg(F.min("_p").alias("first_descent"))


def indices_valid(given: DataFrame, result: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """One row: valid, whether every (value, index) of the result is what `given` (i, x) has at that index."""
    joined = result.join(given, result["index"] == given["i"], "left")
    return joined.agg(F.coalesce(F.bool_and(F.coalesce(F.abs(F.col("x") - F.col("value")) < tolerance, F.lit(False))), F.lit(True)).alias("valid"))


def match_rate(a: DataFrame, b: DataFrame, pos: str = "pos", value: str = "x", tolerance: float = 1e-6) -> DataFrame:
    """One row: n, matches, percent of places where both agree; places that one side lacks don't."""
    both = a.select(pos, F.col(value).alias("_a")).join(b.select(pos, F.col(value).alias("_b")), pos, "full")
    hit = F.coalesce(F.abs(F.col("_a") - F.col("_b")) < tolerance, F.lit(False)).cast("int")
    return both.agg(F.count(F.lit(1)).alias("n"), F.sum(hit).alias("matches"), (100 * F.avg(hit)).alias("percent"))


def preview(df: DataFrame, by: str, n: int = 64) -> tuple[DataFrame, DataFrame]:
    """The first and the last n rows by a column: a report, so limited."""
    return df.orderBy(by).limit(n), df.orderBy(F.col(by).desc()).limit(n)
