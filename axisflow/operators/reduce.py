"""Reductions along an axis of (i, v), of columns of a wide table, and the counting parts of a radix sort.

Along axis 1 a row is reduced where it is. Along axis 0 entries are exploded and summed on the map side first, so the
shuffle carries one row for each task and place. Of equal extremes the least index counts; NaN is the largest number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axisflow.functions.lineage import kept

_FOLD = {"sum": (0.0, lambda s, x: s + x), "prod": (1.0, lambda s, x: s * x)}


def along_row(v: Column, op: str) -> Column:
    """The reduction of an array: sum, prod, max, min, argmax, argmin. Of an empty array: 0, 1, or null."""
    if op in _FOLD:
        zero, f = _FOLD[op]
        return F.aggregate(v, F.lit(zero), lambda s, x: f(s, x.cast("double")))
    best = {"max": F.array_max, "argmax": F.array_max, "min": F.array_min, "argmin": F.array_min}[op](v)
    return best if op in ("max", "min") else F.nullif(F.array_position(v, best), F.lit(0)) - 1


def aggregate_of(x: Column, op: str, index: Column | None = None) -> Column:
    """The reduction as an aggregate function; argmax and argmin give the least index among equals."""
    if op == "argmax":
        return -F.max(F.struct(x.alias("x"), (-index).alias("i")))["i"]
    if op == "argmin":
        return F.min(F.struct(x.alias("x"), index.alias("i")))["i"]
    return {"sum": F.sum, "prod": F.product, "max": F.max, "min": F.min, "avg": F.avg, "count": F.count}[op](x)


def reduce_axis(df: DataFrame, op: str, axis: int, key: str = "i", column: str = "v") -> DataFrame:
    """axis 1: key, value. axis 0: pos, value. The reduced axis has one entry."""
    if axis == 1:
        return df.select(key, along_row(F.col(column), op).alias("value"))
    flat = df.select(key, F.posexplode(column).alias("pos", "x"))
    x = F.col("x").cast("double") if op in _FOLD else F.col("x")
    return flat.groupBy("pos").agg(aggregate_of(x, op, F.col(key)).alias("value"))


def as_row(reduced: DataFrame) -> DataFrame:
    """(pos, value) as one row: an array in order of pos. For results, which are one axis long."""
    return reduced.agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("_a")).select(F.lit(0).cast("long").alias("i"), F.transform("_a", lambda e: e["value"]).alias("v"))


def reduce_columns(df: DataFrame, op: str, columns: list[str], index: str | None = None) -> DataFrame:
    """One row: the reduction of every named column of a wide table."""
    return df.agg(*(aggregate_of(F.col(c), op, F.col(index) if index else None).alias(c) for c in columns))


def digit(key: Column, step: int) -> Column:
    """The step-th 4-bit digit of an integer, from the lowest."""
    return F.shiftright(key, 4 * step).bitwiseAND(F.lit(15)).cast("int")


def radix_histogram(df: DataFrame, key: str, block: Column, step: int) -> DataFrame:
    """block, digit, n: how often each digit occurs in a block."""
    return df.groupBy(block.alias("block"), digit(F.col(key), step).alias("digit")).agg(F.count(F.lit(1)).alias("n"))


def running(df: DataFrame, group: list[str], order: list[str], values: list[str]) -> DataFrame:
    """df with, for each of `values`, its sum up to and with the row in order within the group as `<value>_upto` and over the group as `<value>_all`.

    Rows are dealt out by ranges of group and order and kept; a window holds at most a partition of a group, and what
    lies before it comes from sums by partition, so that no task gets a whole group."""
    spread = kept(df.repartitionByRange(*group, *order)).withColumn("_p", F.spark_partition_id())
    parts = spread.groupBy("_p", *group).agg(*(F.sum(v).alias(f"_{v}") for v in values))
    of = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))  # a row for each partition and group
    before = of.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.coalesce(F.sum(f"_{v}").over(before), F.lit(0)).alias(f"_{v}_before") for v in values] + [F.sum(f"_{v}").over(of).alias(f"{v}_all") for v in values]
    inside = Window.partitionBy("_p", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = spread.select("*", *(F.sum(v).over(inside).alias(f"_{v}_inside") for v in values)).join(parts.select("_p", *group, *sums), ["_p", *group])
    return placed.select(*df.columns, *((F.col(f"_{v}_before") + F.col(f"_{v}_inside")).alias(f"{v}_upto") for v in values), *(f"{v}_all" for v in values))


def radix_offsets(histogram: DataFrame) -> DataFrame:
    """block, digit, n, before: entries before a block's digit, in order of digit, then block."""
    return running(histogram, [], ["digit", "block"], ["n"]).select("block", "digit", "n", (F.col("n_upto") - F.col("n")).alias("before"))


def radix_rank(df: DataFrame, key: str, pos: str, block: Column, step: int) -> DataFrame:
    """df with block, digit and rank: entries of the same block and digit before each one."""
    order = Window.partitionBy("block", "digit").orderBy(pos)
    return df.withColumns({"block": block, "digit": digit(F.col(key), step)}).withColumn("rank", (F.row_number().over(order) - 1).cast("long"))
