"""Element-wise operators: expressions for columns, and the same for rows held as arrays (i, v)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axisflow.errors import ShapeMismatch
from axisflow.functions.metadata import next_power_of_two


def negate(x: Column) -> Column:
    return -x


def one_minus(x: Column) -> Column:
    return F.lit(1.0) - x


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def each(df: DataFrame, op: Callable[[Column], Column], column: str = "v") -> DataFrame:
    """op on every entry of an array column."""
    return df.withColumn(column, F.transform(column, op))


def concat(a: DataFrame, b: DataFrame, key: str = "i", column: str = "v") -> DataFrame:
    """Rows with a key in both: the entries of a, then those of b."""
    return a.select(key, F.col(column).alias("_a")).join(b.select(key, F.col(column).alias("_b")), key).select(key, F.concat("_a", "_b").alias(column))


def stack(a: DataFrame, b: DataFrame, key: str = "i", column: str = "v") -> DataFrame:
    """Rows with a key in both: pairs of the entries of a and b, a last axis of two. Lengths must agree."""
    both = a.select(key, F.col(column).alias("_a")).join(b.select(key, F.col(column).alias("_b")), key)
    same = F.when(F.size("_a") == F.size("_b"), F.zip_with("_a", "_b", lambda x, y: F.array(x, y)))
    return both.select(key, F.coalesce(same, F.raise_error("stack: rows of unlike lengths")).alias(column))


def concat_rows(a: DataFrame, b: DataFrame, rows_of_a: int, key: str = "i", column: str = "v") -> DataFrame:
    """a, then b, whose row numbers go on after a's."""
    return a.select(key, column).unionByName(b.select((F.col(key) + rows_of_a).alias(key), column))


def fill(x: Column, n: Column | int) -> Column:
    """An array of n times the value."""
    return F.array_repeat(x, n)


def pad_to_power_of_two(x: Column, filler: Column) -> Column:
    """The array with fillers at its end, up to the next power of two."""
    n = F.size(x)
    wanted = F.when(n > 1, F.call_function("shiftleft", F.lit(1), F.length(F.bin(n - 1)))).otherwise(F.lit(1))
    return F.concat(x, F.array_repeat(filler, F.greatest(wanted - n, F.lit(0))))


#: The largest number of each type, which fills padding.
LARGEST = {"float": 3.4028234663852886e38, "double": 1.7976931348623157e308, "int": 2147483647, "bigint": 9223372036854775807}


def pad_rows(df: DataFrame, rows: int, width: int, kind: str = "double", key: str = "i", column: str = "v") -> DataFrame:
    """A table of `rows` rows of `width` entries with rows of the largest number up to the next power of two."""
    if kind not in LARGEST:
        raise ShapeMismatch(f"no largest number of type {kind}")
    more = df.sparkSession.range(rows, next_power_of_two(rows)).select(F.col("id").alias(key), F.array_repeat(F.lit(LARGEST[kind]).cast(kind), width).alias(column))
    return df.select(key, column).unionByName(more)


def filled(spark, shape: tuple[int, int], value: float = 0.0, key: str = "i", column: str = "v") -> DataFrame:
    """A table of the shape with one value everywhere."""
    return spark.range(shape[0]).select(F.col("id").alias(key), F.array_repeat(F.lit(float(value)), shape[1]).alias(column))


def reshape(df: DataFrame, shape: tuple[int, int], new: tuple[int, int], key: str = "i", column: str = "v") -> DataFrame:
    """Row-major reshape of (i, v): flat places are dealt out anew, gathered by the new row."""
    if shape[0] * shape[1] != new[0] * new[1]:
        raise ShapeMismatch(f"{shape} and {new} hold different numbers of elements")
    flat = df.select((F.col(key) * shape[1]).alias("_o"), F.posexplode(column).alias("_p", "_x")).select((F.col("_o") + F.col("_p")).alias("_f"), "_x")
    rows = flat.groupBy(F.floor(F.col("_f") / new[1]).cast("long").alias(key)).agg(F.array_sort(F.collect_list(F.struct("_f", "_x"))).alias("_a"))
    return rows.select(key, F.transform("_a", lambda e: e["_x"]).alias(column))
