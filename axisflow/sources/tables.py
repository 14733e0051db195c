"""Readers, generators and sinks."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axisflow.errors import DataTypeNotSupported, EmptyTable, InvalidConfig
from axisflow.sources.config import Source

#: Column that keeps the order of a source's rows.
RID = "__rid"


def read_csv(spark: SparkSession, path: str, names: tuple[str, ...] = (), delimiter: str = ",", header: bool = True) -> DataFrame:
    """All columns as text, empty fields as empty text, and RID in file order.

    The first line is a header and is left out; `names`, where given, replace its names. Records may hold quoted line
    ends; one of another length than the header is an error, also where its columns aren't selected.
    """
    reader = spark.read.option("header", header).option("sep", delimiter).option("quote", '"').option("escape", '"').option("multiLine", True).option("mode", "FAILFAST").option("enforceSchema", True)
    found = reader.option("inferSchema", False).csv(path)
    own = list(names) if names else found.columns
    if len(set(own)) != len(own):
        raise InvalidConfig("column names repeat")
    if len(own) != len(found.columns):
        raise InvalidConfig(f"{len(own)} names for {len(found.columns)} columns")
    table = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in own])).csv(path)
    order = F.monotonically_increasing_id()
    table = table.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in own), order.alias(RID))
    if table.isEmpty():
        raise EmptyTable(f"{path} has no rows")
    return table


def read_parquet(spark: SparkSession, path: str, order_by: str) -> DataFrame:
    """A Parquet table with RID from a column that orders its rows."""
    return spark.read.parquet(path).withColumn(RID, F.col(order_by).cast("long"))


READERS: dict[str, Callable[[SparkSession, Source], DataFrame]] = {
    "csv": lambda spark, s: read_csv(spark, s.path, s.scheme, s.delimiter, s.header),
    "parquet": lambda spark, s: read_parquet(spark, s.path, s.scheme[0] if s.scheme else "id"),
}


def load(spark: SparkSession, source: Source) -> DataFrame:
    if source.type not in READERS:
        raise DataTypeNotSupported(f"no reader for {source.type!r}")
    return READERS[source.type](spark, source)


def numbers_of(df: DataFrame, column: str | None = None) -> DataFrame:
    """The numbers of one column (the first, if none is named) as value; what isn't a number is left out."""
    c = F.trim(F.col(column or df.columns[0]).cast("string"))
    return df.select(c.alias("v")).where(F.col("v") != "").select(F.expr("try_cast(v AS double)").alias("value")).where("value IS NOT NULL")


def congruential(spark: SparkSession, n: int) -> DataFrame:
    """i, value in [0, 1]: the low 32 bits of a linear congruence of the row's number, as a share of 2**32 - 1."""
    low = F.lit(4294967295)
    # fixed values: the multiplier and the increment, whose high bits don't matter. Only i's low bits do, so nothing overflows
    x = (F.col("i").bitwiseAND(low) * F.lit(1284865837) + F.lit(4150755663)).bitwiseAND(low)
    return spark.range(n).withColumnRenamed("id", "i").withColumn("value", (x / F.lit(4294967295.0)).cast("float"))


def uniform(spark: SparkSession, n: int, low: float = 0.0, high: float = 1.0, seed: int = 0) -> DataFrame:
    """i, value: uniform floats in [low, high)."""
    return spark.range(n).withColumnRenamed("id", "i").withColumn("value", (F.rand(seed) * (high - low) + low).cast("float"))


def indices(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"), F.col("id").alias("value"))


def rank_pattern(spark: SparkSession, shards: int, n: int) -> DataFrame:
    """shard, pos, x = shard * 1000 + pos mod 1000."""
    flat = spark.range(shards * n)
    shard, pos = (F.col("id") / n).cast("long"), F.col("id") % n
    return flat.select(shard.cast("int").alias("shard"), pos.alias("pos"), (shard * 1000 + pos % 1000).cast("double").alias("x"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_verification(df: DataFrame, path: str, value: Column, expected: Column, index: Column, given: Column, tolerance: float = 1e-6) -> None:
    """index, input, sorted, expected, match: one row for each position."""
    write_csv(df.select(index.alias("index"), given.alias("input"), value.alias("sorted"), expected.alias("expected"), (F.abs(value - expected) < tolerance).alias("match")), path)


def write_timings(timings: DataFrame, path: str, summary: dict) -> None:
    """iteration, time_ms rows, and the summary as JSON beside them."""
    write_csv(timings.select("iteration", "time_ms"), path)
    timings.sparkSession.createDataFrame([(json.dumps(summary, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path.rstrip('/')}-summary")


def markdown(rows: list[dict], columns: list[str]) -> str:
    """A report table of few rows."""
    show = lambda v: f"{v:.3f}" if isinstance(v, float) else "" if v is None else str(v)
    lines = [f"| {' | '.join(columns)} |", "|" + "---|" * len(columns)]
    return "\n".join([*lines, *(f"| {' | '.join(show(r.get(c)) for c in columns)} |" for r in rows)]) + "\n"
