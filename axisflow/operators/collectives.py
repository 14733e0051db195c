"""Collectives over tensors held as (shard, pos, x): each shard has one part of a logical tensor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axisflow.errors import ShapeMismatch, UnknownShard, UnsupportedType
from axisflow.operators.reduce import aggregate_of

OPERATIONS = ("sum", "prod", "max", "min", "avg")


def _checked(df: DataFrame, op: str | None = None) -> DataFrame:
    kind = df.schema["x"].dataType.simpleString()
    if kind not in ("float", "double"):
        raise UnsupportedType(f"collectives take float or double, not {kind}")
    if op is not None and op not in OPERATIONS:
        raise ValueError(f"no reduction {op!r}")
    return df


def _on_all(shards: int) -> Column:
    """One row for every shard: a generator, not a join."""
    return F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))


def all_reduce(df: DataFrame, op: str, shards: int) -> DataFrame:
    """Every shard gets the reduction over the shards, place by place. Reduced once, then repeated."""
    reduced = _checked(df, op).groupBy("pos").agg(aggregate_of(F.col("x"), op).alias("x"))
    return reduced.select(_on_all(shards).alias("shard"), "pos", "x")


def broadcast(df: DataFrame, root: int, shards: int) -> DataFrame:
    """Every shard gets the root's part."""
    if not 0 <= root < shards:
        raise UnknownShard(f"no shard {root}")
    return _checked(df).where(F.col("shard") == root).select(_on_all(shards).alias("shard"), "pos", "x")


def all_gather(df: DataFrame, n: int | list[int], shards: int) -> DataFrame:
    """Every shard gets all parts in order of the shards, of n places each or of as many as n has for each."""
    places = [n] * shards if isinstance(n, int) else n
    before = F.array(*(F.lit(sum(places[:k])).cast("long") for k in range(shards)))
    return _checked(df).select((F.get(before, F.col("shard")) + F.col("pos")).alias("pos"), "x", _on_all(shards).alias("shard")).select("shard", "pos", "x")


def reduce_scatter(df: DataFrame, op: str, n: int, shards: int) -> DataFrame:
    """The reduction over the shards, of which each keeps its n / shards places, numbered from 0."""
    if n % shards:
        raise ShapeMismatch(f"{n} places can't be dealt out to {shards} shards")
    own = n // shards
    reduced = _checked(df, op).groupBy("pos").agg(aggregate_of(F.col("x"), op).alias("x"))
    return reduced.select(F.floor(F.col("pos") / own).cast("int").alias("shard"), (F.col("pos") % own).cast("long").alias("pos"), "x")
