"""Connected components by alternating large and small stars, wholly in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisflow.llm.common import apart, removed, stored


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, root: the smallest node of its component, for every node of an edge but the roots themselves. Nodes are longs.

    Every round hangs each node's larger neighbours, then its smaller ones, on the least node it knows, until nothing
    changes; rounds grow with the logarithm of a component's size. A round keeps its result in the shared folder, where
    the one before is then removed; minima are pre-aggregated, and large stars are joins that Spark can split, not lists.
    Edges with a null end and loops link nothing.
    """
    spark = edges.sparkSession
    links = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    (links, path), before = stored(links.distinct(), "links"), None
    while True:
        ends = links.select(F.col("lo").alias("node"), F.col("lo").alias("m")).unionAll(links.select("hi", "lo"))
        low = ends.groupBy("node").agg(F.min("m").alias("m")).select(apart("node").alias("node"), "m")
        large = links.join(low, links["lo"] == low["node"]).select("hi", F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m")).select(apart("hi").alias("node"), "m")
        small = large.join(least, large["hi"] == least["node"]).select(F.explode(F.array(F.struct(F.col("hi"), F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e")).select("e.*").where("hi != lo").distinct()
        old = path
        links, path = stored(small, "links")
        removed(spark, old)
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == before:
            return links.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        before = now
