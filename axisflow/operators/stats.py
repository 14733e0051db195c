"""Statistics of timed runs, by group.

Quantiles are places in a global order of (group, value), so no task or driver holds a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axisflow.operators.sorting import with_positions


def summary(df: DataFrame, by: str, x: str) -> DataFrame:
    """by, n, min, max, mean, median, std (population), p95, p99, cv_percent, jitter_percent.

    A quantile p is the value at place min(floor(n p), n - 1) of the sorted ones; the median averages the middle two.
    Null values are left out. Coefficients of a mean of 0 are null."""
    own = df.select(F.col(by).alias("g"), F.col(x).cast("double").alias("x")).where("x IS NOT NULL")
    placed = with_positions(own, "g", "x")
    groups = placed.groupBy("g").agg(F.count("x").alias("n"), F.min("pos").alias("_s"), F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    at = lambda p: F.least(F.floor(F.col("n") * F.lit(p)), F.col("n") - 1).cast("long")
    wanted = groups.select("g", F.explode(F.array(
        *(F.struct(F.lit(k).alias("what"), (F.col("_s") + v).alias("pos")) for k, v in (("low", F.floor((F.col("n") - 1) / 2).cast("long")), ("high", F.floor(F.col("n") / 2).cast("long")), ("p95", at(0.95)), ("p99", at(0.99))))
    )).alias("w")).select("g", "w.*")
    found = wanted.join(placed.select("pos", "x"), "pos").groupBy("g").agg(*(F.max(F.when(F.col("what") == k, F.col("x"))).alias(k) for k in ("low", "high", "p95", "p99")))
    cv, jitter = F.try_divide(F.col("std"), F.col("mean")) * 100, F.try_divide(F.col("max") - F.col("min"), F.col("mean")) * 100
    joined = groups.join(found, groups["g"].eqNullSafe(found["g"])).drop(found["g"])
    return joined.select(F.col("g").alias(by), "n", "min", "max", "mean", ((F.col("low") + F.col("high")) / 2).alias("median"), "std", "p95", "p99", cv.alias("cv_percent"), jitter.alias("jitter_percent"))


def throughput(nbytes: Column, milliseconds: Column) -> Column:
    """GiB a second."""
    return F.try_divide(nbytes / F.lit(float(1 << 30)), milliseconds / 1000)


def sort_rating(cv: Column) -> Column:
    return F.when(cv < 3, "Excellent").when(cv < 5, "Good").when(cv < 10, "Fair").otherwise("Variable")


def collective_rating(cv: Column, jitter: Column) -> Column:
    return F.when((cv < 1) & (jitter < 5), "Excellent").when((cv < 3) & (jitter < 10), "Good").when(cv < 5, "Fair").otherwise("Variable")


def improvement(cold: Column, warm: Column) -> Column:
    """Percent of the cold time that a warm run saves."""
    return F.try_divide(cold - warm, cold) * 100
