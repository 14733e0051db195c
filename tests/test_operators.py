import math
import random

import pytest
from pyspark.sql import functions as F

from axisflow import errors
from axisflow.functions.metadata import Metadata
from axisflow.operators import collectives, elementwise, reduce, sorting, stats
from axisflow.operators.placement import Tensors

NAN = float("nan")


def vectors(spark, *rows):
    return spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(rows)], "i long, v array<double>")


def values(df):
    return {r["i"]: list(r["v"]) for r in df.collect()}


def test_elementwise(spark):
    v = vectors(spark, [0, 1, -2])
    assert values(elementwise.each(v, elementwise.negate))[0] == [0, -1, 2]
    assert values(elementwise.each(v, elementwise.one_minus))[0] == [1, 0, 3]
    assert values(elementwise.each(v, elementwise.sigmoid))[0] == pytest.approx([1 / (1 + math.exp(-x)) for x in (0, 1, -2)])


def test_products_give_hessians(spark):
    v = vectors(spark, [0.25, 0.5])
    both = elementwise.stack(v, elementwise.each(v, elementwise.one_minus))
    assert [reduce_ for (reduce_,) in both.select(F.transform("v", lambda p: reduce.along_row(p, "prod"))).collect()] == [[0.1875, 0.25]]


def test_concat_stack_fill(spark):
    a, b = vectors(spark, [1, 2]), vectors(spark, [3, 4])
    assert values(elementwise.concat(a, b)) == {0: [1, 2, 3, 4]}
    assert values(elementwise.stack(a, b)) == {0: [[1, 3], [2, 4]]}
    assert values(elementwise.concat_rows(a, b, 1)) == {0: [1, 2], 1: [3, 4]}
    with pytest.raises(Exception, match="unlike"):
        elementwise.stack(a, vectors(spark, [1])).collect()
    assert values(elementwise.filled(spark, (2, 3), 7)) == {0: [7] * 3, 1: [7] * 3}


@pytest.mark.parametrize("n, padded", [(0, 1), (1, 1), (3, 4), (5, 8), (8, 8), (127, 128), (4097, 8192)])
def test_pad(spark, n, padded):
    got = values(vectors(spark, range(n)).withColumn("v", elementwise.pad_to_power_of_two(F.col("v"), F.lit(9e9))))[0]
    assert len(got) == padded and got[:n] == list(range(n)) and set(got[n:]) <= {9e9}


def test_pad_rows_and_reshape(spark):
    v = vectors(spark, [1, 2], [3, 4], [5, 6])
    assert values(elementwise.pad_rows(v, 3, 2))[3] == [elementwise.LARGEST["double"]] * 2
    assert values(elementwise.reshape(v, (3, 2), (2, 3))) == {0: [1, 2, 3], 1: [4, 5, 6]}
    with pytest.raises(errors.ShapeMismatch):
        elementwise.reshape(v, (3, 2), (2, 2))


@pytest.mark.parametrize("op, axis0, axis1", [("sum", [5, 7, 9], [6, 15]), ("prod", [4, 10, 18], [6, 120]), ("argmax", [1, 1, 1], [2, 2]), ("argmin", [0, 0, 0], [0, 0]), ("max", [4, 5, 6], [3, 6])])
def test_axes(spark, op, axis0, axis1):
    v = vectors(spark, [1, 2, 3], [4, 5, 6])
    assert [r["value"] for r in reduce.reduce_axis(v, op, 0).orderBy("pos").collect()] == axis0
    assert [r["value"] for r in reduce.reduce_axis(v, op, 1).orderBy("i").collect()] == axis1
    if op == "sum":
        assert values(reduce.as_row(reduce.reduce_axis(v, op, 0))) == {0: axis0}


def test_extremes_take_the_least_index(spark):
    v = vectors(spark, [3, 1, 3, 1])
    assert reduce.reduce_axis(v, "argmax", 1).first()["value"] == 0 and reduce.reduce_axis(v, "argmin", 1).first()["value"] == 1
    t = vectors(spark, [3], [1], [3], [1])
    assert reduce.reduce_axis(t, "argmax", 0).first()["value"] == 0 and reduce.reduce_axis(t, "argmin", 0).first()["value"] == 1
    assert reduce.reduce_axis(vectors(spark, [1, NAN, 2]), "argmax", 1).first()["value"] == 1
    assert reduce.reduce_axis(vectors(spark, []), "argmax", 1).first()["value"] is None
    assert reduce.reduce_axis(vectors(spark, []), "sum", 1).first()["value"] == 0


@pytest.mark.parametrize("n", [0, 1, 3, 127, 4097])
def test_sorts_are_ordered_permutations(spark, n):
    rng = random.Random(n)
    x = [rng.choice([rng.uniform(-5000, 5000), 3.0, -0.5]) for _ in range(n)]
    row = vectors(spark, x).select(sorting.sorted_row(F.col("v")).alias("s"), sorting.argsorted_row(F.col("v")).alias("a")).first()
    assert list(row["s"]) == sorted(x) == list(row["a"]["values"])
    order = sorted(range(n), key=lambda i: (x[i], i))
    assert list(row["a"]["indices"]) == order
    t = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i long, x double")
    got = sorting.argsort_table(t, "x", "i").orderBy("pos").collect()
    assert [r["index"] for r in got] == order and [r["pos"] for r in got] == list(range(n))
    assert sorting.indices_valid(t, sorting.argsort_table(t, "x", "i")).first()["valid"]
    assert sorting.first_descent(sorting.with_positions(t.select("x"), "x")).first()["first_descent"] is None


def test_special_values_in_order(spark):
    t = spark.createDataFrame([(NAN,), (None,), (math.inf,), (-math.inf,), (0.0,), (-1.0,)], "x double")
    got = [r["x"] for r in sorting.with_positions(t, "x").orderBy("pos").collect()]
    assert got[0] is None and got[1:5] == [-math.inf, -1.0, 0.0, math.inf] and math.isnan(got[5])


def test_radix_passes_sort(spark):
    rng = random.Random(1)
    keys = [rng.randrange(1 << 12) for _ in range(1000)]
    df = spark.createDataFrame(list(enumerate(keys)), "pos long, key long")
    for step in range(3):
        df = sorting.radix_pass(df, "key", "pos", step, 64)
    assert [r["key"] for r in df.orderBy("pos").collect()] == sorted(keys)


def test_float_bits(spark):
    x = [0.0, -0.0, 1.5, -1.5, math.inf, -math.inf, 0.1]
    df = spark.createDataFrame([(v,) for v in x], "x float").withColumn("u", sorting.ordered_bits(F.col("x")))
    rows = df.withColumn("y", sorting.float_of_bits(F.col("u"))).orderBy("u").collect()
    assert [r["x"] for r in rows] == pytest.approx(sorted(x)) and all(r["x"] == r["y"] for r in rows)


def test_match_rate_and_descent(spark):
    a = spark.createDataFrame([(0, 1.0), (1, 3.0), (2, 2.0)], "pos long, x double")
    b = spark.createDataFrame([(0, 1.0), (1, 2.0)], "pos long, x double")
    assert sorting.first_descent(a).first()["first_descent"] == 2
    r = sorting.match_rate(a, b).first()
    assert (r["n"], r["matches"]) == (3, 1)
    first, last = sorting.preview(a, "x", 1)
    assert first.first()["x"] == 1.0 and last.first()["x"] == 3.0


def shards(spark):
    return spark.createDataFrame([(s, p, float(s * 10 + p)) for s in range(4) for p in range(8)], "shard int, pos long, x double")


def test_collectives(spark):
    df = shards(spark)
    total = {(r["shard"], r["pos"]): r["x"] for r in collectives.all_reduce(df, "sum", 4).collect()}
    assert len(total) == 32 and total[3, 2] == sum(s * 10 + 2 for s in range(4))
    gathered = collectives.all_gather(df, 8, 4)
    by_gather = gathered.where("shard = 0").groupBy((F.col("pos") % 8).alias("pos")).agg(F.sum("x").alias("x"))
    assert {r["pos"]: r["x"] for r in by_gather.collect()} == {p: total[0, p] for p in range(8)}
    scattered = {(r["shard"], r["pos"]): r["x"] for r in collectives.reduce_scatter(df, "max", 8, 4).collect()}
    assert scattered == {(p // 2, p % 2): 30.0 + p for p in range(8)}
    assert {r["x"] for r in collectives.broadcast(df, 2, 4).collect()} == {20.0 + p for p in range(8)}


def test_collective_errors(spark):
    df = shards(spark)
    with pytest.raises(errors.ShapeMismatch):
        collectives.reduce_scatter(df, "sum", 7, 4)
    with pytest.raises(errors.UnknownShard):
        collectives.broadcast(df, 4, 4)
    with pytest.raises(ValueError):
        collectives.all_reduce(df, "custom", 4)
    with pytest.raises(errors.UnsupportedType):
        collectives.all_reduce(df.withColumn("x", F.col("x").cast("int")), "sum", 4)


def test_stats(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 21)] + [("b", 5.0), ("b", None)], "g string, x double")
    rows = {r["g"]: r for r in stats.summary(df, "g", "x").collect()}
    a, b = rows["a"], rows["b"]
    assert (a["n"], a["median"], a["p95"], a["p99"]) == (20, 10.5, 20.0, 20.0)
    assert a["std"] == pytest.approx(math.sqrt(33.25)) and a["jitter_percent"] == pytest.approx(19 / 10.5 * 100)
    assert (b["n"], b["median"], b["p95"], b["std"]) == (1, 5.0, 5.0, 0.0)
    r = spark.range(1).select(stats.sort_rating(F.lit(4.0)), stats.collective_rating(F.lit(0.5), F.lit(7.0)), stats.throughput(F.lit(1 << 30), F.lit(500.0)), stats.improvement(F.lit(4.0), F.lit(1.0))).first()
    assert tuple(r) == ("Good", "Good", 2.0, 75.0)


def test_tensors(spark):
    t = Tensors(spark, 3)
    a = t.send_parts([[1, 2], [3, 4], [5, 6]], [Metadata.vector(2)] * 3)
    b = t.send([9, 9], Metadata.vector(2), 1)
    assert t.read(a, 2) == [5, 6] and t.nbytes(a) == 48
    c = t.apply(lambda d: d.withColumn("x", -F.col("x")), a)
    assert t.read_all(c) == {0: [-1, -2], 1: [-3, -4], 2: [-5, -6]}
    with pytest.raises(errors.UnknownShard):
        t.apply(lambda x, y: x, a, b)
    d = t.apply(lambda x, y: x.unionByName(y).groupBy("shard", "pos").agg(F.sum("x").alias("x")), a, b, strict=False)
    assert t.read_all(d) == {1: [12, 13]}
    e = t.send_everywhere([7], Metadata.scalar())
    assert t.read(e, 0) == t.read(e, 2) == [7]
    assert t.read(t.empty(Metadata.vector(3), 0), 0) == [0, 0, 0] and len(t.read_all(t.empty_everywhere(Metadata.scalar()))) == 3
    t.sync(a)
    t.remove(a)
    assert not t.exists(a) and t.exists(b)
    with pytest.raises(errors.UnknownTensor):
        t.read(a, 0)
    with pytest.raises(errors.UnknownShard):
        t.send([1], Metadata.scalar(), 5)
    t.shutdown()
    assert t.numbers() == []
