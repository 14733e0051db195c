"""Named queries over the operators of the engine, and the SQL that DuckDB checks them with."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axisflow.operators import collectives, elementwise, gbdt, groups, reduce, sorting, staging, stats
from axisflow.sources import tables

SHARDS = 4
#: Splits and weights of the checked trees: a margin of 0 makes all gradients and hessians exact.
TREE = gbdt.GbdtConfig(max_depth=1, n_trees=1)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark, sf_dir):
    return _table(spark, sf_dir, "events").withColumn(tables.RID, F.col("event_id"))


def _vectors(spark, sf_dir):
    """i, v: embeddings as doubles."""
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i"), F.col("embedding").cast("array<double>").alias("v"))


def _numbered(spark, sf_dir):
    """i, v with i numbered from 0 in order of the ids; the number of rows; the width of the longest."""
    v = sorting.with_positions(_vectors(spark, sf_dir), "i").select(F.col("pos").alias("i"), "v")
    n, width = v.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    return v, n, width


def _long(df: DataFrame, decimals: int | None = None) -> DataFrame:
    """i, pos, x of (i, v)."""
    flat = df.select("i", F.posexplode("v").alias("pos", "x"))
    return flat if decimals is None else flat.withColumn("x", F.round("x", decimals))


def flagship(spark, sf_dir):
    """Encode a column, turn the table into floats, sum a column for each category."""
    events = _events(spark, sf_dir).select(tables.RID, "event_type", F.col("value").cast("string").alias("value"))
    encoded, _ = staging.encode(events, "event_type")
    table = staging.to_float_table(encoded)
    return table.groupBy(F.col("event_type").cast("int").alias("category")).agg(F.round(F.sum(F.col("value").cast("double")), 2).alias("total"), F.count(F.lit(1)).alias("n"))


def stage_categories(spark, sf_dir):
    encoded, _ = staging.encode(_events(spark, sf_dir).select(tables.RID, "event_id", "event_type"), "event_type")
    return encoded.select("event_id", "event_type")


def stage_category_dictionary(spark, sf_dir):
    return staging.dictionary(_events(spark, sf_dir), "event_type")


def stage_to_f32(spark, sf_dir):
    e = _events(spark, sf_dir).select("event_id", F.col("value").cast("string").alias("value"), "props")
    out = staging.to_float_table(e, keep=("event_id",))
    null = lambda c: F.when(~F.isnan(c), F.round(F.col(c).cast("double"), 3))
    return out.select("event_id", null("value").alias("value"), F.isnan("value").alias("value_nan"), F.isnan("props").alias("props_nan"))


def csv_numeric_column(spark, sf_dir):
    """Text columns of numbers and of other texts: what isn't a number is left out."""
    e = _table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 3 == 0, F.col("props")).otherwise(F.col("user_id").cast("string")).alias("c"))
    return tables.numbers_of(e, "c").groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def generate_congruential(spark, sf_dir):
    return tables.congruential(spark, 100_000).select("i", F.round(F.col("value").cast("double"), 6).alias("value"))


def generate_rank_pattern(spark, sf_dir):
    return tables.rank_pattern(spark, SHARDS, 2_500)


def generate_indices(spark, sf_dir):
    return tables.indices(spark, 10_000)


def merge_rows(spark, sf_dir):
    """Each vector and its negation, merged into one sorted row."""
    v = _vectors(spark, sf_dir)
    return _long(v.withColumn("v", sorting.merged_rows(sorting.sorted_row(F.col("v")), sorting.sorted_row(F.transform("v", elementwise.negate)))))


def float_bits(spark, sf_dir):
    """Entries by the order of their bits, and back."""
    flat = _long(_vectors(spark, sf_dir)).withColumn("u", sorting.ordered_bits(F.col("x")))
    return flat.select("i", "pos", "u", sorting.float_of_bits(F.col("u")).cast("double").alias("x"))


def preview_ends(spark, sf_dir):
    """The first and the last 64 order keys."""
    first, last = sorting.preview(_table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")
    return first.withColumn("what", F.lit("first")).unionByName(last.withColumn("what", F.lit("last")))


def _line(spark, sf_dir, op):
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(op(F.col("l_discount")), 9).alias("value"))
    return lines.groupBy("l_orderkey", "l_linenumber", "l_partkey", "value").agg(F.count(F.lit(1)).alias("n"))


def _rows(spark, sf_dir, op):
    return _long(elementwise.each(_vectors(spark, sf_dir), op), 9)


def ew_concat(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return _long(elementwise.concat(v, elementwise.each(v, elementwise.negate)), 9)


def ew_stack(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    both = elementwise.stack(v, elementwise.each(v, elementwise.one_minus)).select("i", F.posexplode("v").alias("pos", "p"))
    return both.select("i", "pos", F.round(F.col("p")[0], 9).alias("a"), F.round(F.col("p")[1], 9).alias("b"))


def ew_fill(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("i"), elementwise.fill(F.col("o_totalprice"), 3).alias("v"))
    return _long(o)


def ew_pad_pow2(spark, sf_dir):
    v = _vectors(spark, sf_dir).withColumn("v", F.slice("v", 1, (F.col("i") % 60 + 1).cast("int")))
    return _long(v.withColumn("v", elementwise.pad_to_power_of_two(F.col("v"), F.lit(elementwise.LARGEST["float"]))))


def ew_reshape(spark, sf_dir):
    """Rows in halves; rows of an odd width in single entries."""
    v, n, width = _numbered(spark, sf_dir)
    parts = width if width % 2 else 2
    return _long(elementwise.reshape(v, (n, width), (n * parts, width // parts)))


def _reduced(spark, sf_dir, op, axis):
    v = _vectors(spark, sf_dir)
    if op == "prod":
        v = elementwise.each(v, lambda x: 1 + x / 100)
    out = reduce.reduce_axis(v, op, axis)
    return out.withColumn("value", F.round("value", 6) if op in ("sum", "prod") else F.col("value").cast("long"))


def red_columns(spark, sf_dir):
    e = _table(spark, sf_dir, "orders")
    low = reduce.reduce_columns(e, "argmin", ["o_totalprice"], "o_orderkey").withColumnRenamed("o_totalprice", "argmin")
    high = reduce.reduce_columns(e, "argmax", ["o_totalprice"], "o_orderkey").withColumnRenamed("o_totalprice", "argmax")
    return low.select(F.lit("argmin").alias("what"), F.col("argmin").alias("o_orderkey")).unionAll(high.select(F.lit("argmax"), F.col("argmax")))


def _radix(spark, sf_dir):
    return _table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), F.col("user_id").alias("key"))


def radix_histogram(spark, sf_dir):
    return reduce.radix_histogram(_radix(spark, sf_dir), "key", F.floor(F.col("pos") / 256).cast("long"), 1)


def radix_offsets(spark, sf_dir):
    return reduce.radix_offsets(radix_histogram(spark, sf_dir))


def radix_rank(spark, sf_dir):
    return reduce.radix_rank(_radix(spark, sf_dir), "key", "pos", F.floor(F.col("pos") / 256).cast("long"), 1)


def radix_pass(spark, sf_dir):
    return sorting.radix_pass(_radix(spark, sf_dir).withColumn("row", F.col("pos")), "key", "pos", 0)


def sort_axis1(spark, sf_dir):
    return _long(_vectors(spark, sf_dir).withColumn("v", sorting.sorted_row(F.col("v"))))


def sort_axis1_desc(spark, sf_dir):
    return _long(_vectors(spark, sf_dir).withColumn("v", sorting.sorted_row(F.col("v"), descending=True)))


def argsort_axis1(spark, sf_dir):
    s = _vectors(spark, sf_dir).select("i", sorting.argsorted_row(F.col("v")).alias("s"))
    return s.select("i", F.posexplode(F.arrays_zip("s.values", "s.indices")).alias("pos", "e")).select("i", "pos", F.col("e.values").alias("x"), F.col("e.indices").alias("index"))


def sort_global(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("x"), "o_orderkey")
    return sorting.with_positions(o, "x", "o_orderkey").select("pos", "x")


def argsort_stable(spark, sf_dir):
    return sorting.argsort_table(_table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey")


def sort_verify(spark, sf_dir):
    """The first descent of a sorted column, and of the unsorted one."""
    o = _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("x"))
    given = sorting.with_positions(o, "o_orderkey")
    ordered = sorting.with_positions(o.select("x"), "x")
    return sorting.first_descent(given).select(F.lit("given").alias("what"), "first_descent").unionAll(sorting.first_descent(ordered).select(F.lit("sorted"), "first_descent"))


def sort_match_rate(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("x"))
    a, b = sorting.with_positions(o, "o_orderkey"), sorting.with_positions(o, "x", "o_orderkey")
    return sorting.match_rate(a, b).withColumn("percent", F.round("percent", 6))


def sort_indices_valid(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    return sorting.indices_valid(o.select(F.col("o_orderkey").alias("i"), F.col("o_totalprice").alias("x")), sorting.argsort_table(o, "o_totalprice", "o_orderkey"))


def _shards(spark, sf_dir):
    """shard, pos, x, and the places of each shard: every fourth row's entries on a shard, its rows one after another.

    Shards have unequal parts where the rows can't be dealt out evenly; places a shard doesn't have take no part."""
    v, rows, width = _numbered(spark, sf_dir)
    v = v.select((F.col("i") % SHARDS).cast("int").alias("shard"), F.floor(F.col("i") / SHARDS).cast("long").alias("r"), F.posexplode("v").alias("p", "x"))
    return v.select("shard", (F.col("r") * width + F.col("p")).alias("pos"), "x"), [(rows - k + SHARDS - 1) // SHARDS * width for k in range(SHARDS)]


def _all_reduce(spark, sf_dir, op):
    return collectives.all_reduce(_shards(spark, sf_dir)[0], op, SHARDS).withColumn("x", F.round("x", 6))


def _reduce_scatter(spark, sf_dir, op):
    parts, places = _shards(spark, sf_dir)
    return collectives.reduce_scatter(parts, op, -(-places[0] // SHARDS) * SHARDS, SHARDS).withColumn("x", F.round("x", 6))


def coll_all_gather(spark, sf_dir):
    return collectives.all_gather(*_shards(spark, sf_dir), SHARDS)


def coll_broadcast(spark, sf_dir):
    return collectives.broadcast(_shards(spark, sf_dir)[0], 2, SHARDS)


def _labelled(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), (F.col("label") >= 5).cast("double").alias("y"))
    g, h = gbdt.gradients(F.col("y"), F.lit(0.0))
    return e.withColumns({"g": g, "h": h, "node": F.lit(0)})


def gbdt_gradients(spark, sf_dir):
    g, h = gbdt.gradients(F.col("y"), F.col("v")[0])
    return _labelled(spark, sf_dir).select("vec_id", F.round(g, 9).alias("g"), F.round(h, 9).alias("h"))


def gbdt_best_split(spark, sf_dir):
    best = gbdt.best_splits(gbdt.exploded(_labelled(spark, sf_dir)), TREE)
    return best.select("feature", F.round("x", 9).alias("x"), F.round("gain", 6).alias("gain"))


def _stump(spark, sf_dir):
    rows = _labelled(spark, sf_dir).select("v", "g", "h")
    width = rows.select(F.max(F.size("v"))).first()[0] or 0
    return gbdt.trees_table(spark, [gbdt.grow(rows, width, TREE, 0)])


def gbdt_leaf_weights(spark, sf_dir):
    return _stump(spark, sf_dir).where("leaf").select("node", F.round("weight", 6).alias("weight"))


def gbdt_importance(spark, sf_dir):
    return gbdt.importance(_stump(spark, sf_dir)).select("feature", F.round("importance", 6).alias("importance"))


#: Trees of the trained query: all rows and features, fewer and lower trees than the operator's defaults (README has why).
FEW_TREES = gbdt.GbdtConfig(max_depth=3, n_trees=10)


def gbdt_train_predict(spark, sf_dir):
    c = FEW_TREES
    rows = _labelled(spark, sf_dir).select("vec_id", "v", "y")
    return gbdt.predict(rows, gbdt.train(rows, c, "y"), c).select("vec_id", "y", "margin", "probability")


def stats_run_summary(spark, sf_dir):
    s = stats.summary(_table(spark, sf_dir, "events"), "event_type", "value")
    return s.select("event_type", "n", *(F.round(c, 6).alias(c) for c in s.columns if c not in ("event_type", "n")))


def stats_rating(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select((F.col("user_id") % 97).alias("run"), (100 + F.col("value") / 100).alias("ms"))
    s = stats.summary(e, "run", "ms")
    return s.select("run", stats.sort_rating(F.col("cv_percent")).alias("sort_rating"), stats.collective_rating(F.col("cv_percent"), F.col("jitter_percent")).alias("collective_rating"))


def stats_throughput(spark, sf_dir):
    e = _table(spark, sf_dir, "events").where("value > 0").groupBy("event_type").agg(stats.throughput(F.count(F.lit(1)) * 1048576, F.sum("value")).alias("mean"), F.max(stats.throughput(F.lit(1048576), F.col("value"))).alias("peak"), F.min("value").alias("_w"), F.max("value").alias("_c"))
    return e.select("event_type", F.round("mean", 6).alias("mean"), F.round("peak", 6).alias("peak"), F.round(stats.improvement(F.col("_c"), F.col("_w")), 6).alias("improvement"))


def group_metrics(spark, sf_dir):
    log = _table(spark, sf_dir, "events").select(F.col("event_type").alias("group"), (F.col("user_id") % 3).cast("string").alias("strategy"), F.col("event_id").alias("at"), (F.col("value") + 1).alias("ms"), F.lit(1048576).alias("nbytes"), (F.col("event_id") % 10 != 0).alias("ok"))
    m = groups.metrics_table(log)
    return m.select("group", "strategy", "runs", *(F.round(c, 6).alias(c) for c in ("success_rate", "mean_ms", "min_ms", "max_ms", "throughput")))


def load_balance_pick(spark, sf_dir):
    log = _table(spark, sf_dir, "events").select(F.col("event_type").alias("group"), (F.col("user_id") % 8).alias("worker"), F.floor("value").cast("long").alias("load"))
    return groups.least_loaded(log)


def queries() -> dict:
    single = (
        flagship, stage_categories, stage_category_dictionary, stage_to_f32, csv_numeric_column, generate_congruential, generate_rank_pattern, generate_indices, merge_rows, float_bits, preview_ends,
        ew_concat, ew_stack, ew_fill, ew_pad_pow2, ew_reshape, red_columns, radix_histogram, radix_offsets, radix_rank, radix_pass,
        sort_axis1, sort_axis1_desc, argsort_axis1, sort_global, argsort_stable, sort_verify, sort_match_rate, sort_indices_valid,
        coll_all_gather, coll_broadcast, gbdt_gradients, gbdt_best_split, gbdt_leaf_weights, gbdt_importance, gbdt_train_predict,
        stats_run_summary, stats_rating, stats_throughput, group_metrics, load_balance_pick,
    )
    out = {f.__name__: f for f in single}
    for name, op in (("negate", elementwise.negate), ("one_minus", elementwise.one_minus), ("sigmoid", elementwise.sigmoid)):
        out[f"ew_{name}"] = partial(_line, op=op)
        out[f"ew_{name}_rows"] = partial(_rows, op=op)
    for op in ("sum", "prod", "argmax", "argmin"):
        for axis in (0, 1):
            out[f"red_{op}_axis{axis}"] = partial(_reduced, op=op, axis=axis)
    for op in collectives.OPERATIONS:
        out[f"coll_all_reduce_{op}"] = partial(_all_reduce, op=op)
        out["coll_reduce_scatter" if op == "sum" else f"coll_reduce_scatter_{op}"] = partial(_reduce_scatter, op=op)
    return out


_LONG = "(SELECT vec_id AS i, CAST(unnest(range(len(embedding))) AS INT) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"
#: m: the 31 bits below the sign of a normal float, from its exponent e and fraction; zero has none.
_BITS = f"""SELECT i, pos, x, CASE WHEN x = 0 THEN 0 ELSE CAST((e + 127) * 8388608 + (abs(x) / pow(2, e) - 1) * 8388608 AS BIGINT) END AS m
  FROM (SELECT *, CASE WHEN x = 0 THEN 0 ELSE floor(log2(abs(x))) + CASE WHEN abs(x) < pow(2, floor(log2(abs(x)))) THEN -1 WHEN abs(x) >= pow(2, floor(log2(abs(x))) + 1) THEN 1 ELSE 0 END END AS e FROM {_LONG})"""
_IDS = "(SELECT event_type, CAST(row_number() OVER (ORDER BY min(event_id)) - 1 AS INT) AS id FROM events GROUP BY event_type)"
_NUMBER = r"'^[+-]?(inf|infinity|nan|([0-9]+(\.[0-9]*)?|\.[0-9]+)(e[+-]?[0-9]+)?)$'"
#: i from 0 in order of the ids, the number of rows n, the width w of the longest.
_NUMBERED = """(SELECT i, n, w, CAST(unnest(range(len(e))) AS INT) AS pos, CAST(unnest(e) AS DOUBLE) AS x FROM (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS i, count(*) OVER () AS n, max(len(embedding)) OVER () AS w, embedding AS e FROM embeddings))"""
_SHARD = f"(SELECT CAST(i % 4 AS INT) AS shard, CAST(i // 4 * w + pos AS BIGINT) AS pos, x, n, w FROM {_NUMBERED})"
_EACH = "(SELECT CAST(unnest(range(4)) AS INT) AS shard)"
_RADIX = "(SELECT event_id // 256 AS block, CAST((user_id >> 4) & 15 AS INT) AS digit, event_id AS pos, user_id AS key FROM events)"
_ROWS = "(SELECT vec_id, CAST(label >= 5 AS INT) AS y, CAST(unnest(range(len(embedding))) AS INT) AS feature, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"
_SPLITS = f"""(
  SELECT feature, x, max(gl) AS gl, max(hl) AS hl, max(g) AS g, max(h) AS h FROM (
    SELECT feature, x, sum(0.5 - y) OVER w AS gl, sum(0.25) OVER w AS hl, sum(0.5 - y) OVER (PARTITION BY feature) AS g, sum(0.25) OVER (PARTITION BY feature) AS h
    FROM {_ROWS} WINDOW w AS (PARTITION BY feature ORDER BY x RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
  GROUP BY feature, x)"""
_BEST = f"""(
  SELECT feature, x, 0.5 * (gl * gl / (hl + 1) + (g - gl) * (g - gl) / (h - hl + 1) - g * g / (h + 1)) AS gain
  FROM {_SPLITS} WHERE hl >= 1 AND h - hl >= 1 ORDER BY gain DESC, feature, x LIMIT 1)"""


def oracle_sql() -> dict:
    out = {
        "flagship": f"SELECT id AS category, round(sum(CAST(CAST(value AS FLOAT) AS DOUBLE)), 2) AS total, count(*) AS n FROM events JOIN {_IDS} USING (event_type) GROUP BY id",
        "stage_categories": f"SELECT event_id, id AS event_type FROM events JOIN {_IDS} USING (event_type)",
        "stage_category_dictionary": f"SELECT event_type AS category, id FROM {_IDS}",
        "stage_to_f32": f"SELECT event_id, round(CAST(CAST(value AS FLOAT) AS DOUBLE), 3) AS value, value IS NULL AS value_nan, NOT coalesce(regexp_matches(lower(props), {_NUMBER}), false) AS props_nan FROM events",
        "csv_numeric_column": "SELECT value, count(*) AS n FROM (SELECT try_cast(trim(CASE WHEN event_id % 3 = 0 THEN props ELSE CAST(user_id AS VARCHAR) END) AS DOUBLE) AS value FROM events) WHERE value IS NOT NULL GROUP BY value",
        "generate_congruential": "SELECT range AS i, round(CAST(CAST(((range * 1284865837 + 4150755663) & 4294967295) / 4294967295.0 AS FLOAT) AS DOUBLE), 6) AS value FROM range(100000)",
        "generate_rank_pattern": "SELECT CAST(range // 2500 AS INT) AS shard, range % 2500 AS pos, CAST(range // 2500 * 1000 + range % 2500 % 1000 AS DOUBLE) AS x FROM range(10000)",
        "generate_indices": "SELECT range AS i, range AS value FROM range(10000)",
        "merge_rows": f"SELECT i, CAST(row_number() OVER (PARTITION BY i ORDER BY x) - 1 AS INT) AS pos, x FROM (SELECT i, x FROM {_LONG} UNION ALL SELECT i, -x FROM {_LONG})",
        "float_bits": f"SELECT i, pos, CASE WHEN x < 0 THEN 2147483647 - m ELSE 2147483648 + m END AS u, x FROM ({_BITS})",
        "preview_ends": "SELECT o_orderkey, 'first' AS what FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 64) UNION ALL SELECT o_orderkey, 'last' FROM (SELECT * FROM orders ORDER BY o_orderkey DESC LIMIT 64)",
        "ew_concat": f"SELECT i, pos, round(x, 9) AS x FROM {_LONG} UNION ALL SELECT i, CAST(pos + n AS INT), round(-x, 9) FROM {_LONG} JOIN (SELECT vec_id AS i, len(embedding) AS n FROM embeddings) USING (i)",
        "ew_stack": f"SELECT i, pos, round(x, 9) AS a, round(1 - x, 9) AS b FROM {_LONG}",
        "ew_fill": "SELECT o_orderkey AS i, CAST(unnest(range(3)) AS INT) AS pos, o_totalprice AS x FROM orders",
        "ew_pad_pow2": f"""SELECT i, p AS pos, CASE WHEN p <= i % 60 THEN x ELSE 3.4028234663852886e38 END AS x
            FROM (SELECT vec_id AS i, CAST(unnest(range(CAST(pow(2, ceil(log2(vec_id % 60 + 1))) AS BIGINT))) AS INT) AS p FROM embeddings) LEFT JOIN {_LONG} l USING (i) WHERE l.pos = p""",
        "ew_reshape": f"SELECT (i * w + pos) // k AS i, CAST((i * w + pos) % k AS INT) AS pos, x FROM (SELECT *, CASE WHEN w % 2 = 0 THEN w // 2 ELSE 1 END AS k FROM {_NUMBERED})",
        "red_columns": "SELECT 'argmin' AS what, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS o_orderkey FROM orders UNION ALL SELECT 'argmax', arg_max(o_orderkey, (o_totalprice, -o_orderkey)) FROM orders",
        "radix_histogram": f"SELECT block, digit, count(*) AS n FROM {_RADIX} GROUP BY block, digit",
        "radix_offsets": f"SELECT block, digit, n, CAST(coalesce(sum(n) OVER (ORDER BY digit, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM (SELECT block, digit, count(*) AS n FROM {_RADIX} GROUP BY block, digit)",
        "radix_rank": f"SELECT pos, key, block, digit, row_number() OVER (PARTITION BY block, digit ORDER BY pos) - 1 AS rank FROM {_RADIX}",
        "radix_pass": "SELECT row_number() OVER (ORDER BY user_id & 15, event_id) - 1 AS pos, user_id AS key, event_id AS row FROM events",
        "sort_axis1": f"SELECT i, CAST(row_number() OVER (PARTITION BY i ORDER BY x) - 1 AS INT) AS pos, x FROM {_LONG}",
        "sort_axis1_desc": f"SELECT i, CAST(row_number() OVER (PARTITION BY i ORDER BY x DESC) - 1 AS INT) AS pos, x FROM {_LONG}",
        "argsort_axis1": f"SELECT i, CAST(row_number() OVER (PARTITION BY i ORDER BY x, pos) - 1 AS INT) AS pos, x, CAST(pos AS BIGINT) AS index FROM {_LONG}",
        "sort_global": "SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS pos, o_totalprice AS x FROM orders",
        "argsort_stable": "SELECT row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS pos, o_custkey AS value, o_orderkey AS index FROM orders",
        "sort_verify": "SELECT 'given' AS what, min(p) AS first_descent FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS p, o_totalprice < lag(o_totalprice) OVER (ORDER BY o_orderkey) AS d FROM orders) WHERE d UNION ALL SELECT 'sorted', CAST(NULL AS BIGINT)",
        "sort_match_rate": "SELECT count(*) AS n, CAST(sum(m) AS BIGINT) AS matches, round(100 * avg(m), 6) AS percent FROM (SELECT CAST(abs(a.x - b.x) < 1e-6 AS INT) AS m FROM (SELECT row_number() OVER (ORDER BY o_orderkey) AS p, o_totalprice AS x FROM orders) a JOIN (SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS p, o_totalprice AS x FROM orders) b USING (p))",
        "sort_indices_valid": "SELECT bool_and(abs(o.o_totalprice - s.value) < 1e-3) AS valid FROM (SELECT o_totalprice AS value, o_orderkey AS index FROM orders) s JOIN orders o ON o.o_orderkey = s.index",
        "coll_all_gather": f"SELECT e.shard, CAST(coalesce(list_sum(list_transform(range(s.shard), lambda j: (n - j + 3) // 4)), 0) * w AS BIGINT) + pos AS pos, x FROM {_SHARD} s CROSS JOIN {_EACH} e",
        "coll_broadcast": f"SELECT e.shard, pos, x FROM {_SHARD} s CROSS JOIN {_EACH} e WHERE s.shard = 2",
        "gbdt_gradients": "SELECT vec_id, round(1 / (1 + exp(-CAST(embedding[1] AS DOUBLE))) - CAST(label >= 5 AS INT), 9) AS g, round(1 / (1 + exp(-CAST(embedding[1] AS DOUBLE))) * (1 - 1 / (1 + exp(-CAST(embedding[1] AS DOUBLE)))), 9) AS h FROM embeddings",
        "gbdt_best_split": f"SELECT feature, round(x, 9) AS x, round(gain, 6) AS gain FROM {_BEST}",
        "gbdt_leaf_weights": f"SELECT CAST(CASE WHEN r.x <= b.x THEN 1 ELSE 2 END AS INT) AS node, round(-sum(0.5 - y) / (sum(0.25) + 1), 6) AS weight FROM {_ROWS} r JOIN {_BEST} b USING (feature) GROUP BY ALL",
        "gbdt_importance": f"SELECT feature, round(gain, 6) AS importance FROM {_BEST}",
        "stats_throughput": "SELECT event_type, round(count(*) * 1048576 / 1073741824.0 / (sum(value) / 1000), 6) AS mean, round(max(1048576 / 1073741824.0 / (value / 1000)), 6) AS peak, round((max(value) - min(value)) / max(value) * 100, 6) AS improvement FROM events WHERE value > 0 GROUP BY event_type",
        "group_metrics": "SELECT event_type AS \"group\", CAST(user_id % 3 AS VARCHAR) AS strategy, count(*) AS runs, round(avg(CAST(event_id % 10 != 0 AS INT)), 6) AS success_rate, round(avg(value + 1), 6) AS mean_ms, round(min(value + 1), 6) AS min_ms, round(max(value + 1), 6) AS max_ms, round(arg_max(1048576 / ((value + 1) / 1000), event_id), 6) AS throughput FROM events GROUP BY ALL",
        "load_balance_pick": "SELECT \"group\", arg_min(worker, (load, worker)) AS worker FROM (SELECT event_type AS \"group\", user_id % 8 AS worker, avg(CAST(floor(value) AS BIGINT)) AS load FROM events GROUP BY ALL) GROUP BY \"group\"",
    }
    quantile = lambda p: f"list_sort(list(x))[CAST(least(floor(count(x) * {p}), count(x) - 1) AS BIGINT) + 1]"
    summary = f"count(x) AS n, min(x) AS min, max(x) AS max, avg(x) AS mean, median(x) AS median, stddev_pop(x) AS std, {quantile(0.95)} AS p95, {quantile(0.99)} AS p99"
    figures = "round(min, 6) AS min, round(max, 6) AS max, round(mean, 6) AS mean, round(median, 6) AS median, round(std, 6) AS std, round(p95, 6) AS p95, round(p99, 6) AS p99, round(std / mean * 100, 6) AS cv_percent, round((max - min) / mean * 100, 6) AS jitter_percent"
    out["stats_run_summary"] = f"SELECT event_type, n, {figures} FROM (SELECT event_type, {summary} FROM (SELECT event_type, value AS x FROM events) GROUP BY event_type)"
    out["stats_rating"] = f"""SELECT run, CASE WHEN cv < 3 THEN 'Excellent' WHEN cv < 5 THEN 'Good' WHEN cv < 10 THEN 'Fair' ELSE 'Variable' END AS sort_rating,
        CASE WHEN cv < 1 AND jitter < 5 THEN 'Excellent' WHEN cv < 3 AND jitter < 10 THEN 'Good' WHEN cv < 5 THEN 'Fair' ELSE 'Variable' END AS collective_rating
        FROM (SELECT run, std / mean * 100 AS cv, (max - min) / mean * 100 AS jitter FROM (SELECT run, {summary} FROM (SELECT user_id % 97 AS run, 100 + value / 100 AS x FROM events) GROUP BY run))"""
    for name, sql in (("negate", "-x"), ("one_minus", "1 - x"), ("sigmoid", "1 / (1 + exp(-x))")):
        out[f"ew_{name}"] = f"SELECT l_orderkey, l_linenumber, l_partkey, round({sql}, 9) AS value, count(*) AS n FROM (SELECT *, l_discount AS x FROM lineitem) GROUP BY ALL"
        out[f"ew_{name}_rows"] = f"SELECT i, pos, round({sql}, 9) AS x FROM {_LONG}"
    for axis, key in ((0, "pos"), (1, "i")):
        at = "pos" if axis else "i"
        out[f"red_sum_axis{axis}"] = f"SELECT {key}, round(sum(x), 6) AS value FROM {_LONG} GROUP BY {key}"
        out[f"red_prod_axis{axis}"] = f"SELECT {key}, round(product(1 + x / 100), 6) AS value FROM {_LONG} GROUP BY {key}"
        out[f"red_argmax_axis{axis}"] = f"SELECT {key}, CAST(arg_max({at}, (x, -{at})) AS BIGINT) AS value FROM {_LONG} GROUP BY {key}"
        out[f"red_argmin_axis{axis}"] = f"SELECT {key}, CAST(arg_min({at}, (x, {at})) AS BIGINT) AS value FROM {_LONG} GROUP BY {key}"
    for op, sql in (("sum", "sum(x)"), ("prod", "product(x)"), ("max", "max(x)"), ("min", "min(x)"), ("avg", "avg(x)")):
        out["coll_reduce_scatter" if op == "sum" else f"coll_reduce_scatter_{op}"] = f"SELECT CAST(pos // k AS INT) AS shard, pos % k AS pos, round({sql}, 6) AS x FROM (SELECT *, ((n + 3) // 4 * w + 3) // 4 AS k FROM {_SHARD}) GROUP BY k, pos"
        out[f"coll_all_reduce_{op}"] = f"SELECT shard, pos, round(x, 6) AS x FROM (SELECT pos, {sql} AS x FROM {_SHARD} GROUP BY pos) CROSS JOIN {_EACH}"
    return out
