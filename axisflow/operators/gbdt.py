"""Gradient-boosted trees with exact greedy splits (Chen and Guestrin 2016), grown level by level.

A level is one aggregation: gradients and hessians are summed by (node, feature, value) on the map side, and running
sums over ranges of distinct values give every candidate. Only the winners, at most one a node, with their children's
weights, reach the driver; they come back to the rows as a column expression. Values at most the threshold go left; larger ones, NaN and null go right.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from axisflow.functions.lineage import kept
from axisflow.operators.elementwise import sigmoid
from axisflow.operators.extension import Model
from axisflow.operators.reduce import running


@dataclass(frozen=True)
class GbdtConfig:
    """alpha: L1 penalty. subsample and colsample: shares of rows and features that a tree sees. bins: None for exact
    candidates, else that many quantiles of each feature, which bounds the candidates of a level at any table size."""

    max_depth: int = 6
    min_child_weight: float = 1.0
    gamma: float = 0.0
    lam: float = 1.0
    alpha: float = 0.0
    learning_rate: float = 0.3
    subsample: float = 1.0
    colsample: float = 1.0
    n_trees: int = 100
    base_score: float = 0.0
    bins: int | None = None
    seed: int = 0


@dataclass
class Node:
    feature: int | None = None
    split: float | None = None
    weight: float = 0.0
    gain: float = 0.0
    leaf: bool = True


@dataclass
class Tree:
    """Nodes by heap index: children of k are 2k + 1 and 2k + 2."""

    nodes: dict[int, Node] = field(default_factory=dict)


def gradients(y: Column, score: Column) -> tuple[Column, Column]:
    p = sigmoid(score)
    return p - y, p * (1 - p)


def _shrunk(g: Column, alpha: float) -> Column:
    return g if not alpha else F.signum(g) * F.greatest(F.abs(g) - alpha, F.lit(0.0))


def quality(g: Column, h: Column, c: GbdtConfig) -> Column:
    return _shrunk(g, c.alpha) * _shrunk(g, c.alpha) / (h + c.lam)


def leaf_weight(g: Column, h: Column, c: GbdtConfig) -> Column:
    return -_shrunk(g, c.alpha) / (h + c.lam)


def candidates(long: DataFrame, c: GbdtConfig) -> DataFrame:
    """node, feature, x, gl, hl, g, h, gain: every threshold of every node, from (node, feature, x, g, h)."""
    sums = long.groupBy("node", "feature", "x").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    d = running(sums, ["node", "feature"], ["x"], ["g", "h"])
    d = d.select("node", "feature", "x", F.col("g_upto").alias("gl"), F.col("h_upto").alias("hl"), F.col("g_all").alias("g"), F.col("h_all").alias("h"))
    gl, hl, gr, hr = F.col("gl"), F.col("hl"), F.col("g") - F.col("gl"), F.col("h") - F.col("hl")
    d = d.where(~F.isnan("x") & (hl >= c.min_child_weight) & (hr >= c.min_child_weight) & (hr > 0))
    return d.withColumn("gain", 0.5 * (quality(gl, hl, c) + quality(gr, hr, c) - quality(F.col("g"), F.col("h"), c)))


def best_splits(long: DataFrame, c: GbdtConfig) -> DataFrame:
    """node, feature, x, gain, left, right: the best threshold of each node and its children's weights; of equal gains the
    least feature, then the least x.

    Splits of gain under gamma, or of none, aren't made."""
    sides = [leaf_weight(F.col("gl"), F.col("hl"), c).alias("left"), leaf_weight(F.col("g") - F.col("gl"), F.col("h") - F.col("hl"), c).alias("right")]
    best = F.max(F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("x")).alias("t"), *sides))
    found = candidates(long, c).groupBy("node").agg(best.alias("b"))
    return found.select("node", (-F.col("b.f")).alias("feature"), (-F.col("b.t")).alias("x"), "b.gain", "b.left", "b.right").where((F.col("gain") > 0) & (F.col("gain") >= c.gamma))


def exploded(rows: DataFrame, features: list[int] | None = None) -> DataFrame:
    long = rows.select("node", "g", "h", F.posexplode("v").alias("feature", "x")).withColumn("x", F.coalesce(F.col("x").cast("double"), F.lit(float("nan"))))
    return long if features is None else long.where(F.col("feature").isin(features))


def _binned(rows: DataFrame, width: int, bins: int) -> DataFrame:
    """v with every value raised to the upper end of its quantile bin; ends come from one sketch pass."""
    probs = [i / bins for i in range(1, bins + 1)]
    ends = rows.select(*(F.col("v")[i].cast("double").alias(f"f{i}") for i in range(width))).approxQuantile([f"f{i}" for i in range(width)], probs, 1 / (4 * bins))

    def raised(x: Column, own: list[float]) -> Column:
        above = F.filter(F.array(*map(F.lit, sorted(set(own)))), lambda e: e >= x)
        return F.when(F.isnan(x) | x.isNull(), x).otherwise(F.coalesce(F.try_element_at(above, F.lit(1)), x))

    return rows.withColumn("v", F.array(*(raised(F.col("v")[i].cast("double"), e) for i, e in enumerate(ends))))


def grow(rows: DataFrame, width: int, c: GbdtConfig, seed: int) -> Tree:
    """One tree of rows (v, g, h)."""
    tree = Tree({0: Node()})
    rng = np.random.default_rng(seed)
    features = None if c.colsample >= 1 else sorted(rng.choice(width, max(1, round(c.colsample * width)), replace=False).tolist())
    total = rows.agg(leaf_weight(F.sum("g"), F.sum("h"), c).alias("w")).first()
    tree.nodes[0].weight = total["w"] or 0.0
    for depth in range(c.max_depth):
        level = rows.withColumn("node", node_of(F.col("v"), tree)).where(F.col("node") >= (1 << depth) - 1)
        chosen = best_splits(exploded(level, features), c).collect()  # at most one row a node
        if not chosen:
            break
        for r in chosen:
            k = r["node"]
            tree.nodes[k].feature, tree.nodes[k].split, tree.nodes[k].gain, tree.nodes[k].leaf = int(r["feature"]), float(r["x"]), float(r["gain"]), False
            tree.nodes[2 * k + 1], tree.nodes[2 * k + 2] = Node(weight=float(r["left"])), Node(weight=float(r["right"]))
    return tree


def node_of(v: Column, tree: Tree, k: int = 0) -> Column:
    """The leaf that a row's features lead to, as an expression, so that no level is written anywhere."""
    node = tree.nodes[k]
    if node.leaf:
        return F.lit(k)
    left = F.coalesce(F.get(v, F.lit(node.feature)) <= node.split, F.lit(False))
    return F.when(left, node_of(v, tree, 2 * k + 1)).otherwise(node_of(v, tree, 2 * k + 2))


def _margins(trees: list[Tree], c: GbdtConfig):
    """A function from a matrix of features to summed, shrunken weights."""
    flat = []
    for t in trees:
        n = max(t.nodes) + 1
        feature, split, weight = np.full(n, -1), np.zeros(n), np.zeros(n)
        for k, node in t.nodes.items():
            weight[k] = node.weight
            if not node.leaf:
                feature[k], split[k] = node.feature, node.split
        flat.append((feature, split, weight))

    def score(x: np.ndarray) -> np.ndarray:
        out, row = np.full(len(x), c.base_score), np.arange(len(x))
        for feature, split, weight in flat:
            at = np.zeros(len(x), dtype=np.int64)
            while (inner := feature[at] >= 0).any():
                own = x[row[inner], feature[at[inner]]]
                at[inner] = 2 * at[inner] + np.where(own <= split[at[inner]], 1, 2)
            out += c.learning_rate * weight[at]
        return out

    return score


def margin(v: Column, trees: list[Tree], c: GbdtConfig) -> Column:
    """The raw score of a feature array, for all trees at once over Arrow batches."""
    score = _margins(trees, c)

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in batches:
            yield pd.Series(score(np.array([np.asarray(r, dtype=np.float64) for r in v])) if len(v) else [], dtype="float64")

    return of(v)


def train(df: DataFrame, c: GbdtConfig, label: str, features: str = "v", weight: str | None = None) -> list[Tree]:
    """Trees for rows with a feature array and a 0/1 label; `weight` multiplies a row's gradient and hessian."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.select(F.col(features).alias("v"), F.col(label).cast("double").alias("y"), w.alias("w"))
    width = rows.select(F.max(F.size("v"))).first()[0] or 0
    rows = kept((_binned(rows, width, c.bins) if c.bins else rows).withColumn("score", F.lit(float(c.base_score))))
    trees: list[Tree] = []
    for i in range(c.n_trees):
        g, h = gradients(F.col("y"), F.col("score"))
        seen = rows.select("v", (g * F.col("w")).alias("g"), (h * F.col("w")).alias("h"))
        tree = grow(kept(seen.sample(c.subsample, c.seed + i) if c.subsample < 1 else seen), width, c, c.seed + i)
        trees.append(tree)
        one = margin(F.col("v"), [tree], GbdtConfig(learning_rate=c.learning_rate))
        rows = kept(rows.withColumn("score", F.col("score") + one))
    return trees


def predict(df: DataFrame, trees: list[Tree], c: GbdtConfig, features: str = "v") -> DataFrame:
    """df with margin and probability."""
    return df.withColumn("margin", margin(F.col(features), trees, c)).withColumn("probability", sigmoid(F.col("margin")))


def trees_table(spark: SparkSession, trees: list[Tree]) -> DataFrame:
    rows = [(t, k, n.feature, n.split, float(n.weight), float(n.gain), n.leaf) for t, tree in enumerate(trees) for k, n in sorted(tree.nodes.items())]
    return spark.createDataFrame(rows, "tree int, node int, feature int, split double, weight double, gain double, leaf boolean")


def importance(nodes: DataFrame) -> DataFrame:
    """feature, importance: the gain of a feature's splits over all trees."""
    return nodes.where("NOT leaf").groupBy("feature").agg(F.sum("gain").alias("importance"))


class Gbdt(Model):
    """The trainer behind the models' common entry point: a table in; trees, importance and scores out."""

    def __init__(self, config: GbdtConfig, label: str, features: str = "v"):
        self.config, self.label, self.features = config, label, features

    def execute(self, spark: SparkSession, table: DataFrame) -> dict[str, DataFrame]:
        trees = train(table, self.config, self.label, self.features)
        nodes = trees_table(spark, trees)
        return {"trees": nodes, "importance": importance(nodes), "scores": predict(table, trees, self.config, self.features)}
