import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from axisflow import errors
from axisflow.operators import gbdt
from axisflow.operators.extension import Order, model_of
from axisflow.sources.config import Model

ROWS = [([1.0, 5.0], 0.0), ([2.0, 5.0], 0.0), ([3.0, 1.0], 1.0), ([4.0, 1.0], 1.0), ([float("nan"), 1.0], 1.0), ([1.0, 5.0], 0.0), ([2.0, 1.0], 1.0), ([4.0, 5.0], 0.0)]


@pytest.fixture
def rows(spark):
    return spark.createDataFrame(ROWS, "v array<double>, y double")


def loss(df):
    p = F.col("probability")
    return df.select(F.avg(-(F.col("y") * F.log(p) + (1 - F.col("y")) * F.log(1 - p)))).first()[0]


def test_gradients(spark):
    g, h = gbdt.gradients(F.lit(1.0), F.lit(0.3))
    r = spark.range(1).select(g, h).first()
    p = 1 / (1 + math.exp(-0.3))
    assert tuple(r) == pytest.approx((p - 1, p * (1 - p)))


def test_first_split_by_hand(rows):
    c = gbdt.GbdtConfig(min_child_weight=0.5)
    g, h = gbdt.gradients(F.col("y"), F.lit(0.0))
    best = gbdt.best_splits(gbdt.exploded(rows.select("v", g.alias("g"), h.alias("h"), F.lit(0).alias("node"))), c).first()
    # feature 1 at 1.0 parts the labels: G = -2 and 2, H = 1 and 1, lambda 1
    assert (best["feature"], best["x"]) == (1, 1.0) and best["gain"] == pytest.approx(0.5 * (4 / 2 + 4 / 2 - 0))


def test_loss_never_rises(rows):
    losses = []
    for n in (0, 1, 2, 4):
        c = gbdt.GbdtConfig(max_depth=2, n_trees=n, min_child_weight=0.1)
        losses.append(loss(gbdt.predict(rows, gbdt.train(rows, c, "y"), c)))
    assert losses == sorted(losses, reverse=True) and losses[-1] < losses[0] / 1.5


def test_gamma_and_leaves_at_the_bottom(rows):
    assert len(gbdt.train(rows, gbdt.GbdtConfig(n_trees=1, gamma=1e9), "y")[0].nodes) == 1
    tree = gbdt.train(rows, gbdt.GbdtConfig(n_trees=1, max_depth=1, min_child_weight=0.1), "y")[0]
    assert tree.nodes[1].leaf and tree.nodes[1].weight != 0 and not tree.nodes[0].leaf


def test_base_score_is_one_thing(rows):
    c = gbdt.GbdtConfig(n_trees=0, base_score=0.7)
    assert {r["margin"] for r in gbdt.predict(rows, gbdt.train(rows, c, "y"), c).collect()} == {0.7}


def test_options(spark, rows):
    c = gbdt.GbdtConfig(n_trees=2, max_depth=2, subsample=0.8, colsample=0.5, alpha=0.1, bins=4, seed=1, min_child_weight=0.1)
    out = gbdt.predict(rows, gbdt.train(rows, c, "y"), c)
    assert out.where(F.isnan("margin")).count() == 0
    weighted = rows.withColumn("w", F.lit(2.0))
    assert gbdt.train(weighted, gbdt.GbdtConfig(n_trees=1, max_depth=1), "y", weight="w")[0].nodes[0].split == 1.0


def test_nan_goes_right(rows):
    c = gbdt.GbdtConfig(n_trees=1)
    t = gbdt.Tree({0: gbdt.Node(0, 2.0, 0.0, 1.0, False), 1: gbdt.Node(weight=1.0), 2: gbdt.Node(weight=-1.0)})
    got = [r["margin"] for r in gbdt.predict(rows.limit(5), [t], c).collect()]
    assert got == pytest.approx([0.3, 0.3, -0.3, -0.3, -0.3])


def test_model_entry_point(spark, rows):
    m = model_of(Model("GradientBoostedDecisionTree", target_columns=("y",), parameters={"n_trees": 1, "max_depth": 1, "learning_rate": 0.5}))
    out = m.execute(spark, rows)
    assert set(out) == {"trees", "importance", "scores"} and out["scores"].count() == 8
    with pytest.raises(errors.NotTrainable):
        model_of(Model("QLearning"))
    assert Order(lambda c, d: d.limit(c), 2).run(rows).count() == 2


def plain_trees(x, y, c):
    """The same trees by loops over rows."""
    margin, trees = np.full(len(y), c.base_score), []
    for _ in range(c.n_trees):
        p = 1 / (1 + np.exp(-margin))
        g, h, tree, at = p - y, p * (1 - p), {}, np.zeros(len(y), dtype=int)
        score = lambda a, b: a * a / (b + c.lam)
        for k in range(2 ** (c.max_depth + 1) - 1):
            mine = at == k
            if not mine.any():
                continue
            tree[k] = (None, None, -g[mine].sum() / (h[mine].sum() + c.lam))
            best = (0.0, None, None)
            for f in range(x.shape[1]) if k < 2**c.max_depth - 1 else ():
                for t in sorted(set(x[mine, f].tolist())):
                    left = mine & (x[:, f] <= t)
                    gl, hl, gr, hr = g[left].sum(), h[left].sum(), g[mine & ~left].sum(), h[mine & ~left].sum()
                    gain = 0.5 * (score(gl, hl) + score(gr, hr) - score(gl + gr, hl + hr))
                    if hl >= c.min_child_weight and hr >= c.min_child_weight and hr > 0 and gain > best[0] + 1e-12:
                        best = (gain, f, t)
            if best[1] is not None:
                tree[k] = (best[1], best[2], tree[k][2])
                at[mine] = np.where(x[mine, best[1]] <= best[2], 2 * k + 1, 2 * k + 2)
        margin = margin + c.learning_rate * np.array([tree[k][2] for k in at])
        trees.append(tree)
    return margin, trees


def test_training_by_brute_force(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(120, 4)).round(1)
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.5) ^ (rng.random(120) < 0.1)).astype(float)
    c = gbdt.GbdtConfig(n_trees=3, max_depth=3)
    margin, trees = plain_trees(x, y, c)
    df = spark.createDataFrame([(i, r.tolist(), float(t)) for i, (r, t) in enumerate(zip(x, y))], "i long, v array<double>, y double")
    got = gbdt.train(df, c, "y")
    for mine, theirs in zip(got, trees):
        assert {k: (n.feature, n.split) for k, n in mine.nodes.items()} == {k: t[:2] for k, t in theirs.items()}
        assert all(n.weight == pytest.approx(theirs[k][2]) for k, n in mine.nodes.items())
    scores = {r["i"]: r["margin"] for r in gbdt.predict(df, got, c).collect()}
    assert [scores[i] for i in range(120)] == pytest.approx(margin.tolist())
