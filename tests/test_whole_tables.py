"""Queries over whole tables of vectors, of rows that can't be dealt out evenly and of another width."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from axisflow.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def uneven(tmp_path_factory):
    """103 vectors of 66 entries with gaps between the ids."""
    d = tmp_path_factory.mktemp("uneven")
    rng = np.random.default_rng(1)
    con = duckdb.connect()
    con.execute("CREATE TABLE e (vec_id BIGINT, embedding FLOAT[], label INTEGER)")
    con.executemany("INSERT INTO e VALUES (?, ?, ?)", [(3 * i, rng.normal(size=66).astype("float32").tolist(), i % 10) for i in range(103)])
    con.execute(f"COPY e TO '{d}/embeddings.parquet' (FORMAT parquet)")
    return str(d)


def vectors(sf_dir):
    return np.stack([np.array(v, dtype=np.float64) for (v,) in duckdb.sql(f"SELECT embedding FROM '{sf_dir}/embeddings.parquet' ORDER BY vec_id").fetchall()])


def parts_of(x):
    return [x[k::4].reshape(-1) for k in range(4)]


@pytest.mark.parametrize("which", ["given", "uneven"])
@pytest.mark.parametrize("op", ["sum", "prod", "max", "min", "avg"])
def test_all_reduce_takes_every_row(spark, uneven, which, op):
    sf = SF if which == "given" else uneven
    parts = parts_of(vectors(sf))
    n = max(map(len, parts))
    held = [np.array([p[i] for p in parts if i < len(p)]) for i in range(n)]
    want = [{"sum": np.sum, "prod": np.prod, "max": np.max, "min": np.min, "avg": np.mean}[op](h) for h in held]
    got = catalogue.queries()[f"coll_all_reduce_{op}"](spark, sf).toPandas()
    assert len(got) == 4 * n
    for _, own in got.groupby("shard"):
        own = own.sort_values("pos")
        assert own.pos.tolist() == list(range(n)) and np.allclose(own.x, want, atol=1e-5)


@pytest.mark.parametrize("which", ["given", "uneven"])
def test_gather_broadcast_and_scatter_take_every_row(spark, uneven, which):
    sf = SF if which == "given" else uneven
    parts = parts_of(vectors(sf))
    gathered = catalogue.coll_all_gather(spark, sf).where("shard = 3").orderBy("pos").toPandas()
    assert gathered.pos.tolist() == list(range(len(gathered))) and np.array_equal(gathered.x, np.concatenate(parts))
    sent = catalogue.coll_broadcast(spark, sf).where("shard = 1").orderBy("pos").toPandas()
    assert np.array_equal(sent.x, parts[2])
    n = -(-max(map(len, parts)) // 4) * 4
    want = sum(np.pad(p, (0, n - len(p))) for p in parts)[: max(map(len, parts))]
    got = catalogue.queries()["coll_reduce_scatter"](spark, sf).withColumn("at", F.col("shard") * (n // 4) + F.col("pos")).orderBy("at").toPandas()
    assert got["at"].tolist() == list(range(len(want))) and np.allclose(got.x, want, atol=1e-5)


@pytest.mark.parametrize("which", ["given", "uneven"])
def test_reshape_takes_every_row(spark, uneven, which):
    v = vectors(SF if which == "given" else uneven)
    got = catalogue.ew_reshape(spark, SF if which == "given" else uneven).orderBy("i", "pos").toPandas()
    half = v.shape[1] // 2
    assert got.i.tolist() == [k // half for k in range(v.size)] and got.pos.tolist() == [k % half for k in range(v.size)]
    assert np.array_equal(got.x, v.reshape(-1))


@pytest.fixture(scope="module")
def last(tmp_path_factory):
    """The last of 20 features is the label's sign; others are noise."""
    d = tmp_path_factory.mktemp("last")
    rng = np.random.default_rng(2)
    con = duckdb.connect()
    con.execute("CREATE TABLE e (vec_id BIGINT, embedding FLOAT[], label INTEGER)")
    con.executemany("INSERT INTO e VALUES (?, ?, ?)", [(i, [*rng.normal(size=19).tolist(), 1.0 if i % 10 >= 5 else -1.0], i % 10) for i in range(200)])
    con.execute(f"COPY e TO '{d}/embeddings.parquet' (FORMAT parquet)")
    return str(d)


def test_splits_see_every_feature(spark, last):
    assert [(r["feature"], r["x"]) for r in catalogue.gbdt_best_split(spark, last).collect()] == [(19, -1.0)]
    assert [r["feature"] for r in catalogue.gbdt_importance(spark, last).collect()] == [19]
    # 100 rows on each side, gradients of 0.5, hessians of 0.25, lambda 1
    assert [(r["node"], r["weight"]) for r in catalogue.gbdt_leaf_weights(spark, last).orderBy("node").collect()] == [(1, round(-50 / 26, 6)), (2, round(50 / 26, 6))]


def test_training_takes_all_rows_and_features(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(catalogue.gbdt, "train", lambda rows, c, label: seen.append((c.n_trees, c.max_depth, c.bins, rows.count(), len(rows.first()["v"]))) or [catalogue.gbdt.Tree({0: catalogue.gbdt.Node()})])
    assert catalogue.gbdt_train_predict(spark, SF).count() == 500
    assert seen == [(10, 3, None, 500, 64)]
