import json
import math
import warnings

import pytest
from pyspark.sql import functions as F

from axisflow import cli, errors
from axisflow.operators import staging
from axisflow.plans import pipeline
from axisflow.sources import config, tables

PEOPLE = '''no,years,pay,team,town,mark,state
1,30,100.5,"Sales, north",Ulm,1e2,on
2,,7,Ops,"a ""b""",x,off
3,41,1f,"Sales, north","two
lines",.5,
'''


def conf(path, **changes):
    base = {"name": "c", "version": config.VERSION, "data": {"source": {"type": "csv", "path": path}, "transformers": [{"operation": "categories", "params": {"columns": ["team", "state", "nosuch"]}}]}, "models": [], "output": {}}
    return json.dumps(base | changes)


@pytest.fixture
def people(tmp_path):
    p = tmp_path / "people.csv"
    p.write_text(PEOPLE)
    return str(p)


def test_csv_to_floats(spark, people):
    done = pipeline.staged(spark, config.parse(conf(people)))
    rows = done.table.orderBy(tables.RID).collect()
    assert [r["team"] for r in rows] == [0, 1, 0]
    assert [r["state"] for r in rows] == [0, 1, 2]  # the empty text is a category
    assert [r["no"] for r in rows] == [1, 2, 3]
    assert math.isnan(rows[1]["years"]) and math.isnan(rows[2]["pay"]) and rows[2]["mark"] == 0.5
    assert done.dictionaries["team"].orderBy("id").first()["category"] == "Sales, north"


def test_ragged_and_empty(spark, tmp_path):
    (tmp_path / "r.csv").write_text("a,b\n1,2\n3\n")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|FAILED"):
        tables.read_csv(spark, str(tmp_path / "r.csv")).select("a").collect()
    (tmp_path / "h.csv").write_text("a,b\n")
    with pytest.raises(errors.EmptyTable):
        tables.read_csv(spark, str(tmp_path / "h.csv"))


def test_names_and_delimiter(spark, tmp_path):
    (tmp_path / "d.csv").write_text("x;y\n1;2\n")
    t = tables.read_csv(spark, str(tmp_path / "d.csv"), ("p", "q"), ";")
    assert t.select("p", "q").first() == ("1", "2")
    with pytest.raises(errors.InvalidConfig):
        tables.read_csv(spark, str(tmp_path / "d.csv"), ("p", "p"), ";")


@pytest.mark.parametrize("text, value", [("1.5", 1.5), (" 1.5 ", None), ("", None), ("abc", None), ("inf", math.inf), ("-inf", -math.inf), ("Infinity", math.inf), ("nan", None), ("+3", 3.0), ("1e5", 1e5), ("1f", None), ("1d", None), (".5", 0.5), ("5.", 5.0), ("1e400", math.inf), ("-NaN", None), (".", None), ("1e", None)])
def test_float_texts(spark, text, value):
    got = spark.createDataFrame([(text,)], "t string").select(staging.to_float(F.col("t"))).first()[0]
    assert math.isnan(got) if value is None else got == pytest.approx(value)


def test_step_errors(spark, people):
    table = tables.read_csv(spark, people)
    with pytest.raises(errors.NoTransformationsDefined):
        staging.stage(table, None)
    with pytest.raises(errors.NoTransformationParams):
        staging.stage(table, (config.Step("categories"),))
    with pytest.raises(errors.TransformationParamsWrong):
        staging.stage(table, (config.Step("categories", {"columns": 3}),))
    with pytest.raises(errors.NoInputColumns):
        staging.stage(table.select(tables.RID), (config.Step("categories", {"columns": ["a"]}),))
    with pytest.raises(NotImplementedError):
        staging.stage(table, (config.Step("date_conv"),))
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        assert staging.stage(table, (config.Step("nosuch"),)).table.count() == 3
    assert any("nosuch" in str(w.message) for w in seen)
    assert staging.stage(table, ()).table.count() == 3


def test_null_category(spark):
    df = spark.createDataFrame([(0, "b"), (1, None), (2, "a"), (3, None)], f"{tables.RID} long, c string")
    out, words = staging.encode(df, "c")
    assert [r["c"] for r in out.orderBy(tables.RID).collect()] == [0, 1, 2, 1]
    assert words.count() == 3


def test_select_columns(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0, 1.0)], f"{tables.RID} long, a float, b float, y float")
    assert staging.select_columns(df, ("a", "b"), ("y",)).first()["v"] == [1.0, 2.0]
    with pytest.raises(errors.InvalidConfig):
        staging.select_columns(df, ("z",), ())


def test_config_checks(people):
    with pytest.raises(errors.InvalidConfig):
        config.parse(conf(people, version="9"))
    with pytest.raises(errors.InvalidConfig):
        config.parse("{")
    with pytest.raises(errors.InvalidConfig):
        config.parse(conf(people, models=[{"model_type": "Other"}]))
    with pytest.raises(errors.InvalidConfig):
        config.parse(conf(people, output={"final_output": ["m3"]}))
    with pytest.raises(errors.InvalidConfig):
        config.read("/nonexistent.json")
    c = config.parse(conf(people, models=[{"model_type": "NeuralNetwork"}]))
    with pytest.raises(errors.NotTrainable):
        c.models[0].gbdt()
    scheme = {"source": {"type": "csv", "path": people, "scheme": ["a"]}, "transformers": []}
    with pytest.raises(errors.InvalidConfig):
        config.parse(conf(people, data=scheme, models=[{"model_type": "QLearning", "input_columns": ["b"]}]))


def test_unknown_source(spark):
    with pytest.raises(errors.DataTypeNotSupported):
        tables.load(spark, config.Source("xml", "x"))


def test_store_and_cli(spark, tmp_path, people, capsys):
    store = str(tmp_path / "store")
    (tmp_path / "c.json").write_text(conf(people))
    run = lambda *a: cli.main(["--store", store, *a], spark)
    assert run("config", "show") == 1
    assert run("config", "import", str(tmp_path / "c.json"), "one", "--runtime", "r1") == 0
    assert run("config", "import", str(tmp_path / "c.json"), "two") == 0
    assert config.ConfigStore(spark, store).names() == ["one", "two"]
    assert run("config", "activate", "nosuch") == 1
    assert run("config", "activate", "one") == 0
    assert run("config", "activate", "two") == 0
    assert config.ConfigStore(spark, store).active().source.path == people
    assert config.ConfigStore(spark, store).runtime() is None
    assert run("config", "list") == 0 and "two" in capsys.readouterr().out
    assert run("start", "stage", "--out", str(tmp_path / "out")) == 0
    assert spark.read.parquet(str(tmp_path / "out/data")).count() == 3
    assert run("report") == 0


def nested(path, **model):
    """A configuration with its columns below the scheme, its steps as `transformer` and typed hyperparameters."""
    own = {"id": 0, "model_type": "GradientBoostedDecisionTree", "input_columns": ["years", "team"], "target_columns": ["flag"], "hyperparams": {"n_trees": 2, "learning_rate": 0.7, "max_depth": 1, "sub_sample": 1.0}, "mode": "Train"}
    steps = [{"t_id": 0, "operation": "categories", "params": {"columns": ["team"]}}]
    return {"name": "n", "version": config.VERSION, "data": {"source": {"type": "csv", "path": path}, "scheme": {"columns": ["years", "team", "flag"]}, "transformer": steps}, "models": [own | model], "output": {"final_output": ["m0"]}}


def test_nested_configuration_stages_and_trains(spark, tmp_path):
    path = tmp_path / "n.csv"
    path.write_text("a,b,c\n" + "".join(f"{i},t{i % 2},{int(i >= 10)}\n" for i in range(20)))
    c = config.parse(json.dumps(nested(str(path))))
    assert c.source.scheme == ("years", "team", "flag") and c.models[0].gbdt() == config.GbdtParameters(2, 0.7, 1, 1.0)
    out = pipeline.run(spark, c)
    margins = {r["margin"] for r in out["m0"].collect()}
    # two stumps at 9: gradients of 0.5, hessians of 0.25, lambda 1, ten rows on each side
    first = 0.7 * 5 / 3.5
    p = 1 / (1 + math.exp(-first))
    want = first + 0.7 * 10 * (1 - p) / (10 * p * (1 - p) + 1)
    assert sorted(margins) == pytest.approx([-want, want])
    second = nested(str(path))
    second["models"].append(second["models"][0] | {"id": 1, "input_from": "m0"})
    second["output"]["final_output"] = ["m1"]
    out = pipeline.run(spark, config.parse(json.dumps(second)))
    assert set(out) == {"data", "m1"} and len(out["m1"].first()["v"]) == 3


@pytest.mark.parametrize("change", [{"hyperparams": {"n_trees": "many"}}, {"hyperparams": {"max_depth": -1}}, {"hyperparams": [1]}, {"mode": "Sleep"}, {"input_from": "m7"}, {"input_columns": ["nosuch"]}, {"model_type": "NeuralNetwork", "hyperparams": {"layers": ["a"]}}, {"model_type": "QLearning", "hyperparams": {"episodes": 0.5}}])
def test_models_are_checked(change):
    with pytest.raises(errors.InvalidConfig):
        config.parse(json.dumps(nested("x", **change)))


def test_models_that_cannot_run_are_read():
    c = config.parse(json.dumps(nested("x", model_type="NeuralNetwork", hyperparams={"layers": [3, 2], "activation": "relu", "epochs": 4})))
    assert config.typed("NeuralNetwork", c.models[0].parameters) == config.NetworkParameters((3, 2), "relu", None, 4)
    c = config.parse(json.dumps(nested("x", mode="Generate")))
    with pytest.raises(errors.NotTrainable):
        pipeline.model_of(c.models[0])


def test_activation_takes_the_first_of_a_name(spark, tmp_path):
    store = config.ConfigStore(spark, str(tmp_path / "store"))
    for name, path in (("x", "/z"), ("x", "/a"), ("y", "/y"), ("y", "/y")):
        store.add(name, conf(path))
    for name, path in (("x", "/z"), ("y", "/y")):
        store.activate(name)
        assert store.active().source.path == path and store._table().where("active").count() == 1
    assert store.names() == ["x", "x", "y", "y"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(0, 2.0, 1.0, 1.0), (1, 1.0, 2.0, 3.0)], "i int, given double, got double, want double")
    tables.write_verification(df, str(tmp_path / "v"), F.col("got"), F.col("want"), F.col("i"), F.col("given"))
    back = spark.read.option("header", True).csv(str(tmp_path / "v"))
    assert back.columns == ["index", "input", "sorted", "expected", "match"] and {r["match"] for r in back.collect()} == {"true", "false"}
    tables.write_timings(spark.createDataFrame([(0, 1.5)], "iteration int, time_ms double"), str(tmp_path / "t"), {"mean": 1.5})
    assert json.loads(spark.read.text(str(tmp_path / "t-summary")).first()[0]) == {"mean": 1.5}
    assert tables.markdown([{"a": 1, "b": 0.5}], ["a", "b"]).splitlines()[2] == "| 1 | 0.500 |"


def test_numbers_of(spark):
    df = spark.createDataFrame([(" 1 ",), ("x",), ("",), (None,), ("2.5",)], "c string")
    assert sorted(r["value"] for r in tables.numbers_of(df).collect()) == [1.0, 2.5]


def test_generators(spark):
    u = tables.uniform(spark, 100, -5000, 5000, 3).agg(F.min("value"), F.max("value")).first()
    assert -5000 <= u[0] < u[1] < 5000
    assert [r["value"] for r in tables.indices(spark, 3).collect()] == [0, 1, 2]
    got = [r["value"] for r in tables.congruential(spark, 3).orderBy("i").collect()]
    want = [((i * 6364136223846793005 + 1442695040888963407) % 2**32) / (2**32 - 1) for i in range(3)]
    assert got == pytest.approx(want, abs=1e-6)
