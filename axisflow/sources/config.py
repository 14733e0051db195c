"""Pipeline configurations: reading, checking, and a store with one active at a time."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axisflow.errors import InvalidConfig, NoActiveConfig, NotTrainable

#: Fixed value: the only version that is read.
VERSION = "0.11_pre_alpha"
#: Kinds of models by their tag.
MODEL_KINDS = ("NeuralNetwork", "GradientBoostedDecisionTree", "QLearning")
#: What a model is there for.
MODES = ("Train", "Generate")


@dataclass(frozen=True)
class Source:
    type: str
    path: str
    scheme: tuple[str, ...] = ()
    delimiter: str = ","
    header: bool = True


@dataclass(frozen=True)
class Step:
    operation: str
    params: dict[str, Any] | None = None


@dataclass(frozen=True)
class GbdtParameters:
    n_trees: int = 100
    learning_rate: float = 0.3
    max_depth: int = 6
    sub_sample: float = 1.0


@dataclass(frozen=True)
class NetworkParameters:
    layers: tuple[int, ...] = ()
    activation: str = ""
    optimizer: str | None = None
    epochs: int = 0


@dataclass(frozen=True)
class QParameters:
    environment: str = ""
    learning_rate: float = 0.0
    discount: float = 0.0
    episodes: int = 0


#: Typed parameters by kind of model.
PARAMETERS = dict(zip(MODEL_KINDS, (NetworkParameters, GbdtParameters, QParameters)))


def typed(kind: str, given: dict[str, Any]) -> Any:
    """The parameters of a kind of model, those that aren't given by default; other names are passed over."""
    own, out = PARAMETERS[kind], {}
    for f in fields(own):
        value, wanted = given.get(f.name), f.type.partition("[")[0].partition(" ")[0]
        if value is None:
            continue
        fits = {"int": isinstance(value, int), "float": isinstance(value, (int, float)), "str": isinstance(value, str), "tuple": isinstance(value, list) and all(type(v) is int and v >= 0 for v in value)}[wanted]
        if not fits or isinstance(value, bool) or wanted == "int" and value < 0:
            raise InvalidConfig(f"{kind}: {f.name} can't be {value!r}")
        out[f.name] = {"float": float, "tuple": tuple}.get(wanted, lambda v: v)(value)
    return own(**out)


@dataclass(frozen=True)
class Model:
    """input_from: the tag of a model whose scores are the inputs, instead of columns."""

    kind: str
    tag: str = "m0"
    input_columns: tuple[str, ...] = ()
    target_columns: tuple[str, ...] = ()
    parameters: dict[str, Any] = field(default_factory=dict)
    input_from: str | None = None
    mode: str = "Train"

    def gbdt(self) -> GbdtParameters:
        if self.kind != "GradientBoostedDecisionTree":
            raise NotTrainable(f"{self.kind} can be configured, not trained")
        return typed(self.kind, self.parameters)


@dataclass(frozen=True)
class Config:
    name: str | None
    version: str
    source: Source
    steps: tuple[Step, ...] | None
    models: tuple[Model, ...] = ()
    outputs: tuple[str, ...] = ()


def parse(text: str) -> Config:
    """A Config of its JSON text."""
    try:
        raw = json.loads(text)
    except ValueError as e:
        raise InvalidConfig(f"not JSON: {e}") from e
    if raw.get("version") != VERSION:
        raise InvalidConfig(f"version {raw.get('version')!r} isn't {VERSION!r}")
    data = raw.get("data") or {}
    source = data.get("source") or {}
    if not source.get("type") or not (source.get("path") or source.get("input")):
        raise InvalidConfig("the data section needs a source with type and path")
    listed = next((data[k] for k in ("transformer", "transformers", "transformations") if data.get(k) is not None), None)
    steps = None if listed is None else tuple(Step(s.get("operation") or s.get("type") or "", s.get("params")) for s in listed)
    scheme = source.get("scheme") or data.get("scheme") or ()
    scheme = tuple((scheme.get("columns") or ()) if isinstance(scheme, dict) else scheme)
    models = tuple(_model(i, m, set(scheme)) for i, m in enumerate(raw.get("models") or []))
    known = [m.tag for m in models]
    if len(set(known)) != len(known):
        raise InvalidConfig("models share a tag")
    for i, m in enumerate(models):
        if m.input_from is not None and m.input_from not in known[:i]:
            raise InvalidConfig(f"model {m.tag} takes its input from {m.input_from!r}, which isn't a model before it")
    output = raw.get("output") or {}
    tags = tuple(output.get("final_output") or ())
    if unknown := set(tags) - {m.tag for m in models}:
        raise InvalidConfig(f"the output names unknown models: {', '.join(sorted(unknown))}")
    return Config(raw.get("name"), raw["version"], Source(source["type"], source.get("path") or source["input"], scheme, source.get("delimiter") or ",", source.get("header", True)), steps, models, tags)


def _model(i: int, m: dict[str, Any], columns: set[str]) -> Model:
    """The i-th model; its tag is m and its id, or m and i, unless it has one. columns: of the source, where they are listed."""
    kind = m.get("model_type")
    if kind not in MODEL_KINDS:
        raise InvalidConfig(f"unknown model type {kind!r}")
    given = next((m[k] for k in ("hyperparams", "parameters", "config") if m.get(k) is not None), {})
    if not isinstance(given, dict):
        raise InvalidConfig(f"model {i}: parameters must be an object")
    typed(kind, given)
    if (mode := m.get("mode", "Train")) not in MODES:
        raise InvalidConfig(f"unknown mode {mode!r}")
    out = Model(kind, m.get("tag") or f"m{m.get('id', i)}", tuple(m.get("input_columns") or ()), tuple(m.get("target_columns") or ()), given, m.get("input_from"), mode)
    if missing := [c for c in (*out.input_columns, *out.target_columns) if columns and c not in columns]:
        raise InvalidConfig(f"model {out.tag} names columns that the source doesn't have: {', '.join(missing)}")
    return out


def read(path: str) -> Config:
    try:
        with open(path, encoding="utf-8") as f:
            return parse(f.read())
    except OSError as e:
        raise InvalidConfig(f"{path}: {e.strerror}") from e


class ConfigStore:
    """Configurations in a folder of Parquet versions: place (in the order they came), name, active, runtime, body (JSON).

    Names may repeat. A change writes the whole, which is small, as a new version; readers take the last that is
    complete, so one never sees half a change, and of two writers at once the later one fails."""

    SCHEMA = "place long, name string, active boolean, runtime string, body string"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path, path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        path, files = self._files()
        if not files.exists(path(self.folder)):
            return []
        names = [s.getPath().getName() for s in files.listStatus(path(self.folder))]
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and files.exists(path(f"{self.folder}/{n}/_SUCCESS")))

    def _table(self) -> DataFrame:
        versions = self._versions()
        return self.spark.read.schema(self.SCHEMA).parquet(f"{self.folder}/v{versions[-1]}") if versions else self.spark.createDataFrame([], self.SCHEMA)

    def _change(self, table: DataFrame) -> None:
        versions = self._versions()
        table.coalesce(1).write.parquet(f"{self.folder}/v{versions[-1] + 1 if versions else 0}")
        path, files = self._files()
        for v in versions:
            files.delete(path(f"{self.folder}/v{v}"), True)

    def add(self, name: str, text: str, runtime: str | None = None) -> None:
        """Append a checked configuration, inactive."""
        parse(text)
        table = self._table()
        place = table.agg(F.coalesce(F.max("place") + 1, F.lit(0))).first()[0]
        self._change(table.unionByName(self.spark.createDataFrame([(place, name, False, runtime, text)], self.SCHEMA)))

    def names(self) -> list[str]:
        return [r["name"] for r in self._table().select("name").where("name IS NOT NULL").orderBy("name").collect()]

    def activate(self, name: str) -> None:
        """Make the first configuration of that name the only active one; an unknown name changes nothing."""
        table = self._table()
        first = table.where(F.col("name") == name).agg(F.min("place").alias("place")).first()["place"]
        if first is None:
            raise InvalidConfig(f"no configuration is named {name!r}")
        self._change(table.withColumn("active", F.col("place") == first))

    def _active(self):
        row = self._table().where("active").limit(1).first()
        if row is None:
            raise NoActiveConfig("no configuration is active")
        return row

    def active(self) -> Config:
        return parse(self._active()["body"])

    def runtime(self) -> str | None:
        return self._active()["runtime"]
