"""A configuration as one lazy plan: read, stage, select, and the models' tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axisflow.operators.extension import model_of
from axisflow.operators.staging import Staged, select_columns, stage
from axisflow.sources.config import Config
from axisflow.sources.tables import RID, load


def staged(spark: SparkSession, config: Config) -> Staged:
    return stage(load(spark, config.source), config.steps)


def run(spark: SparkSession, config: Config, train: bool = True) -> dict[str, DataFrame]:
    """The staged table as `data`, and for each wanted model tag its scores. A model with input_from has the
    probabilities of that model's scores as a further feature."""
    done = staged(spark, config)
    out = {"data": done.table}
    wanted = set(config.outputs or (m.tag for m in config.models))
    needed = set(wanted)
    for m in reversed(config.models):  # a model comes after those it takes its input from
        if m.tag in needed and m.input_from:
            needed.add(m.input_from)
    for m in config.models if train else ():
        if m.tag in needed:
            table = select_columns(done.table, m.input_columns, m.target_columns)
            if m.input_from:
                scores = out[m.input_from].select(RID, F.array("probability").alias("_p"))
                table = table.join(scores, RID).withColumn("v", F.concat(F.transform("v", lambda x: x.cast("double")), "_p")).drop("_p")
            out[m.tag] = model_of(m).execute(spark, table)["scores"]
    return {k: df for k, df in out.items() if k == "data" or k in wanted}
