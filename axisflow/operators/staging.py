"""From a table of texts to a table of floats."""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axisflow.errors import InvalidConfig, NoInputColumns, NoTransformationParams, NoTransformationsDefined, TransformationParamsWrong
from axisflow.functions.lineage import kept
from axisflow.operators.sorting import with_positions
from axisflow.sources.config import Step
from axisflow.sources.tables import RID

#: Dictionaries of at most so many entries are broadcast.
FEW = 100_000
#: Fixed value: what counts as a number, in full.
NUMBER = r"(?i)^[+-]?(inf|infinity|nan|([0-9]+(\.[0-9]*)?|\.[0-9]+)(e[+-]?[0-9]+)?)\z"


def _numbered(df: DataFrame, column: str, order: str) -> tuple[DataFrame, bool]:
    """The dictionary, and whether it has at most FEW entries."""
    first = kept(df.groupBy(F.col(f"`{column}`").alias("category")).agg(F.min(order).alias("first")))
    if first.count() <= FEW:
        return first.select("category", (F.row_number().over(Window.orderBy("first")) - 1).alias("id")), True
    return kept(with_positions(first, "first").select("category", F.col("pos").cast("int").alias("id"))), False


def dictionary(df: DataFrame, column: str, order: str = RID) -> DataFrame:
    """category, id: a column's values numbered from 0 in order of their first row. Null is a category.

    Only distinct values are numbered: first rows come from map-side minima. Up to FEW of them are one window, more
    get their places from a range-partitioned sort."""
    return _numbered(df, column, order)[0]


def encode(df: DataFrame, column: str, order: str = RID) -> tuple[DataFrame, DataFrame]:
    """df with the column as category ids, and the dictionary."""
    words, small = _numbered(df, column, order)
    keyed = words.select(F.col("category").alias("__category"), F.col("id").alias("__id"))
    joined = df.join(F.broadcast(keyed) if small else keyed, F.col(f"`{column}`").eqNullSafe(F.col("__category")), "left")
    return joined.select(*(F.col("__id").alias(c) if c == column else F.col(f"`{c}`") for c in df.columns)), words


def to_float(c: Column) -> Column:
    """A text as a float, NaN where it isn't a number; blanks around it, 1f and 1d aren't numbers."""
    text = c.cast("string")
    return F.when(text.rlike(NUMBER), text.try_cast("float")).otherwise(F.lit(float("nan")).cast("float"))


def to_float_table(df: DataFrame, keep: tuple[str, ...] = (RID,)) -> DataFrame:
    """Every column as floats but those in keep."""
    return df.select(*(F.col(f"`{c}`") if c in keep else F.coalesce(to_float(F.col(f"`{c}`")), F.lit(float("nan")).cast("float")).alias(c) for c in df.columns))


class Staged:
    """The table that the steps so far have made, and the dictionaries by column."""

    def __init__(self, table: DataFrame, dictionaries: dict[str, DataFrame] | None = None):
        self.table, self.dictionaries = table, dictionaries or {}


def _categories(staged: Staged, step: Step) -> Staged:
    if step.params is None:
        raise NoTransformationParams("categories needs its columns")
    columns = step.params.get("columns") if isinstance(step.params, dict) else None
    if not isinstance(columns, (list, tuple)) or not all(isinstance(c, str) for c in columns):
        raise TransformationParamsWrong("categories takes a list of column names")
    if not [c for c in staged.table.columns if c != RID]:
        raise NoInputColumns("the table has no columns")
    table, words = staged.table, dict(staged.dictionaries)
    for c in columns:
        if c in table.columns:  # unknown names are passed over
            table, words[c] = encode(table, c)
    return Staged(table, words)


def _dates(staged: Staged, step: Step) -> Staged:
    raise NotImplementedError("date_conv has no defined meaning")


STEPS = {"categories": _categories, "date_conv": _dates}


def apply_step(staged: Staged, step: Step) -> Staged:
    if step.operation not in STEPS:
        warnings.warn(f"unknown operation {step.operation!r} is passed over", stacklevel=2)
        return staged
    return STEPS[step.operation](staged, step)


def stage(table: DataFrame, steps: tuple[Step, ...] | None) -> Staged:
    """Apply the steps in their order, then turn every column into floats."""
    if steps is None:
        raise NoTransformationsDefined("the data section has no list of transformations")
    done = reduce(apply_step, steps, Staged(table))
    return Staged(to_float_table(done.table), done.dictionaries)


def select_columns(table: DataFrame, inputs: tuple[str, ...], targets: tuple[str, ...]) -> DataFrame:
    """RID, a model's input columns as the array v, and its targets."""
    if missing := [c for c in (*inputs, *targets) if c not in table.columns]:
        raise InvalidConfig(f"no columns named {', '.join(missing)}")
    return table.select(RID, F.array(*(F.col(f"`{c}`") for c in inputs)).alias("v"), *(F.col(f"`{c}`") for c in targets))
