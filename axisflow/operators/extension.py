"""What a new operator, model or strategy implements."""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession

from axisflow.errors import NotTrainable
from axisflow.sources.config import Model as ModelConfig


class Kernel(Protocol):
    """inputs: up to three tables. Returns one or two tables, lazily."""

    def __call__(self, config: Any, *inputs: DataFrame) -> DataFrame | tuple[DataFrame, ...]: ...


@dataclass(frozen=True)
class Order:
    """A kernel with its configuration, ready for tables."""

    kernel: Kernel
    config: Any = None

    def run(self, *inputs: DataFrame) -> DataFrame | tuple[DataFrame, ...]:
        if len(inputs) > 3:
            raise ValueError("a kernel takes three inputs at most")
        return self.kernel(self.config, *inputs)


class Model(ABC):
    @abstractmethod
    def execute(self, spark: SparkSession, table: DataFrame) -> dict[str, DataFrame]:
        """Train or run on a table."""


class StrategySelector(Protocol):
    def __call__(self, profile, group) -> str: ...


def model_of(config: ModelConfig) -> Model:
    """The model of a configuration; kinds that can only be configured raise."""
    from axisflow.operators.gbdt import Gbdt, GbdtConfig

    own = config.gbdt()
    if config.mode != "Train":
        raise NotTrainable(f"mode {config.mode} needs a trained model, and none is stored")
    if len(config.target_columns) != 1:
        raise NotTrainable("trees take one target column")
    return Gbdt(GbdtConfig(n_trees=own.n_trees, learning_rate=own.learning_rate, max_depth=own.max_depth, subsample=own.sub_sample), config.target_columns[0])
