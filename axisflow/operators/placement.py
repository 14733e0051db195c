"""Tensors by number: each is one DataFrame with a shard column, so "on a device" means "of a shard"."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axisflow.errors import UnknownShard, UnknownTensor
from axisflow.functions.metadata import Metadata

SCHEMA = "shard int, pos long, x double"


class Tensors:
    """A registry of logical tensors over `shards` shards. Operators are lazy; reading is an action."""

    def __init__(self, spark: SparkSession, shards: int):
        self.spark, self.shards, self._next = spark, shards, 0
        self._known: dict[int, tuple[DataFrame, dict[int, Metadata]]] = {}

    def register(self, df: DataFrame, metadata: dict[int, Metadata]) -> int:
        self._next += 1
        self._known[self._next] = (df.select("shard", "pos", "x"), dict(metadata))
        return self._next

    def _get(self, tensor: int) -> tuple[DataFrame, dict[int, Metadata]]:
        if tensor not in self._known:
            raise UnknownTensor(f"no tensor {tensor}")
        return self._known[tensor]

    def table(self, tensor: int) -> DataFrame:
        return self._get(tensor)[0]

    def metadata(self, tensor: int, shard: int) -> Metadata:
        self._check(tensor, [shard])
        return self._get(tensor)[1][shard]

    def _check(self, tensor: int, shards: Iterable[int]) -> None:
        if missing := set(shards) - self._get(tensor)[1].keys():
            raise UnknownShard(f"tensor {tensor} has no part on {sorted(missing)}")

    def _range(self, shards: Iterable[int]) -> list[int]:
        own = sorted(set(shards))
        if bad := [s for s in own if not 0 <= s < self.shards]:
            raise UnknownShard(f"no shards {bad}")
        return own

    def _filled(self, metadata: Metadata, shards: list[int], value: float) -> DataFrame:
        places = self.spark.range(metadata.count).withColumnRenamed("id", "pos")
        return places.select(F.explode(F.array(*map(F.lit, shards))).alias("shard"), "pos", F.lit(value).alias("x"))

    def empty(self, metadata: Metadata, shard: int) -> int:
        return self.register(self._filled(metadata, self._range([shard]), 0.0), {shard: metadata})

    def empty_everywhere(self, metadata: Metadata) -> int:
        own = list(range(self.shards))
        return self.register(self._filled(metadata, own, 0.0), dict.fromkeys(own, metadata))

    def _local(self, parts: dict[int, list[float]]) -> DataFrame:
        return self.spark.createDataFrame([(s, i, float(x)) for s, values in parts.items() for i, x in enumerate(values)], SCHEMA)

    def send(self, values: list[float], metadata: Metadata, shard: int) -> int:
        self._range([shard])
        return self.register(self._local({shard: values}), {shard: metadata})

    def send_parts(self, parts: list[list[float]], metadata: list[Metadata]) -> int:
        """One part for every shard."""
        if len(parts) != self.shards or len(metadata) != self.shards:
            raise UnknownShard(f"{len(parts)} parts for {self.shards} shards")
        return self.register(self._local(dict(enumerate(parts))).repartition("shard"), dict(enumerate(metadata)))

    def send_everywhere(self, values: list[float], metadata: Metadata) -> int:
        own = list(range(self.shards))
        one = self._local({0: values}).select(F.explode(F.array(*map(F.lit, own))).alias("shard"), "pos", "x")
        return self.register(one, dict.fromkeys(own, metadata))

    def apply(self, op: Callable[..., DataFrame], *tensors: int, shards: Iterable[int] | None = None, strict: bool = True) -> int:
        """op on the parts of tensors on some shards (all, if none are named).

        strict: a shard that lacks a part is an error; otherwise it is left out."""
        wanted = self._range(range(self.shards) if shards is None else shards)
        if strict:
            for t in tensors:
                self._check(t, wanted)
        own = [s for s in wanted if all(s in self._get(t)[1] for t in tensors)]
        out = op(*(self.table(t).where(F.col("shard").isin(own)) for t in tensors))
        return self.register(out, {s: self._get(tensors[0])[1][s] for s in own})

    def read(self, tensor: int, shard: int) -> list[float]:
        """A part's values in order."""
        self._check(tensor, [shard])
        return [r["x"] for r in self.table(tensor).where(F.col("shard") == shard).orderBy("pos").select("x").collect()]

    def read_all(self, tensor: int) -> dict[int, list[float]]:
        return {s: self.read(tensor, s) for s in sorted(self._get(tensor)[1])}

    def remove(self, tensor: int) -> None:
        self._get(tensor)[0].unpersist()
        del self._known[tensor]

    def exists(self, tensor: int) -> bool:
        return tensor in self._known

    def nbytes(self, tensor: int, element: int = 8) -> int:
        return sum(m.nbytes(element) for m in self._get(tensor)[1].values())

    def numbers(self) -> list[int]:
        return sorted(self._known)

    def keep(self, tensor: int) -> None:
        self._get(tensor)[0].persist()

    def sync(self, tensor: int) -> None:
        """Compute a tensor now, without a result."""
        self.table(tensor).write.format("noop").mode("overwrite").save()

    def sync_all(self) -> None:
        for t in self.numbers():
            self.sync(t)

    def shutdown(self) -> None:
        """Forget every tensor; the session stays its owner's."""
        for t in self.numbers():
            self.remove(t)
