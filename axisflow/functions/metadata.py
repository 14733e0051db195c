"""Shapes and strides of tensors: pure functions, carried on the driver beside the DataFrame that holds the values."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from axisflow.errors import ShapeMismatch


def next_power_of_two(n: int) -> int:
    return 1 if n <= 1 else 1 << (n - 1).bit_length()


def row_major(shape: Sequence[int]) -> tuple[int, ...]:
    """Strides with the last axis contiguous."""
    return tuple(math.prod(shape[i + 1 :]) for i in range(len(shape)))


def column_major(shape: Sequence[int]) -> tuple[int, ...]:
    """Strides with the first axis contiguous."""
    return tuple(math.prod(shape[:i]) for i in range(len(shape)))


@dataclass(frozen=True)
class Metadata:
    """Strides and shape of a dense tensor; strides come first, as constructor arguments too."""

    stride: tuple[int, ...]
    shape: tuple[int, ...]

    @staticmethod
    def of(shape: Sequence[int]) -> Metadata:
        return Metadata(row_major(shape), tuple(shape))

    @staticmethod
    def scalar() -> Metadata:
        return Metadata.of((1, 1))

    @staticmethod
    def vector(n: int) -> Metadata:
        return Metadata.of((1, n))

    @staticmethod
    def matrix(rows: int, columns: int) -> Metadata:
        return Metadata.of((rows, columns))

    @property
    def ndim(self) -> int:
        return len(self.shape)

    @property
    def count(self) -> int:
        return math.prod(self.shape)

    @property
    def is_row_major(self) -> bool:
        return self.stride == row_major(self.shape)

    @property
    def is_column_major(self) -> bool:
        return self.stride == column_major(self.shape)

    def nbytes(self, element: int) -> int:
        return self.count * element

    def reshape(self, shape: Sequence[int]) -> Metadata | None:
        """Row-major metadata of the new shape, or None if it holds another number of elements."""
        return Metadata.of(shape) if math.prod(shape) == self.count else None

    def flat(self, index: Sequence[int]) -> int:
        return sum(i * s for i, s in zip(index, self.stride, strict=True))

    def unflat(self, flat: int) -> tuple[int, ...]:
        """The index of a flat place in row-major order."""
        return tuple(flat // s % n for s, n in zip(row_major(self.shape), self.shape))

    def stacked(self) -> Metadata:
        """Two tensors of this shape as one: a vector's axis of one becomes two, any other shape gets a last axis of two."""
        ones = [i for i, n in enumerate(self.shape) if n == 1] if self.ndim == 2 else []
        return Metadata.of([2 if i == ones[0] else n for i, n in enumerate(self.shape)] if ones else [*self.shape, 2])

    def _rank_two(self) -> None:
        if self.ndim != 2:
            raise ShapeMismatch(f"padding takes two axes, not {self.ndim}")

    @property
    def needs_row_padding(self) -> bool:
        self._rank_two()
        return self.shape[0] != next_power_of_two(self.shape[0])

    @property
    def needs_column_padding(self) -> bool:
        self._rank_two()
        return self.shape[1] != next_power_of_two(self.shape[1])

    def with_row_padding(self) -> Metadata:
        self._rank_two()
        return Metadata.of((next_power_of_two(self.shape[0]), self.shape[1]))

    def with_column_padding(self) -> Metadata:
        self._rank_two()
        return Metadata.of((self.shape[0], next_power_of_two(self.shape[1])))

    def row_padding_bytes(self, element: int) -> int:
        return self.with_row_padding().nbytes(element) - self.nbytes(element)

    def column_padding_bytes(self, element: int) -> int:
        return self.with_column_padding().nbytes(element) - self.nbytes(element)


def pad_to_line(n: int, line: int) -> int:
    """The least multiple of the line width that holds n."""
    return -(-n // line) * line
