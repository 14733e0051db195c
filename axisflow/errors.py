"""Exceptions of the engine."""


class AxisflowError(Exception):
    """Base of all of them."""


class InvalidConfig(AxisflowError):
    """A configuration that can't be read or has another version."""


class NoActiveConfig(AxisflowError):
    """No stored configuration is active."""


class DataTypeNotSupported(AxisflowError):
    """No reader for a source's type."""


class NoTransformationsDefined(AxisflowError):
    """The data section has no list of transformations."""


class NoTransformationParams(AxisflowError):
    """A transformation without its parameters."""


class TransformationParamsWrong(AxisflowError):
    """Parameters of another shape than the transformation takes."""


class NoInputColumns(AxisflowError):
    """Columns are named but the table has no header."""


class EmptyTable(AxisflowError):
    """A source without rows."""


class ShapeMismatch(AxisflowError):
    """Shapes that don't go together."""


class UnsupportedType(AxisflowError):
    """A column that isn't numeric where numbers are needed."""


class UnknownShard(AxisflowError):
    """A tensor has no part on the shard asked for."""


class UnknownTensor(AxisflowError):
    """No tensor of that number."""


class GroupError(AxisflowError):
    """A worker group that is unknown, disabled, empty or overlaps another."""


class NotTrainable(AxisflowError):
    """A model kind that can be configured but not run."""
