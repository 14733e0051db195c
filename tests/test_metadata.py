import pytest
from hypothesis import given
from hypothesis import strategies as st

from axisflow.errors import ShapeMismatch
from axisflow.functions.metadata import Metadata, column_major, next_power_of_two, pad_to_line, row_major
from axisflow.functions.sizes import bytes_of, elements_of


def test_constructors():
    assert Metadata.scalar().shape == (1, 1)
    assert Metadata.vector(5).shape == (1, 5)
    assert Metadata.matrix(3, 4) == Metadata((4, 1), (3, 4))


def test_strides():
    assert row_major((2, 3, 4)) == (12, 4, 1)
    assert column_major((2, 3, 4)) == (1, 2, 6)
    assert Metadata.of((2, 3)).is_row_major and not Metadata.of((2, 3)).is_column_major
    assert Metadata(column_major((2, 3)), (2, 3)).is_column_major


def test_reshape():
    assert Metadata.of((2, 6)).reshape((3, 4)) == Metadata.of((3, 4))
    assert Metadata.of((2, 3)).reshape((2, 2)) is None
    assert Metadata.of((2, 3)).nbytes(4) == 24


@given(st.lists(st.integers(1, 5), min_size=1, max_size=4), st.data())
def test_flat_places_round_trip(shape, data):
    m = Metadata.of(shape)
    flat = data.draw(st.integers(0, m.count - 1))
    assert m.flat(m.unflat(flat)) == flat


def test_stacked():
    assert Metadata.vector(4).stacked().shape == (2, 4)
    assert Metadata.matrix(4, 1).stacked().shape == (4, 2)
    assert Metadata.of((2, 3)).stacked() == Metadata((6, 2, 1), (2, 3, 2))


@pytest.mark.parametrize("n, p", [(0, 1), (1, 1), (3, 4), (5, 8), (8, 8), (127, 128), (4097, 8192)])
def test_next_power_of_two(n, p):
    assert next_power_of_two(n) == p


def test_padding():
    m = Metadata.matrix(3, 5)
    assert m.needs_row_padding and m.needs_column_padding
    assert m.with_row_padding().shape == (4, 5) and m.with_column_padding().shape == (3, 8)
    assert m.row_padding_bytes(4) == 20 and m.column_padding_bytes(4) == 36
    with pytest.raises(ShapeMismatch):
        Metadata.of((2, 2, 2)).with_row_padding()
    assert pad_to_line(5, 4) == 8


def test_sizes():
    assert bytes_of("12KB") == 12288 and bytes_of("3 mb") == 3 << 20 and bytes_of("99GB") == 4 << 30
    assert elements_of("1000") == 1000 and elements_of("1KB") == 256
    with pytest.raises(ValueError):
        bytes_of("many")
