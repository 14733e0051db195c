"""Sizes as people write them."""

from __future__ import annotations

_UNITS = {"KB": 1 << 10, "MB": 1 << 20, "GB": 1 << 30, "K": 1 << 10, "M": 1 << 20, "G": 1 << 30}


def bytes_of(text: str, most: int = 4 << 30) -> int:
    """Bytes of 12KB, 3 mb or 4096; at most `most`."""
    t = text.strip().upper()
    unit = next((u for u in _UNITS if t.endswith(u)), "")
    number = t[: len(t) - len(unit)].strip()
    if not number.replace(".", "", 1).isdigit():
        raise ValueError(f"not a size: {text!r}")
    return min(int(float(number) * _UNITS.get(unit, 1)), most)


def elements_of(text: str, width: int = 4) -> int:
    """Elements: a bare number counts them, one with a unit counts bytes of `width` each."""
    t = text.strip()
    return int(t) if t.isdigit() else bytes_of(t, 1 << 62) // width
