"""Sample semantics as Spark columns: validity, physical values, conversion."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.model import SAMPLE_TYPES, Grid


def number(value: float) -> Column:
    return F.lit(float(value))


def finite(value: Column) -> Column:
    """Neither null, NaN nor infinite."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < number(math.inf))


def differs(value: Column, no_data: float | None) -> Column:
    """Whether a finite value is not the NoData value; NaN as NoData equals no finite value."""
    return F.lit(True) if no_data is None or math.isnan(no_data) else value != number(no_data)


def stored_no_data(no_data: float | None, data_type: int) -> float | None:
    """NoData as the storage type holds it."""
    if no_data is None or data_type != 4 or not math.isfinite(no_data):
        return no_data
    import struct

    return struct.unpack("<f", struct.pack("<f", no_data))[0]


def valid(value: Column, no_data: float | None, override: float | None = None) -> Column:
    """Finite and not NoData; an override replaces the band's own NoData."""
    return finite(value) & differs(value, no_data if override is None else override)


def physical(value: Column, scale: float = 1.0, offset: float = 0.0) -> Column:
    return value * number(scale) + number(offset)


def convert(value: Column, data_type: int, failed: str = "") -> Column:
    """A finite value in the range and precision of a sample type; others raise, with ``failed`` before the message."""
    name, low, high, _ = SAMPLE_TYPES[data_type]
    if data_type == 5:
        out, fits = value, finite(value)
    elif data_type == 4:
        out = value.cast("float").cast("double")
        fits = finite(value) & finite(out)
    else:
        out = F.rint(value)
        fits = finite(value) & (out >= low) & (out <= high)
    return F.when(fits, out).otherwise(F.raise_error(F.concat(F.lit(f"{failed}{name} output overflow: "), F.coalesce(value.cast("string"), F.lit("null")))))


def representable(no_data: float | None, data_type: int, lenient: bool = False) -> bool:
    """Whether a sample type can hold ``no_data``.

    NaN only in floating-point types. ``lenient`` is the rule of direct clips,
    where infinities also hold in floating-point types.
    """
    if no_data is None:
        return True
    _, low, high, _ = SAMPLE_TYPES[data_type]
    if data_type >= 4:
        if math.isnan(no_data) or data_type == 5 and (lenient or math.isfinite(no_data)):
            return True
        if math.isinf(no_data):
            return lenient
        try:
            return stored_no_data(no_data, data_type) == no_data
        except OverflowError:
            return False
    return math.isfinite(no_data) and no_data == int(no_data) and low <= no_data <= high


def world(grid: Grid, x: Column, y: Column) -> tuple[Column, Column]:
    """World coordinates of pixel centres."""
    return number(grid.m00) * x + number(grid.m01) * y + number(grid.m02), number(grid.m10) * x + number(grid.m11) * y + number(grid.m12)


def pixel(grid: Grid, wx: Column, wy: Column) -> tuple[Column, Column]:
    """Fractional pixel coordinates of world coordinates."""
    d, dx, dy = number(grid.determinant), wx - number(grid.m02), wy - number(grid.m12)
    return (number(grid.m11) * dx - number(grid.m01) * dy) / d, (number(grid.m00) * dy - number(grid.m10) * dx) / d


def inside(x: Column, y: Column, width: int, height: int) -> Column:
    """Within the pixels' edges, half open."""
    return (x >= -0.5) & (x < width - 0.5) & (y >= -0.5) & (y < height - 0.5)


def channel_maximum(data_type: int) -> float:
    return {0: 255.0, 1: 65535.0}.get(data_type, 1.0)


def eight_bits(palette: tuple[int, ...]) -> tuple[int, ...]:
    """A palette's entries of 16 bits as those of 8 bits that displays take."""
    return tuple(v // 257 for v in palette)
