"""Coordinate arithmetic on columns: linear ids, group geometry, tiles, and colour curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def keys(dims: int) -> list[str]:
    """Names of the coordinate columns, the slowest dimension first."""
    return [f"i{d}" for d in range(dims)]


def div(a: Column | str, n: int) -> Column:
    """Floor division of a coordinate that isn't negative, as a long."""
    a = F.col(a) if isinstance(a, str) else a
    return F.floor(a / F.lit(n)).cast("long") if n & (n - 1) else F.shiftright(a, n.bit_length() - 1)


def linear_id(shape: Sequence[int], offset: Sequence[int] | None = None, names: Sequence[str] | None = None) -> Column:
    """Row-major number of a cell, counted from ``offset``."""
    names = names or keys(len(shape))
    out = F.lit(0).cast("long")
    for d, n in enumerate(shape):
        out = out * n + (F.col(names[d]) - (offset[d] if offset else 0))
    return out


def from_linear(linear: Column, shape: Sequence[int]) -> list[Column]:
    """The coordinates of a row-major number."""
    out, rest = [], linear
    for n in reversed(shape[1:]):
        out.append((rest % n).cast("long"))
        rest = div(rest, n)
    return [rest.cast("long"), *reversed(out)]


def group_columns(shape: Sequence[int], local: Sequence[int], offset: Sequence[int] | None = None) -> dict[str, Column]:
    """Work-group geometry of each cell: ``g<d>``, ``l<d>``, and their row-major numbers ``group`` and ``lane``.

    A group size must divide its extent.
    """
    for n, k in zip(shape, local, strict=True):
        if k < 1 or n % k:
            raise ValueError(f"a group of {k} does not divide the extent {n}")
    out: dict[str, Column] = {}
    group, lane = F.lit(0).cast("long"), F.lit(0).cast("long")
    for d, (n, k) in enumerate(zip(shape, local, strict=True)):
        i = F.col(f"i{d}") - (offset[d] if offset else 0)
        g, at = div(i, k), i % k
        out[f"g{d}"], out[f"l{d}"] = g, at
        group, lane = group * (n // k) + g, lane * k + at
    return out | {"group": group, "lane": lane}


def linearised(c: Column) -> Column:
    """sRGB (0 to 1) to linear light."""
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def compressed(c: Column) -> Column:
    """Linear light to sRGB."""
    return F.when(c <= 0.0031308, c * 12.92).otherwise(F.pow(c, F.lit(1 / 2.4)) * 1.055 - 0.055)


def truncated_byte(c: Column) -> Column:
    """0 to 1 as a byte without rounding up; noise below 1e-6 doesn't count."""
    return F.floor(F.round(c * 255.0, 6)).cast("int")
