"""Coordinates and extents on the driver: tuples with arithmetic by dimension."""

from __future__ import annotations

import operator
from collections.abc import Callable


class Point(tuple):
    """A coordinate or an extent of up to three dimensions.

    Arithmetic, shifts and bitwise operations take another point or one number
    for all dimensions; so do ``equal``, ``less`` and ``at_most``, which give a
    point of booleans (``==`` and ``<`` are those of tuples).
    """

    __slots__ = ()

    def __new__(cls, *values: int):
        if len(values) > 3:
            raise ValueError("a point has at most 3 dimensions")
        return super().__new__(cls, values)

    def _with(self, other: object, f: Callable, turned: bool = False) -> Point:
        others = other if isinstance(other, tuple) else (other,) * len(self)
        return Point(*(f(b, a) if turned else f(a, b) for a, b in zip(self, others, strict=True)))

    def all_true(self) -> bool:
        return all(self)

    def cast(self, dims: int, fill: int = 0) -> Point:
        """Dimensions are dropped, or added with ``fill``: 1 for an extent, 0 for a coordinate."""
        return Point(*(*self, *(fill,) * dims)[:dims])

    def min(self, other: object) -> Point:
        return self._with(other, min)

    def max(self, other: object) -> Point:
        return self._with(other, max)

    def equal(self, other: object) -> Point:
        return self._with(other, operator.eq)

    def less(self, other: object) -> Point:
        return self._with(other, operator.lt)

    def at_most(self, other: object) -> Point:
        return self._with(other, operator.le)

    def linear(self, extent: tuple[int, ...]) -> int:
        """The row-major number of a coordinate in an extent."""
        out = 0
        for i, n in zip(self, extent, strict=True):
            out = out * n + i
        return out

    def __neg__(self) -> Point:
        return Point(*(-a for a in self))

    def __invert__(self) -> Point:
        return Point(*(~a for a in self))


def _install(name: str, f: Callable) -> None:
    setattr(Point, f"__{name}__", lambda self, other: self._with(other, f))
    setattr(Point, f"__r{name}__", lambda self, other: self._with(other, f, turned=True))


for _name, _f in (("add", operator.add), ("sub", operator.sub), ("mul", operator.mul), ("floordiv", operator.floordiv), ("mod", operator.mod), ("lshift", operator.lshift), ("rshift", operator.rshift), ("and", operator.and_), ("or", operator.or_), ("xor", operator.xor)):
    _install(_name, _f)
