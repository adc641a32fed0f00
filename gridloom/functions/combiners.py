"""Combiners of reductions and scans: Spark aggregates, identities, and two-argument forms."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Combiner:
    """An associative and commutative operation: over a column, over two, and its neutral element."""

    fold: Callable[[Column], Column]
    pair: Callable[[Column, Column], Column]
    identity: object


#: By name; an identity of None is one that the value type sets (none for min and max over an empty set).
COMBINERS = {
    "plus": Combiner(F.sum, lambda a, b: a + b, 0),
    "multiplies": Combiner(F.product, lambda a, b: a * b, 1),
    "minimum": Combiner(F.min, lambda a, b: F.least(a, b), None),
    "maximum": Combiner(F.max, lambda a, b: F.greatest(a, b), None),
    "bit_and": Combiner(F.bit_and, lambda a, b: a.bitwiseAND(b), -1),
    "bit_or": Combiner(F.bit_or, lambda a, b: a.bitwiseOR(b), 0),
    "bit_xor": Combiner(F.bit_xor, lambda a, b: a.bitwiseXOR(b), 0),
    "logical_and": Combiner(F.bool_and, lambda a, b: a & b, True),
    "logical_or": Combiner(F.bool_or, lambda a, b: a | b, False),
}
