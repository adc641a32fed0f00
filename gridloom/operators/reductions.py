"""Folds of a whole buffer into a scalar, and of its dimensions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.combiners import COMBINERS
from ..functions.coordinates import div
from .buffer import Buffer


def reduction(buffer: Buffer, include: Buffer | None = None, **outputs: tuple[str, Column | str]) -> DataFrame:
    """One row with each of ``outputs``: name=(combiner, value); all in one pass, summed before the shuffle.

    ``include`` is the target's earlier value (of no dimensions, a column for
    each output), which then counts as one more value; without it the fold
    begins at the identity.
    """
    rows = buffer.df.select(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, (_, c) in outputs.items()])
    if include is not None:
        if include.shape:
            raise ValueError("a reduction's target has one element")
        rows = rows.unionByName(include.df.select(*outputs))
    return rows.agg(*[COMBINERS[op].fold(F.col(n)).alias(n) for n, (op, _) in outputs.items()])


def several(buffer: Buffer, **columns: Sequence[Column | str]) -> Buffer:
    """A row for each of several values that an item gives to a reduction: name=[value, …]."""
    (name, vals), = columns.items()
    return Buffer(buffer.df.select(*buffer.keys, F.explode(F.array(*vals)).alias(name)), buffer.shape, (name,))


def combined(rows: DataFrame, order: str, value: Column | str, identity: Column, combine: Callable[[Column, Column], Column], name: str = "v", fan: int = 1024) -> DataFrame:
    """One row: a fold by a combiner of one's own, which must be associative and commutative, from its identity.

    A tree over a dense coordinate: runs of ``fan`` cells become one, until one
    run is left, so that no task gathers more than ``fan`` values. No rows give
    the identity.
    """
    v = F.col(value) if isinstance(value, str) else value
    now = rows.select(F.col(order).cast("long").alias("_i"), v.alias("_v"))
    top = now.agg(F.max("_i")).first()[0]
    while True:
        pairs = F.transform(F.array_sort(F.collect_list(F.struct("_i", "_v"))), lambda s: s["_v"])
        if top is None or top < fan:
            return now.agg(F.aggregate(pairs, identity, combine).alias(name))
        now = now.groupBy(div("_i", fan).alias("_g")).agg(F.aggregate(pairs, identity, combine).alias("_v")).select(F.col("_g").alias("_i"), "_v")
        top //= fan


def reduce_dims(buffer: Buffer, over: Sequence[int], **outputs: tuple[str, Column | str]) -> Buffer:
    """A fold over some dimensions, for each coordinate of the others, which are then numbered anew."""
    rest = [d for d in range(len(buffer.shape)) if d not in over]
    aggs = [COMBINERS[op].fold(F.col(c) if isinstance(c, str) else c).alias(n) for n, (op, c) in outputs.items()]
    df = buffer.df.groupBy(*[F.col(f"i{d}").alias(f"i{k}") for k, d in enumerate(rest)]).agg(*aggs)
    return Buffer(df, tuple(buffer.shape[d] for d in rest), tuple(outputs))


def equal_everywhere(a: Buffer, b: Buffer, tolerance: float = 0.0) -> DataFrame:
    """One row, ``same``: whether both have the same cells with equal values."""
    x, y = a.df.select(*a.keys, F.col(a.values[0]).alias("_x")), b.df.select(*b.keys, F.col(b.values[0]).alias("_y"))
    match = F.col("_x").eqNullSafe(F.col("_y")) if not tolerance else F.coalesce(F.abs(F.col("_x") - F.col("_y")) <= tolerance, F.lit(False))
    return x.join(y, a.keys, "full_outer").agg(F.coalesce(F.bool_and(match), F.lit(True)).alias("same"))
