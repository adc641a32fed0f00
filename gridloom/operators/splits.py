"""How an index space is cut into chunks, and the same as columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mappers import even_bounds
from .regions import Box


def split_1d(box: Box, granularity: Sequence[int], parts: int) -> list[Box]:
    """Slabs along the first dimension: at most ``parts``, on multiples of the granularity, larger ones first."""
    n = box.range[0]
    bounds = even_bounds(n, min(parts, n // granularity[0]), granularity[0])
    return [Box((box.min[0] + a, *box.min[1:]), (box.min[0] + b, *box.max[1:])) for a, b in bounds]


#: What counts as a nearly square domain. The bounds of chunks must be those that users of 2-D splits know.
SQUARE = (0.95, 1.05)


def grid_shape(extent: Sequence[int], granularity: Sequence[int], parts: int) -> tuple[int, int]:
    """Rows and columns of the tile grid that split_2d makes.

    Of all factorisations the one with the most tiles wins, near-square ones
    first. Where its two orientations tie, a nearly square domain has more rows
    than columns, another one the shorter tile edges.
    """
    most = [extent[0] // granularity[0], extent[1] // granularity[1]]
    best: tuple[int, int] = (0, 0)
    for a in (f for f in range(math.isqrt(parts), 0, -1) if parts % f == 0):
        tall, wide = ((min(x, most[0]), min(y, most[1])) for x, y in ((parts // a, a), (a, parts // a)))
        if math.prod(tall) != math.prod(wide):
            pick = max(tall, wide, key=math.prod)
        elif SQUARE[0] < math.sqrt(extent[0] * extent[1]) / extent[0] < SQUARE[1]:
            pick = tall
        else:
            edge = {g: extent[0] // g[0] + extent[1] // g[1] for g in (tall, wide)}
            pick = wide if edge[wide] < edge[tall] else tall
        if math.prod(pick) > math.prod(best):
            best = pick
    return best


def split_2d(box: Box, granularity: Sequence[int], parts: int) -> list[Box]:
    """Tiles of the first two dimensions, at most ``parts``."""
    rows, cols = grid_shape(box.range[:2], granularity, parts)
    out = []
    for a, b in even_bounds(box.range[0], rows, granularity[0]):
        for c, d in even_bounds(box.range[1], cols, granularity[1]):
            out.append(Box((box.min[0] + a, box.min[1] + c, *box.min[2:]), (box.min[0] + b, box.min[1] + d, *box.max[2:])))
    return out


def split_constraint(extent: Sequence[int], constraint: Sequence[int], local: Sequence[int] | None = None) -> tuple[int, ...]:
    """The granularity that a constraint and a group size need together; raises if it doesn't divide the extent."""
    if any(c == 0 for c in constraint):
        raise ValueError("a split constraint cannot be 0")
    both = tuple(math.lcm(c, k) for c, k in zip(constraint, local or [1] * len(constraint), strict=True))
    for n, g in zip(extent, both, strict=True):
        if n % g:
            raise ValueError(f"a split constraint of {g} does not evenly divide the extent {n}")
    return both


def run_of(i: Column | str, n: int, parts: int, granularity: int = 1) -> Column:
    """The number of the even run that a coordinate is in: a formula, no join."""
    i = F.col(i) if isinstance(i, str) else i
    each, more = divmod(n // granularity, parts)
    block = F.floor(i / granularity)
    head = more * (each + 1)
    late = F.least(F.floor((block - head) / max(1, each)) + more, F.lit(parts - 1)) if each else F.lit(parts - 1)
    return F.when(block < head, F.floor(block / (each + 1))).otherwise(late).cast("long")


def tile_of(shape: Sequence[int], granularity: Sequence[int], parts: int) -> Column:
    """The number of the split_2d tile that a cell is in."""
    rows, cols = grid_shape(shape[:2], granularity, parts)
    return run_of("i0", shape[0], rows, granularity[0]) * cols + run_of("i1", shape[1], cols, granularity[1])


def distributed(df: DataFrame, chunk: Column, chunks: int, factor: int = 1) -> DataFrame:
    """Rows dealt to a partition for each chunk, or ``factor`` of them (oversubscription)."""
    if factor < 1:
        raise ValueError("an oversubscription factor cannot be 0")
    salt = [F.pmod(F.xxhash64(*df.columns), F.lit(factor))] if factor > 1 else []
    return df.repartition(chunks * factor, chunk, *salt)
