"""Loops over buffers: double buffering, superstep blocking, checkpoints, and data-dependent ends."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.buffer import Buffer
from ..operators.kernels import Near, tiled
from ..sources.storage import shared_dir


def cut(df: DataFrame) -> DataFrame:
    """A frame without lineage: checkpointed in the folder that the cluster's settings name, so that it survives lost executors."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def iterate(state: DataFrame, step: Callable[[DataFrame, int], DataFrame], steps: int, checkpoint_every: int = 8) -> DataFrame:
    """Applies ``step(state, t)`` a number of times; the plan is cut every so often so that it stays small."""
    for t in range(steps):
        state = step(state, t)
        if checkpoint_every and (t + 1) % checkpoint_every == 0 and t + 1 < steps:
            state = cut(state)
    return state


def until(state: DataFrame, step: Callable[[DataFrame, int], DataFrame], measure: Callable[[DataFrame], Column], enough: Callable[[object], bool], most: int | None = None) -> tuple[DataFrame, int, object]:
    """Steps until ``enough(measure)``: each round reduces the state to one value on the driver.

    Returns the state, the number of steps taken, and the last value. It goes on
    as long as it takes, unless ``most`` is given: an error then says that so
    many steps are not enough.
    """
    value = None
    for t in count() if most is None else range(most):
        state = cut(step(state, t))
        value = state.agg(measure(state).alias("m")).first()["m"]
        if enough(value):
            return state, t + 1, value
    raise RuntimeError(f"the loop did not end in {most} steps: the last value is {value}")


def supersteps(buffer: Buffer, step: Callable[[Callable[[str, int, int], Column], int], dict[str, Column]], steps: int, reach: int = 1, border: str = "edge", per: int = 4, tile: Sequence[int] | None = None) -> Buffer:
    """Steps of a stencil with several values, in one to three dimensions, ``per`` steps for each shuffle.

    ``step(near, t)`` gives the new values; ``near(value, dim, offset)`` is a
    neighbour along an axis. Tiles get a halo of ``per * reach`` cells, whose
    outer part goes stale step by step while the tile itself stays right; after
    ``per`` steps the tiles are cut anew and the plan with them.
    """
    values, dims = list(buffer.values), len(buffer.keys)
    extent = buffer.extent()
    tiles = [f"t{d}" for d in range(dims)]
    state, t = buffer, 0
    while t < steps:
        k = min(per, steps - t)
        halo = [k * reach] * dims
        df = tiled(state, halo, tile)
        look = Near(halo, tile, extent, border)
        for s in range(k):
            asked: dict[tuple[str, tuple[int, ...]], str] = {}

            def near(value: str, dim: int, offset: int, asked=asked, look=look) -> Column:
                tap = tuple(offset if d == dim else 0 for d in range(dims))
                found = {x: F.col(asked.setdefault((value, x), f"_{len(asked)}")) for x in look.offsets([tap])}
                return look.value(found, tap)

            new = step(near, t + s)
            df = df.select("*", *[look.fixed(F.col(v), x).alias(c) for (v, x), c in asked.items()])
            df = df.select(*buffer.keys, *tiles, "inner", *[new.get(v, F.col(v)).alias(v) for v in values])
        t += k
        out = df.where("inner").select(*buffer.keys, *values)
        state = buffer.with_df(cut(out) if t < steps else out)
    return state
