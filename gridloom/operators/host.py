"""Host tasks: functions of whole partitions, collectives, objects with ordered access, and snapshots in the background."""

from __future__ import annotations

import copy
import math
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Generic, TypeVar

import pandas as pd
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buffer import Buffer
from .mappers import even_bounds

T = TypeVar("T")
_BACKGROUND = ThreadPoolExecutor(max_workers=4, thread_name_prefix="fence")


@dataclass(frozen=True)
class Partition:
    """The run of the first dimension that a task has: ``offset`` up to ``offset + extent`` of ``size``."""

    index: int
    offset: int
    extent: int
    size: int


#: Cells of a run that a task gets, about, where the number of runs isn't given.
RUN_CELLS = 1_000_000


def partitioned(buffer: Buffer, parts: int | None, f: Callable[[Partition, pd.DataFrame], pd.DataFrame], schema: str, offset: Sequence[int] | None = None, extent: Sequence[int] | None = None) -> DataFrame:
    """Runs ``f(partition, cells)`` for ``parts`` even runs of the first dimension, of a box if ``extent`` is given.

    Each task gets its run's cells in order, as one frame; without ``parts``
    runs have about RUN_CELLS cells. Coordinates stay absolute, and the
    partition's offset is that of its first one.
    """
    first = offset[0] if offset else 0
    if extent is not None:
        buffer = buffer.box(offset or [0] * len(extent), extent)
    n, *inner = buffer.extent()
    parts = parts or max(1, -(-n * math.prod(inner) // RUN_CELLS))
    bounds = even_bounds(n, parts)
    from .splits import run_of

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf["_part"].iat[0])
        lo, hi = bounds[k]
        return f(Partition(k, first + lo, hi - lo, n), pdf.drop(columns="_part").sort_values(keys, ignore_index=True))

    keys = buffer.keys
    return buffer.df.withColumn("_part", run_of(F.col("i0") - first, n, parts)).groupBy("_part").applyInPandas(run, schema)


def each_item(buffer: Buffer, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Runs a function over batches of cells where they are: no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield f(pdf)

    return buffer.df.mapInPandas(run, schema)


def collective(df: DataFrame, f: Callable[[int, int, Iterator], Iterator], nodes: int) -> list:
    """Runs ``f(node, nodes, rows)`` at the same time on each of ``nodes`` tasks, which start together.

    All are there or none is: a lost executor restarts the stage. The results,
    which should be few, come to the driver in the order of nodes.
    """

    def run(rows: Iterator) -> Iterator:
        task = BarrierTaskContext.get()
        task.barrier()
        yield from f(task.partitionId(), len(task.getTaskInfos()), rows)

    return df.repartition(nodes).rdd.barrier().mapPartitions(run).collect()


@dataclass
class HostObject(Generic[T]):
    """State of the driver that host tasks see one after another, in the order they were submitted."""

    value: T | None = None
    log: list[str] = field(default_factory=list)

    def run(self, f: Callable[[T], object], name: str = "") -> object:
        self.log.append(name or getattr(f, "__name__", "task"))
        return f(self.value)

    def snapshot(self) -> T:
        """A copy that later tasks don't change."""
        return copy.deepcopy(self.value)


def once(f: Callable[[], T]) -> T:
    """A task that runs one time, on the driver."""
    return f()


def fence(of: Buffer | HostObject, offset=None, extent=None) -> Future:
    """A snapshot of a buffer's box (all, if None), made in the background; of a host object what it holds now."""
    if isinstance(of, HostObject):
        out: Future = Future()
        out.set_result(of.snapshot())
        return out
    return _BACKGROUND.submit(of.snapshot, offset, extent)


def windowed(buffer: Buffer, parts: int) -> DataFrame:
    """Each cell's place in the allocation of its run: ``part``, ``window_offset`` and ``linear`` inside it."""
    n, *inner = buffer.extent()
    width = 1
    for k in inner:
        width *= k
    from .splits import run_of

    starts = F.array(*[F.lit(a) for a, _ in even_bounds(n, parts)])
    out = buffer.df.withColumn("part", run_of("i0", n, parts)).withColumn("window_offset", F.get(starts, F.col("part").cast("int")).cast("long"))
    rest = F.lit(0).cast("long")
    for d, k in enumerate(inner, 1):
        rest = rest * k + F.col(f"i{d}")
    return out.withColumn("linear", (F.col("i0") - F.col("window_offset")) * width + rest)
