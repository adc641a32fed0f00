"""A queue of command groups over buffers: laziness by default, and ways to make it eager."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession

from ..operators.buffer import Buffer
from ..operators.host import HostObject, collective, fence
from .loops import cut

LOOKAHEADS = ("none", "automatic", "infinite")


def session(cores: str = "local[*]", partitions: int | None = None, **settings: str) -> SparkSession:
    """A session with what the operators expect: adaptive plans with skew handling, UTC, and Arrow transfer."""
    conf = {
        "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.sql.session.timeZone": "UTC",
    }
    conf |= {"spark.sql.shuffle.partitions": str(partitions)} if partitions else {}
    return SparkSession.builder.master(cores).config(map=conf | settings).getOrCreate()


class Queue:
    """Names buffers, and runs command groups that give new versions of them.

    ``submit`` only extends a buffer's plan. With the lookahead ``infinite``
    nothing runs before ``flush`` or ``wait``; with ``none`` each result is made
    at once; with ``automatic`` a buffer's plan is cut after ``horizon``
    versions, so that long programs keep small plans. Plans are cut by a
    checkpoint in the shared folder, which survives lost executors.
    """

    def __init__(self, lookahead: str = "automatic", horizon: int = 16):
        self.set_lookahead(lookahead)
        self.horizon = horizon
        self.buffers: dict[str, Buffer] = {}
        self.log: list[str] = []
        self._age: dict[str, int] = {}

    def set_lookahead(self, lookahead: str) -> None:
        if lookahead not in LOOKAHEADS:
            raise ValueError(f"a lookahead is one of {LOOKAHEADS}")
        self.lookahead = lookahead

    def bind(self, name: str, buffer: Buffer) -> Buffer:
        self.buffers[name], self._age[name] = buffer, 0
        return buffer

    def submit(self, name: str, writes: str, f: Callable[..., Buffer], *reads: str) -> Buffer:
        """``writes`` becomes ``f(its reads…)``; a task's name describes the jobs that it starts."""
        new = f(*[self.buffers[r] for r in reads])
        self.log.append(name)
        age = self._age.get(writes, 0) + 1
        if self.lookahead == "none" or (self.lookahead == "automatic" and age >= self.horizon):
            new, age = self._cut(name, new), 0
        self.buffers[writes], self._age[writes] = new, age
        return new

    def _cut(self, name: str, buffer: Buffer) -> Buffer:
        sc = buffer.df.sparkSession.sparkContext
        sc.setJobDescription(name)
        try:
            return buffer.with_df(cut(buffer.df))
        finally:
            sc.setJobDescription(None)

    def swap(self, a: str, b: str) -> None:
        """Two buffers change names; no data moves."""
        self.buffers[a], self.buffers[b] = self.buffers[b], self.buffers[a]
        self._age[a], self._age[b] = self._age[b], self._age[a]

    def flush(self) -> None:
        """Makes all that was submitted."""
        for name, age in list(self._age.items()):
            if age:
                self.buffers[name], self._age[name] = self._cut(f"flush {name}", self.buffers[name]), 0

    def wait(self, barrier: bool = False) -> None:
        """Returns when all that was submitted is made; with ``barrier`` when all executors' task slots have met as well."""
        self.flush()
        if barrier and self.buffers:
            df = next(iter(self.buffers.values())).df
            collective(df.limit(0), lambda node, nodes, rows: iter(()), max(1, df.sparkSession.sparkContext.defaultParallelism))

    def fence(self, of: str | HostObject, offset=None, extent=None):
        """A snapshot in the background of a buffer's present version, or a copy of a host object's value after the tasks before."""
        return fence(of if isinstance(of, HostObject) else self.buffers[of], offset, extent)

    def named(self, name: str) -> Buffer:
        """The present version of a buffer; its plan bears the name."""
        b = self.buffers[name]
        return b.with_df(b.df.alias(name))

    def host_task(self, name: str, state: HostObject, f: Callable) -> object:
        """A task on the driver, after those before it that saw the same object."""
        self.log.append(name)
        return state.run(f, name)
