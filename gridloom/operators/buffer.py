"""Dense arrays as relations: one row for each cell, keyed by its coordinates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.coordinates import from_linear, keys


@dataclass(frozen=True)
class Buffer:
    """A virtual array of ``len(shape)`` dimensions: ``df`` has i0, i1, … (long) and the value columns.

    Immutable: a kernel gives another buffer. Cells that were never written are
    rows that aren't there, not nulls. A shape entry is None where it isn't
    known; ``extent`` then asks the data.
    """

    df: DataFrame
    shape: tuple[int | None, ...]
    values: tuple[str, ...] = ("v",)

    def __post_init__(self):
        if len(self.shape) > 3:
            raise ValueError("a buffer has at most 3 dimensions")

    @property
    def keys(self) -> list[str]:
        return keys(len(self.shape))

    def with_df(self, df: DataFrame, values: Sequence[str] | None = None) -> Buffer:
        return replace(self, df=df, values=tuple(values or self.values))

    def extent(self) -> tuple[int, ...]:
        """The shape; unknown entries are the largest coordinate plus one."""
        if None not in self.shape:
            return self.shape
        row = self.df.agg(*[F.max(k).alias(k) for k in self.keys]).first()
        return tuple((row[k] + 1 if row[k] is not None else 0) if n is None else n for n, k in zip(self.shape, self.keys, strict=True))

    def box(self, offset: Sequence[int], extent: Sequence[int], rebase: bool = False) -> Buffer:
        """The cells of a box, as a filter that reaches the scan; with ``rebase`` counted from its corner."""
        df = self.df
        for k, o, n in zip(self.keys, offset, extent, strict=True):
            df = df.where((F.col(k) >= o) & (F.col(k) < o + n))
        if rebase:
            df = df.withColumns({k: F.col(k) - o for k, o in zip(self.keys, offset, strict=True)})
        return replace(self, df=df, shape=tuple(extent))

    def check_dense(self) -> None:
        """Raises if a cell of the shape is absent or there twice."""
        n = int(np.prod(self.extent(), dtype=object)) if self.shape else 1
        row = self.df.agg(F.count("*").alias("n"), *[F.min(k).alias(k) for k in self.keys]).first()
        twice = bool(self.shape) and not self.df.groupBy(*self.keys).count().where("count > 1").isEmpty()
        if row["n"] != n or any(row[k] != 0 for k in self.keys if n) or twice:
            raise ValueError(f"not dense: {row['n']} rows for {n} cells")

    def snapshot(self, offset: Sequence[int] | None = None, extent: Sequence[int] | None = None, most: int = 50_000_000) -> np.ndarray:
        """A copy of a box (all, if None) on the driver, indexed from the box' corner.

        It is for results that fit the driver: over ``most`` cells it raises.
        """
        extent = tuple(extent if extent is not None else self.extent())
        if int(np.prod(extent, dtype=object)) > most:
            raise ValueError(f"a snapshot of {extent} is over {most} cells: write the buffer instead")
        part = self.box(offset or [0] * len(extent), extent, rebase=True)
        pdf = part.df.select(*self.keys, *self.values).toPandas()
        if not extent:
            return np.array(pdf[self.values[0]].iat[0])
        if len(self.values) == 1:
            out = np.zeros(extent, dtype=pdf[self.values[0]].dtype)
            out[tuple(pdf[k] for k in self.keys)] = pdf[self.values[0]]
            return out
        out = np.zeros(extent, dtype=[(v, pdf[v].dtype) for v in self.values])
        for v in self.values:
            out[v][tuple(pdf[k] for k in self.keys)] = pdf[v]
        return out


def from_columns(df: DataFrame, key: Sequence[str], shape: Sequence[int | None] | None = None, **values: Column | str) -> Buffer:
    """A buffer of a table that has its coordinates as columns."""
    cols = [F.col(k).cast("long").alias(f"i{d}") for d, k in enumerate(key)]
    vals = [(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in values.items()]
    return Buffer(df.select(*cols, *vals), tuple(shape) if shape else (None,) * len(key), tuple(values))


def from_arrays(df: DataFrame, key: str, array: str, width: int | None = None) -> Buffer:
    """A two-dimensional buffer of a table whose rows hold arrays."""
    cells = df.select(F.col(key).cast("long").alias("i0"), F.posexplode(F.col(array)).alias("i1", "v"))
    return Buffer(cells.select("i0", F.col("i1").cast("long").alias("i1"), "v"), (None, width))


def index_space(spark: SparkSession, shape: Sequence[int], **values: Column) -> Buffer:
    """All cells of a shape, with values computed from the coordinates."""
    n = int(np.prod(shape, dtype=object))
    ids = from_linear(F.col("id"), list(shape)) if shape else []
    df = spark.range(n).select(*[c.alias(f"i{d}") for d, c in enumerate(ids)], *([] if shape else ["id"]))
    df = df.select("*", *[c.alias(k) for k, c in values.items()])
    return Buffer(df if shape else df.drop("id"), tuple(shape), tuple(values))


def from_host(spark: SparkSession, array: np.ndarray, most: int = 50_000_000) -> Buffer:
    """A buffer of an array in the driver's memory (of at most ``most`` cells)."""
    if array.size > most:
        raise ValueError("the array is too large to send from the driver: write it to Parquet and read that")
    at = np.indices(array.shape).reshape(array.ndim, -1)
    pdf = pd.DataFrame({f"i{d}": at[d].astype(np.int64) for d in range(array.ndim)} | {"v": array.ravel()})
    return Buffer(spark.createDataFrame(pdf), array.shape)


def scalar(spark: SparkSession, value: object, kind: str | None = None) -> Buffer:
    """A buffer of no dimensions: exactly one row."""
    c = F.lit(value)
    return Buffer(spark.range(1).select((c.cast(kind) if kind else c).alias("v")), ())
