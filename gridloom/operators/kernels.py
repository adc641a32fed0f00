"""Kernels over buffers: maps, joins by access pattern, stencils, contractions, updates."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce as fold
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coordinates import div
from .buffer import Buffer

#: Cells of a side that may be broadcast.
BROADCAST_CELLS = 1_000_000
BORDERS = ("skip", "edge", "constant")


def parallel_for(buffer: Buffer, offset: Sequence[int] | None = None, extent: Sequence[int] | None = None, **values: Column) -> Buffer:
    """Values computed for each cell of a box (all, if None); coordinates stay absolute."""
    part = buffer.box(offset or [0] * len(extent), extent) if extent is not None else buffer
    return Buffer(part.df.select(*buffer.keys, *[c.alias(k) for k, c in values.items()]), buffer.shape, tuple(values))


def one_to_one(*buffers: Buffer) -> Buffer:
    """Cells with the values of all buffers: an equi-join on all coordinates."""
    first, *rest = buffers
    df = fold(lambda a, b: a.join(b.df, first.keys), rest, first.df)
    return Buffer(df, first.shape, tuple(v for b in buffers for v in b.values))


def _small(buffer: Buffer) -> DataFrame:
    """The cells, with a hint to broadcast them if their number is known and small."""
    n = None if None in buffer.shape else int(np.prod(buffer.shape, dtype=object)) if buffer.shape else 1
    return F.broadcast(buffer.df) if n is not None and n <= BROADCAST_CELLS else buffer.df


def with_scalar(buffer: Buffer, *scalars: Buffer) -> Buffer:
    """Every cell with the values of buffers of no dimensions."""
    if any(s.shape for s in scalars):
        raise ValueError("a scalar has no dimensions")
    return Buffer(fold(lambda a, s: a.crossJoin(F.broadcast(s.df)), scalars, buffer.df), buffer.shape, buffer.values + tuple(v for s in scalars for v in s.values))


def fold_fixed(buffer: Buffer, other: Buffer, value: Callable[[Column], Column], name: str = "v") -> Buffer:
    """Each cell with a value made from all cells of a fixed small buffer (or box of one).

    These cells (at most BROADCAST_CELLS; more raise) travel as one array of
    structs, sorted by coordinate, so that no pair of rows is ever made:
    ``value`` folds that array.
    """
    extent = other.extent()
    if int(np.prod(extent, dtype=object)) > BROADCAST_CELLS:
        raise ValueError(f"a fixed access of {extent} is too large to broadcast: join by coordinates instead")
    cells = other.df.agg(F.array_sort(F.collect_list(F.struct(*other.keys, *other.values))).alias("_cells"))
    df = buffer.df.crossJoin(F.broadcast(cells))
    return Buffer(df.select(*buffer.keys, *buffer.values, value(F.col("_cells")).alias(name)), buffer.shape, (*buffer.values, name))


def along(buffer: Buffer, vector: Buffer, dim: int, name: str = "w") -> Buffer:
    """Each cell with the value of a one-dimensional buffer at its coordinate ``dim``."""
    (v,) = vector.values
    side = _small(vector).withColumnsRenamed({"i0": f"i{dim}", v: name})
    return Buffer(buffer.df.join(side, f"i{dim}").select(*buffer.keys, *buffer.values, name), buffer.shape, (*buffer.values, name))


def gather(buffer: Buffer, index: str, source: Buffer, name: str = "w") -> Buffer:
    """Each cell with the value of a one-dimensional buffer at the coordinate in its column ``index``."""
    (v,) = source.values
    side = _small(source).withColumnsRenamed({"i0": index, v: name})
    return Buffer(buffer.df.join(side, index).select(*buffer.keys, *buffer.values, name), buffer.shape, (*buffer.values, name))


def transpose(buffer: Buffer) -> Buffer:
    """The mirrored cells of a two-dimensional buffer."""
    return Buffer(buffer.df.select(F.col("i1").alias("i0"), F.col("i0").alias("i1"), *buffer.values), buffer.shape[::-1], buffer.values)


def contract(a: Buffer, b: Buffer, a_dim: int = 1, b_dim: int = 0, name: str = "v") -> Buffer:
    """Sums of products over a common dimension (a matrix product by default), of arrays of any dimensions.

    The result has the other dimensions of ``a``, then those of ``b``, at most
    three. Cells meet by an equi-join on the common coordinate; products are
    summed before the shuffle by output cell. It suits outputs of moderate size,
    such as a Gram matrix of many rows; contract_tiled suits large square
    products.
    """
    mine, theirs = ([d for d in range(len(x.shape)) if d != common] for x, common in ((a, a_dim), (b, b_dim)))
    out = [f"i{n}" for n in range(len(mine) + len(theirs))]
    left = a.df.select(F.col(f"i{a_dim}").alias("k"), *[F.col(f"i{d}").alias(n) for d, n in zip(mine, out, strict=False)], F.col(a.values[0]).cast("double").alias("x"))
    right = b.df.select(F.col(f"i{b_dim}").alias("k"), *[F.col(f"i{d}").alias(n) for d, n in zip(theirs, out[len(mine) :], strict=True)], F.col(b.values[0]).cast("double").alias("y"))
    df = left.join(right, "k").groupBy(*out).agg(F.sum(F.col("x") * F.col("y")).alias(name))
    return Buffer(df, (*[a.shape[d] for d in mine], *[b.shape[d] for d in theirs]), (name,))


def _dense(i: pd.Series, j: pd.Series, v: pd.Series, height: int, width: int) -> np.ndarray:
    out = np.zeros((height, width))
    out[i.to_numpy(), j.to_numpy()] = v.to_numpy()
    return out


def _packed_tile(tile: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        block = _dense(pdf["i0"] % tile, pdf["i1"] % tile, pdf["v"], tile, tile)
        return pd.DataFrame({"t0": [pdf["t0"].iat[0]], "t1": [pdf["t1"].iat[0]], "block": [block.tobytes()]})

    return run


def contract_tiled(a: Buffer, b: Buffer, tile: int = 256) -> Buffer:
    """A matrix product by tiles: each pair of tiles is one matrix product in a task, and tiles are summed.

    What moves is tiles (a row each), not products of cells: about 2 n^3 / tile
    numbers instead of 2 n^3. Absent cells count as 0; cells of the result that
    are 0 are there too, where any tile product reaches them.
    """

    def tiles(x: Buffer) -> DataFrame:
        cells = x.df.select(div("i0", tile).alias("t0"), div("i1", tile).alias("t1"), "i0", "i1", F.col(x.values[0]).cast("double").alias("v"))
        return cells.groupBy("t0", "t1").applyInPandas(_packed_tile(tile), "t0 long, t1 long, block binary")

    def multiplied(batches):
        for pdf in batches:
            out = []
            for x, y in zip(pdf["x"], pdf["y"], strict=True):
                out.append((np.frombuffer(x).reshape(tile, tile) @ np.frombuffer(y).reshape(tile, tile)).tobytes())
            yield pdf[["t0", "t1"]].assign(block=out)

    def summed(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x) for x in pdf["block"]).reshape(tile, tile)
        i, j = np.indices((tile, tile)).reshape(2, -1)
        return pd.DataFrame({"i0": pdf["t0"].iat[0] * tile + i, "i1": pdf["t1"].iat[0] * tile + j, "v": total.ravel()})

    left = tiles(a).select("t0", F.col("t1").alias("k"), F.col("block").alias("x"))
    right = tiles(b).select(F.col("t0").alias("k"), "t1", F.col("block").alias("y"))
    parts = left.join(right, "k").select("t0", "t1", "x", "y").mapInPandas(multiplied, "t0 long, t1 long, block binary")
    df = parts.groupBy("t0", "t1").applyInPandas(summed, "i0 long, i1 long, v double")
    n, m = a.extent()[0], b.extent()[1]
    return Buffer(df.where((F.col("i0") < n) & (F.col("i1") < m)), (n, m))


def tile_of_dims(dims: int) -> tuple[int, ...]:
    """The usual extents of a tile."""
    return {1: (16_384,), 2: (128, 128), 3: (32, 32, 16)}[dims]


def _halo(c: str, size: int, halo: int) -> Column:
    """The tiles whose area, grown by the halo, holds a coordinate: its own, and near an edge a neighbour's."""
    own = div(c, size)
    at = F.col(c) - own * size
    tiles = [own, F.when((at < halo) & (own > 0), own - 1), F.when(at >= size - halo, own + 1)]
    return F.filter(F.array(*tiles), lambda x: x.isNotNull())


def tiled(buffer: Buffer, halo: Sequence[int], tile: Sequence[int] | None = None) -> DataFrame:
    """Cells with the tile they belong to, ``t0`` …; cells near an edge also for the neighbour, with ``inner`` false.

    A tile then has all that a stencil of this reach needs. One shuffle by tile
    serves any number of lookups inside tiles, and no task holds more of a line
    of the array than a tile has.
    """
    tile = tuple(tile or tile_of_dims(len(halo)))[: len(halo)]
    for h, n in zip(halo, tile, strict=True):
        if 2 * h > n:
            raise ValueError(f"a halo of {h} needs tiles of {2 * h} at least")
    df, inner = buffer.df, F.lit(True)
    for d, (h, n) in enumerate(zip(halo, tile, strict=True)):
        df = df.withColumn(f"t{d}", F.explode(_halo(f"i{d}", n, h)) if h else div(f"i{d}", n))
        inner = inner & (div(f"i{d}", n) == F.col(f"t{d}"))
    return df.withColumn("inner", inner).repartition(*[f"t{d}" for d in range(len(halo))])


class Near:
    """Lookups of other cells by their coordinates, inside tiled() rows.

    All cells of a tile are ordered by one number made of their coordinates, so
    that a neighbour is a range frame of one value: absent cells are absent, and
    null cells null, whatever stands around them. ``there`` tells the two apart.
    """

    def __init__(self, halo: Sequence[int], tile: Sequence[int] | None, extent: Sequence[int], border: str = "skip", constant: object = 0.0):
        if border not in BORDERS:
            raise ValueError(f"border is one of {BORDERS}")
        self.dims, self.extent, self.border, self.constant = len(halo), extent, border, constant
        tile = tuple(tile or tile_of_dims(self.dims))[: self.dims]
        self.stride, at = [0] * self.dims, F.lit(0).cast("long")
        step = 1
        for d in reversed(range(self.dims)):
            self.stride[d] = step
            at = at + (F.col(f"i{d}") - F.col(f"t{d}") * tile[d] + halo[d]) * step
            step *= tile[d] + 4 * halo[d] + 1  # wide enough that no lookup reaches the next line
        self.window = Window.partitionBy(*[f"t{d}" for d in range(self.dims)]).orderBy(at)

    def fixed(self, value: Column, steps: Sequence[int]) -> Column:
        """A struct with the value of the cell ``steps`` further, null if it isn't there."""
        k = sum(n * m for n, m in zip(steps, self.stride, strict=True))
        return F.first(F.struct(value.alias("v"))).over(self.window.rangeBetween(k, k))

    def offsets(self, taps: Sequence[Sequence[int]]) -> list[tuple[int, ...]]:
        """The fixed offsets that taps need: with ``edge`` also all between them and the cell itself."""
        if self.border != "edge":
            return sorted({tuple(t) for t in taps})
        return sorted({x for t in taps for x in product(*[range(min(0, n), max(0, n) + 1) for n in t])})

    def value(self, found: dict[tuple[int, ...], Column], tap: Sequence[int]) -> Column:
        """The tap's value by the border's rule, from the structs at the fixed offsets.

        Of a cell that isn't there it is null (``skip``) or the constant; beyond
        the array that of the nearest cell (``edge``), null if that is absent.
        """
        if self.border == "edge":
            chosen = F
            for x in self.offsets([tap]):
                inside = fold(lambda a, b: a & b, [self._clamped(d, n, k) for d, (n, k) in enumerate(zip(tap, x, strict=True))])
                chosen = chosen.when(inside, found[x]["v"])
            return chosen
        at = found[tuple(tap)]
        return F.when(at.isNull(), F.lit(self.constant)).otherwise(at["v"]) if self.border == "constant" else at["v"]

    def _clamped(self, d: int, n: int, k: int) -> Column:
        """Whether ``n`` steps along a dimension, stopped at the array's border, are ``k``."""
        i, last = F.col(f"i{d}"), self.extent[d] - 1
        if k == n:
            return (i + n >= 0) & (i + n <= last)
        return (i + k == 0) if n < 0 else (i + k == last)


def stencil(buffer: Buffer, taps: Sequence[Sequence[int]], combine: Callable[[dict[tuple[int, ...], Column]], Column], border: str = "skip", constant: object = 0.0, name: str = "v", tile: Sequence[int] | None = None) -> Buffer:
    """A value from each cell's neighbours at fixed offsets, in one to three dimensions: ``combine`` gets a column for each of ``taps``.

    Neighbours are found by coordinate (see Near): cells that aren't there count
    as beyond the array, null cells are null. One shuffle, of each cell once
    (and a halo), and one sort inside tiles.
    """
    (v,) = buffer.values
    dims = len(buffer.keys)
    halo = [max(abs(t[d]) for t in taps) for d in range(dims)]
    near = Near(halo, tile, buffer.extent() if border == "edge" else (), border, constant)
    df = tiled(buffer, halo, tile)
    offsets = near.offsets(taps)
    df = df.select("*", *[near.fixed(F.col(v), x).alias(f"_n{k}") for k, x in enumerate(offsets)])
    found = {x: F.col(f"_n{k}") for k, x in enumerate(offsets)}
    out = combine({tuple(t): near.value(found, t) for t in taps})
    return Buffer(df.where("inner").select(*buffer.keys, out.alias(name)), buffer.shape, (name,))


def _in_tiles(buffer: Buffer, low: Sequence[int], high: Sequence[int], border: str, constant: float, name: str, tile: Sequence[int] | None, f: Callable[[np.ndarray, tuple[np.ndarray, ...]], np.ndarray]) -> Buffer:
    """Values of each tile's cells from an array of the tile and its halo: ``f(array, places)``.

    Absent cells and, with ``skip``, those beyond the array are 0 in it (the
    constant with ``constant``); null cells are not a number, and so is what they
    reach, which comes back as null.
    """
    if border not in BORDERS:
        raise ValueError(f"border is one of {BORDERS}")
    (v,) = buffer.values
    keys, dims = buffer.keys, len(buffer.keys)
    extent = buffer.extent() if border == "edge" else None
    size = tuple(tile or tile_of_dims(dims))[:dims]
    empty = constant if border == "constant" else 0.0

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        inner = pdf[pdf["inner"]]
        if inner.empty:
            return pd.DataFrame({k: pd.Series(dtype="int64") for k in keys} | {name: pd.Series(dtype="float64")})
        corner = [int(pdf[f"t{d}"].iat[0]) * size[d] - low[d] for d in range(dims)]
        have = np.full([n + a + b for n, a, b in zip(size, low, high, strict=True)], float(empty))
        at = [pdf[k].to_numpy() - c for k, c in zip(keys, corner, strict=True)]
        ok = np.logical_and.reduce([(x >= 0) & (x < n) for x, n in zip(at, have.shape, strict=True)])
        have[tuple(x[ok] for x in at)] = pdf["v"].to_numpy(float)[ok]
        if extent:
            for d in range(dims):  # beyond the array: the nearest cell in it
                have = have.take(np.clip(np.arange(have.shape[d]), -corner[d], extent[d] - 1 - corner[d]), axis=d)
        places = tuple(inner[k].to_numpy() - c for k, c in zip(keys, corner, strict=True))
        return pd.DataFrame({k: inner[k].to_numpy() for k in keys} | {name: f(have, places)})

    cells = buffer.with_df(buffer.df.select(*keys, F.col(v).cast("double").alias("v")), ("v",))
    df = tiled(cells, [max(x) for x in zip(low, high, strict=True)], size)
    kinds = ", ".join(f"{k} long" for k in keys)
    return Buffer(df.groupBy(*[f"t{d}" for d in range(dims)]).applyInPandas(run, f"{kinds}, {name} double"), buffer.shape, (name,))


def separable(buffer: Buffer, weights: Sequence[Sequence[float]], first: Sequence[int], border: str = "constant", name: str = "v", tile: Sequence[int] | None = None) -> Buffer:
    """A weighted sum over a box whose weights are products of one list for each dimension.

    ``first`` is the offset of each list's first weight. Each tile, with its
    halo, is one array in a task, summed along one dimension after another.
    """
    low = [max(0, -f) for f in first]
    high = [max(0, f + len(w) - 1) for f, w in zip(first, weights, strict=True)]

    def run(have: np.ndarray, places: tuple[np.ndarray, ...]) -> np.ndarray:
        for d, (w, f) in enumerate(zip(weights, first, strict=True)):
            out = np.zeros_like(have)
            for k, x in enumerate(w, f):
                here, there = [slice(None)] * have.ndim, [slice(None)] * have.ndim
                n = have.shape[d]
                here[d], there[d] = slice(max(0, -k), n - max(0, k)), slice(max(0, k), n - max(0, -k))
                out[tuple(here)] += x * have[tuple(there)]
            have = out
        return have[places]

    return _in_tiles(buffer, low, high, border, 0.0, name, tile, run)


def dense_stencil(buffer: Buffer, weights: np.ndarray, first: Sequence[int], border: str = "constant", constant: float = 0.0, name: str = "v", tile: Sequence[int] | None = None) -> Buffer:
    """A weighted sum over a box of any weights, in arrays: for boxes too large for a window expression a cell.

    ``first`` is the offset of the first weight. Each tile, with its halo, is one
    array in a task.
    """
    weights = np.asarray(weights, float)
    low = [max(0, -f) for f in first]
    high = [max(0, f + n - 1) for f, n in zip(first, weights.shape, strict=True)]

    def run(have: np.ndarray, places: tuple[np.ndarray, ...]) -> np.ndarray:
        out = np.zeros(len(places[0]))
        for x in np.argwhere(weights):
            out += weights[tuple(x)] * have[tuple(p + f + k for p, f, k in zip(places, first, x, strict=True))]
        return out

    return _in_tiles(buffer, low, high, border, constant, name, tile, run)


def update(current: Buffer, written: Buffer) -> Buffer:
    """A write that keeps the cells it doesn't reach: written cells replace current ones, new ones are added."""
    mine = written.df.select(*current.keys, *[F.col(v).alias(f"_{v}") for v in written.values], F.lit(True).alias("_hit"))
    both = current.df.join(mine, current.keys, "full_outer")
    return current.with_df(both.select(*current.keys, *[F.when(F.col("_hit"), F.col(f"_{v}")).otherwise(F.col(v)).alias(v) for v in current.values]))


def discard_write(current: Buffer, written: Buffer, offset: Sequence[int], extent: Sequence[int]) -> Buffer:
    """A write that discards what its box held: cells of the box that it doesn't write are no longer there."""
    inside = fold(lambda a, b: a & b, [(F.col(k) >= o) & (F.col(k) < o + n) for k, o, n in zip(current.keys, offset, extent, strict=True)])
    return current.with_df(current.df.where(~inside).unionByName(written.box(offset, extent).df.select(*current.keys, *current.values)))


def scan(df: DataFrame, order: str, value: str, name: str = "scan", by: Sequence[str] = (), inclusive: bool = True, block: int = 65_536) -> DataFrame:
    """Running sums of ``value`` along a whole dense coordinate, within each ``by``.

    Two levels: sums inside blocks of the coordinate, and of the blocks before.
    No task holds more than a block, and the second level goes on in blocks of
    blocks while there are more than one.
    """
    df = df.withColumn("_b", div(order, block))
    inside = Window.partitionBy(*by, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    totals = df.groupBy(*by, "_b").agg(F.sum(value).alias("_t"))
    if (totals.agg(F.max("_b")).first()[0] or 0) >= block:
        upper = totals.withColumnsRenamed({"_b": "_at", "_t": "_each"})
        before = scan(upper, "_at", "_each", "_prev", by, False, block).select(*by, F.col("_at").alias("_b"), F.col("_prev").alias("_before"))
    else:
        earlier = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        before = totals.select(*by, "_b", F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_before"))
    out = df.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(before, [*by, "_b"])
    return out.withColumn(name, F.col("_in") + F.col("_before")).drop("_b", "_in", "_before")


def growing_mean(rows: DataFrame, order: str, value: str, name: str = "v", by: Sequence[str] = (), block: int = 65_536) -> DataFrame:
    """The mean of all earlier cells along a coordinate (null at the first): of those that are there and not null."""
    out = scan(rows, order, value, "_sum", by, inclusive=False, block=block)
    out = scan(out.withColumn("_one", F.when(F.col(value).isNotNull(), 1).otherwise(0)), order, "_one", "_n", by, inclusive=False, block=block)
    return out.withColumn(name, F.when(F.col("_n") > 0, F.col("_sum") / F.col("_n"))).drop("_sum", "_n", "_one")
