"""Near-duplicate embeddings: int8 tile products with error bounds, exact where they leave a doubt."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, components, stored

#: Vectors in a tile.
TILE = 1024
#: Vectors around which others gather, at most, of all labels.
PIVOTS = 4096


def usable(v: Column) -> Column:
    """Whether an array has components, and all are there and finite."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & ~bad, F.lit(False))


def quantise(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Int8 codes of unit vectors, a scale for each, and the exact length of what the code leaves out."""
    scale = np.abs(u).max(axis=1, keepdims=True) / 127
    q = np.rint(u / scale).astype(np.int8)
    left = np.sqrt(((u - scale * q) ** 2).sum(axis=1))
    return q, scale[:, 0], left + 1e-12


@dataclass
class Codes:
    """Int8 codes of a tile's unit vectors, their scales, and the lengths of what they leave out."""

    q: np.ndarray
    scale: np.ndarray
    left: np.ndarray

    @classmethod
    def of(cls, v: np.ndarray) -> Codes:
        return cls(*quantise(v / np.sqrt((v * v).sum(axis=1))[:, None]))


def open_pairs(a: Codes, b: Codes, least: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i of a, j of b) whose cosine may be ``least`` or more; i < j if ``same``.

    With codes p, q, scales s, t and remainders d, e, the cosine differs from
    s t (p . q) by at most d + e + d e: pairs below ``least`` even so are left.
    """
    kind = np.float32 if a.q.shape[1] * 127 * 127 < 1 << 24 else np.float64  # the products of codes are exact
    about = (a.q.astype(kind) @ b.q.astype(kind).T).astype(np.float64) * a.scale[:, None] * b.scale[None, :]
    slack = a.left[:, None] + b.left[None, :] + a.left[:, None] * b.left[None, :] + 1e-9
    i, j = np.nonzero(about + slack >= least)
    return (i[i < j], j[i < j]) if same else (i, j)


def tile_links(a: np.ndarray, b: np.ndarray, least: float, same: bool, codes: tuple[Codes, Codes] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i of a, j of b) whose cosine in double precision is at least ``least``: open pairs, computed in full."""
    i, j = open_pairs(*(codes or (Codes.of(a), Codes.of(b))), least, same)
    na, nb = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
    keep = np.empty(len(i), dtype=bool)
    for at in range(0, len(i), 50_000):
        x, y = i[at : at + 50_000], j[at : at + 50_000]
        keep[at : at + 50_000] = np.einsum("ij,ij->i", a[x], b[y]) / (na[x] * nb[y]) >= least
    return i[keep], j[keep]


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches over the edges."""
    r = np.arange(n)
    while len(i):
        low = np.minimum(r[i], r[j])
        before = r.copy()
        np.minimum.at(r, i, low)
        np.minimum.at(r, j, low)
        r = r[r]
        if (r == before).all():
            break
    return r


def _pack(double: bool):
    """A tile as one row: ids, copies, codes with their bounds, and the vectors themselves."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep")
        v = np.stack(pdf["v"].to_numpy()).astype(np.float64 if double else np.float32)
        if double:  # by a power of two, which changes no digit: squares then neither overflow nor vanish
            v = np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1])
        c, first = Codes.of(v.astype(np.float64)), pdf.iloc[0]
        cols = {"ids": pdf["rep"].to_numpy(np.int64), "copies": pdf["copies"].to_numpy(np.int64), "q": c.q, "scale": c.scale, "left": c.left, "vectors": v}
        return pd.DataFrame({k: [first[k]] for k in ("label", "dim", "cell", "tile")} | {k: [x.tobytes()] for k, x in cols.items()})

    return run


def _codes(r: dict, side: str) -> Codes:
    scale = np.frombuffer(r["scale" + side])
    return Codes(np.frombuffer(r["q" + side], np.int8).reshape(len(scale), -1), scale, np.frombuffer(r["left" + side]))


def _doubtful(least: float):
    """Of pairs of tiles, by their codes alone, those that have open pairs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            some = [len(open_pairs(_codes(r, "1"), _codes(r, "2"), least, r["tile1"] == r["tile2"])[0]) > 0 for r in pdf.to_dict("records")]
            yield pdf.loc[some, ["label", "dim", "tile1", "tile2"]]

    return run


def _solve(least: float, double: bool):
    """The links of pairs of tiles: a row for each linked class, with its links and a root."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.to_dict("records"):
                same = r["tile1"] == r["tile2"]
                (ia, ca, a), (ib, cb, b) = ((np.frombuffer(r["ids" + x], np.int64), np.frombuffer(r["copies" + x], np.int64), np.frombuffer(r["vectors" + x], np.float64 if double else np.float32)) for x in "12")
                a, b = (v.reshape(n, -1).astype(np.float64) for v, n in ((a, len(ia)), (b, len(ib))))
                i, j = tile_links(a, b, least, same, (_codes(r, "1"), _codes(r, "2")))
                at = 0 if same else len(ia)
                ids, n = (ia, len(ia)) if same else (np.concatenate([ia, ib]), len(ia) + len(ib))
                links = np.bincount(i, weights=cb[j], minlength=n) + np.bincount(j + at, weights=ca[i], minlength=n)
                root, has = roots(n, i, j + at), links > 0
                yield pd.DataFrame({"rep": ids[has], "links": links[has].astype(np.int64), "root": ids[root[has]]})

    return run


def far_apart(centres: np.ndarray, reach: np.ndarray, least: float) -> np.ndarray:
    """Which two cells can have no link: a matrix of booleans.

    Angles obey the triangle inequality: two vectors within ``reach`` of their
    centres are at least as far apart as the centres less both.
    """
    between = np.arccos(np.clip(centres @ centres.T, -1, 1))
    return between - reach[:, None] - reach[None, :] > np.arccos(least) + 1e-6


def _cells(classes: DataFrame, least: float, tile: int) -> tuple[DataFrame, DataFrame]:
    """``classes`` with a ``cell``, and (label, dim, cell1, cell2) of the cells that can have links with one another.

    In labels of several tiles the cells are those of pivots (a class by its
    direction), at most PIVOTS in all: beyond, and in small labels, a label is
    one cell. It only says how vectors are gathered.
    """
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("n"))
    large = sizes.where(F.col("n") > tile).orderBy(F.desc("n"), "label", "dim").limit(PIVOTS // 2).collect()
    share = {(r.label, r.dim): min(-(-r.n // tile), 64) for r in large}
    while sum(share.values()) > PIVOTS:
        share = {k: max(1, n // 2) for k, n in share.items()}
    spark = classes.sparkSession
    kind = classes.schema["label"].dataType.simpleString()
    if not share:
        one = classes.withColumn("cell", F.lit(0))
        return one, sizes.select("label", "dim", F.lit(0).alias("cell1"), F.lit(0).alias("cell2"))
    chosen = spark.createDataFrame([(*k, n) for k, n in share.items()], f"label {kind}, dim int, many int")
    w = Window.partitionBy("label", "dim").orderBy(F.xxhash64(F.lit(3), "rep"), "rep")
    picked = classes.join(F.broadcast(chosen), ["label", "dim"]).withColumn("k", F.row_number().over(w)).where("k <= many").select("label", "dim", "v").collect()
    pivots: dict[tuple, list] = {}
    for r in picked:
        pivots.setdefault((r.label, r.dim), []).append(r.v)
    pivots = {k: (x := np.array(v, dtype=float)) / np.linalg.norm(x, axis=1, keepdims=True) for k, v in pivots.items()}

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cell, angle = np.zeros(len(pdf), np.int32), np.zeros(len(pdf))
            for key, at in pdf.groupby(["label", "dim"]).indices.items():
                p = pivots.get((key[0].item() if hasattr(key[0], "item") else key[0], int(key[1])))
                if p is not None:
                    x = np.stack(pdf["v"].iloc[at].to_numpy()).astype(float)
                    cos = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ p.T
                    cell[at] = cos.argmax(axis=1)
                    angle[at] = np.arccos(np.clip(cos.max(axis=1), -1, 1))
            yield pdf.assign(cell=cell, angle=angle)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema.fields)
    out = stored(classes.mapInPandas(placed, f"{fields}, cell int, angle double"), "cells")
    reach: dict[tuple, dict[int, float]] = {}
    for r in out.join(F.broadcast(chosen.drop("many")), ["label", "dim"], "left_semi").groupBy("label", "dim", "cell").agg(F.max("angle").alias("angle")).collect():
        reach.setdefault((r.label, r.dim), {})[r.cell] = r.angle
    near = []
    for key, p in pivots.items():
        used = sorted(reach[key])
        apart = far_apart(p[used], np.array([reach[key][c] for c in used]), least)
        near += [(*key, used[i], used[j]) for i in range(len(used)) for j in range(len(used)) if not apart[i, j]]
    rest = sizes.join(F.broadcast(chosen), ["label", "dim"], "left_anti").select("label", "dim", F.lit(0).alias("cell1"), F.lit(0).alias("cell2"))
    return out.drop("angle"), spark.createDataFrame(near, f"label {kind}, dim int, cell1 int, cell2 int").unionByName(rest)


def link_embeddings(vectors: DataFrame, least: float = 0.93, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", tile: int = TILE) -> DataFrame:
    """n_links, component_id and kept of each vector.

    Vectors of one label (not null) and length are linked by a cosine of at
    least ``least`` in double precision, of floats or doubles as they are.
    Vectors that are null, empty or zero, or hold null or non-finite components,
    link with nothing: 0 links, a component of their own. A null id takes no
    part: 0 links, a null component, not kept. An id is one vector: of several
    usable rows with one id the smallest (label, vector) counts, and rows that
    repeat one count once. Other columns are not read; an empty table gives no
    rows.

    Equal vectors are one class, so copies are never expanded. Classes are
    gathered around pivots into tiles of about ``tile`` within their label.
    Tiles are quantised once. Tiles whose cells can have a link (by the angles
    of their pivots and reaches) meet in a task twice: as int8 codes, compared
    by one matrix product; and in full, only where the error bounds leave pairs
    open, of which just these are computed again. A task returns a row for each
    linked class (its links and a root), never the pairs.
    """
    bounded_batches(vectors.sparkSession, 8 << 20)
    double = not vectors.schema[embedding].dataType.simpleString() == "array<float>"
    cols = [F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>" if double else "array<float>").alias("v"), F.col(label).alias("label")]
    rows = vectors.select(*cols)
    fit = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v")) & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    good = rows.where(fit).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("s")).select("vec_id", "s.label", "s.v")
    good = stored(good.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")}), "vectors")
    # Classes by 128 bits of the vector; the vector itself travels once for each.
    alike = good.groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    member = stored(good.select("vec_id", "label", "h1", "h2").join(alike, ["label", "h1", "h2"]).select("vec_id", "rep", "copies"), "members")
    classes = stored(good.join(alike.select(F.col("rep").alias("vec_id"), "copies"), "vec_id").select(F.col("vec_id").alias("rep"), "label", F.size("v").alias("dim"), "v", "copies"), "classes")
    placed, near = _cells(classes, least, tile)
    sizes = placed.groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    dealt = placed.join(sizes, ["label", "dim", "cell"]).withColumn("tile", F.concat_ws("-", "cell", F.pmod(F.xxhash64("rep"), "tiles")))
    kind = classes.schema["label"].dataType.simpleString()
    packed = stored(dealt.groupBy("label", "dim", "cell", "tile").applyInPandas(_pack(double), f"label {kind}, dim int, cell int, tile string, ids binary, copies binary, q binary, scale binary, left binary, vectors binary"), "tiles")

    def side(k: str, *columns: str) -> DataFrame:
        return packed.select("label", "dim", *[F.col(c).alias(c + k) for c in columns])

    meet = side("1", "cell", "tile").join(near, ["label", "dim", "cell1"]).join(side("2", "cell", "tile"), ["label", "dim", "cell2"]).where("tile1 <= tile2").select("label", "dim", "tile1", "tile2")

    def both(pairs: DataFrame, *columns: str) -> DataFrame:
        out = pairs.join(side("1", "tile", *columns), ["label", "dim", "tile1"]).join(side("2", "tile", *columns), ["label", "dim", "tile2"])
        return out.repartition("label", "dim", "tile1", "tile2")

    pairs = stored(both(meet, "q", "scale", "left").mapInPandas(_doubtful(least), f"label {kind}, dim int, tile1 string, tile2 string"), "open")
    found = stored(both(pairs, "q", "scale", "left", "ids", "copies", "vectors").drop("label", "dim").mapInPandas(_solve(least, double), "rep long, links long, root long"), "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    per = classes.select("rep").join(links, "rep", "left").join(comp, F.col("rep") == F.col("node"), "left").select("rep", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "rep").alias("component"))
    linked = member.join(per, "rep").select("vec_id", (F.col("links") + F.col("copies") - 1).cast("long").alias("n_links"), F.col("component").alias("component_id"))
    others = rows.where(~fit).select("vec_id").distinct().join(member.select("vec_id"), "vec_id", "left_anti")
    alone = others.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select("*", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
