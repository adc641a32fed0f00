"""Exact top-k by integer inner product: a Voronoi join with bounds from summaries."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, stored
from .embed_dedup import usable

#: Vectors in a block of a cell, and queries in a group, at most.
BLOCK, GROUP = 4096, 512


def integers(v: Column, scale: int = 1024) -> Column:
    return F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def _nearest(pivots: np.ndarray):
    """Cell and distance of each vector: its nearest pivot of the same length."""
    half = (pivots * pivots).sum(axis=1) / 2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["x"].to_numpy()).astype(np.float64)
            cell = np.empty(len(x), dtype=np.int32)
            for at in range(0, len(x), 2000):
                cell[at : at + 2000] = np.argmax(x[at : at + 2000] @ pivots.T - half, axis=1)
            far = np.sqrt(((x - pivots[cell]) ** 2).sum(axis=1))
            yield pdf.assign(cell=cell, far=far)

    return run


def _closest(k: int):
    """The k smallest distances that a task sees in each cell, and each cell's largest one and count."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[int, list[float]] = {}
        most: dict[int, tuple[int, float]] = {}
        for pdf in batches:
            for cell, far in pdf.groupby("cell")["far"]:
                kept[cell] = sorted([*kept.get(cell, []), *far.nsmallest(k)])[:k]
                n, m = most.get(cell, (0, 0.0))
                most[cell] = n + len(far), max(m, far.max())
        yield pd.DataFrame({"cell": list(kept), "near": list(kept.values()), "n": [most[c][0] for c in kept], "radius": [most[c][1] for c in kept]}).astype({"cell": int, "n": int, "radius": float})

    return run


def needed(q: np.ndarray, pivots: np.ndarray, radius: np.ndarray, near: list[np.ndarray], k: int, known: np.ndarray | None = None) -> np.ndarray:
    """For each query, the cells that may hold one of its k best: a matrix of booleans.

    A vector x at distance d from its cell's pivot p has q.x within |q| d of
    q.p. The k nearest of all cells so give k lower bounds at least; the
    (k + 1)-th of them (one may be the query itself) is a score that the answer
    reaches, as is the k-th score ``known`` of some candidates (-inf for none).
    A cell is left out if even q.p + |q| radius is below both.
    """
    mid = q @ pivots.T
    size = np.sqrt((q * q).sum(axis=1))
    flat, owner = np.concatenate(near), np.repeat(np.arange(len(near)), [len(x) for x in near])
    low = mid[:, owner] - size[:, None] * flat[None, :]
    reach = np.full(len(q), -np.inf)
    if low.shape[1] > k:
        reach = np.partition(low, low.shape[1] - k - 1, axis=1)[:, low.shape[1] - k - 1]
    if known is not None:
        reach = np.maximum(reach, known)
    slack = 1e-9 * (1 + np.abs(mid) + size[:, None] * np.maximum(radius, 0)[None, :])
    return (mid + size[:, None] * radius[None, :] + slack >= reach[:, None]) & (radius >= 0)[None, :]


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    top = float(max(np.abs(q).max(initial=0), 1)) * float(max(np.abs(x).max(initial=0), 1)) * q.shape[1]
    if top < 2**53:  # every sum is exact in double precision
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    if top >= 2**63:
        raise OverflowError("an inner product of these components may not fit 64 bits: use a smaller scale")
    return q @ x.T


def best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> pd.DataFrame:
    """Each query's k best among the given vectors, without its own id; ties to smaller ids."""
    s = _scores(q, x)
    out = []
    for i, own in enumerate(q_ids):
        row, ok = s[i], ids != own
        n = int(ok.sum())
        if n > k:
            least = np.partition(row[ok], n - k)[n - k]
            ok &= row >= least
        at = np.flatnonzero(ok)
        at = at[np.lexsort((ids[at], -row[at]))][:k]
        out.append(pd.DataFrame({"query_id": own, "vec_id": ids[at], "score": row[at]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def _pack(key: list[str]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["x"].to_numpy()).astype(np.int64)
        return pd.DataFrame({c: [pdf[c].iat[0]] for c in key} | {"ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "packed": [x.tobytes()]})

    return run


def _solve(k: int):
    """The best of one block for the queries of one group that may need it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, r in pdf.iterrows():
                qi, xi = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["ids"], np.int64)
                q, x = np.frombuffer(r["q_packed"], np.int64).reshape(len(qi), -1), np.frombuffer(r["packed"], np.int64).reshape(len(xi), -1)
                at = np.asarray(r["who"])
                yield best(qi[at], q[at], xi, x, k).astype({"query_id": np.int64, "vec_id": np.int64, "score": np.int64})

    return run


def _search(rows: DataFrame, k: int, every: int) -> DataFrame:
    n = rows.count()
    n_pivots = int(min(1024, max(4, math.sqrt(n) / 2)))
    picked = rows.orderBy(F.xxhash64(F.lit(5), "vec_id"), "vec_id").limit(n_pivots).select("x").collect()
    pivots = np.unique(np.array([r.x for r in picked], dtype=np.float64), axis=0)
    cells = stored(rows.mapInPandas(_nearest(pivots), "vec_id long, x array<long>, cell int, far double"), "cells")
    parts = cells.select("cell", "far").mapInPandas(_closest(k + 1), "cell int, near array<double>, n long, radius double")
    about = parts.groupBy("cell").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near"), F.sum("n").alias("n"), F.max("radius").alias("radius")).collect()
    radius, near, count = np.full(len(pivots), -1.0), [np.empty(0)] * len(pivots), np.zeros(len(pivots), dtype=np.int64)
    for r in about:
        radius[r.cell], near[r.cell], count[r.cell] = r.radius, np.array(r.near), r.n
    # Blocks of a cell: no task holds a whole cell.
    sub = F.create_map(*[F.lit(int(x)) for c in range(len(pivots)) for x in (c, -(-count[c] // BLOCK) or 1)])
    blocks = cells.withColumn("block", F.pmod(F.xxhash64(F.lit(1), "vec_id"), sub[F.col("cell")]).cast("int"))
    blocks = stored(blocks.groupBy("cell", "block").applyInPandas(_pack(["cell", "block"]), "cell int, block int, ids binary, packed binary"), "blocks")
    # Groups of queries: pivots gather around a few of them, and large groups are dealt out.
    asked = cells.where(F.col("vec_id") % every == 0)
    sizes = {r.cell: r["count"] for r in asked.groupBy("cell").count().collect()}
    n_heads = max(1, min(len(pivots), -(-sum(sizes.values()) // GROUP)))
    heads = pivots[:: max(1, len(pivots) // n_heads)][:n_heads]
    head_of = ((pivots[:, None, :] - heads[None, :, :]) ** 2).sum(axis=2).argmin(axis=1) if len(pivots) * len(heads) * pivots.shape[1] < 1 << 26 else np.array([((p - heads) ** 2).sum(axis=1).argmin() for p in pivots])
    in_head = np.zeros(len(heads), dtype=np.int64)
    for c, m in sizes.items():
        in_head[head_of[c]] += m
    to_head = F.create_map(*[F.lit(int(x)) for c in range(len(pivots)) for x in (c, head_of[c])])
    split = F.create_map(*[F.lit(int(x)) for h in range(len(heads)) for x in (h, -(-in_head[h] // GROUP) or 1)])
    asked = asked.withColumn("head", to_head[F.col("cell")]).withColumn("part", F.pmod(F.xxhash64(F.lit(2), "vec_id"), split[F.col("head")]).cast("int"))
    groups = stored(asked.groupBy("head", "part").applyInPandas(_pack(["head", "part"]), "head int, part int, ids binary, packed binary"), "groups")

    def want(known: bool):
        """Of each group, the cells that its queries need, and which of them do; without ``known`` only the cell whose pivot each one scores highest."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for _, r in pdf.iterrows():
                    ids = np.frombuffer(r["ids"], np.int64)
                    q = np.frombuffer(r["packed"], np.int64).reshape(len(ids), -1).astype(np.float64)
                    start = np.where(count > 0, q @ pivots.T, -np.inf).argmax(axis=1)
                    if known:
                        held = dict(zip(r["held_ids"], r["held"], strict=True)) if r["held_ids"] is not None else {}
                        need = needed(q, pivots, radius, near, k, np.array([held.get(i, -np.inf) for i in ids.tolist()], dtype=float))
                        need[np.arange(len(q)), start] = False
                    else:
                        need = np.zeros((len(q), len(pivots)), dtype=bool)
                        need[np.arange(len(q)), start] = True
                    cell = np.flatnonzero(need.any(axis=0))
                    yield pd.DataFrame({"head": r["head"], "part": r["part"], "cell": cell.astype(np.int32), "who": [np.flatnonzero(need[:, c]).tolist() for c in cell]})

        return run

    kind = "head int, part int, cell int, who array<int>"
    asks = groups.select("head", "part", F.col("ids").alias("q_ids"), F.col("packed").alias("q_packed"))

    def solved(wanted: DataFrame) -> DataFrame:
        both = wanted.join(blocks, "cell").join(asks, ["head", "part"]).repartition("head", "part", "cell", "block")
        return both.select("who", "q_ids", "q_packed", "ids", "packed").mapInPandas(_solve(k), "query_id long, vec_id long, score long")

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    # The cell of the best pivot first: its k-th score there is a threshold for all other cells.
    begun = stored(ranked(solved(stored(groups.select("head", "part", "ids", "packed").mapInPandas(want(False), kind), "first"))), "begun")
    held = begun.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("held"))
    held = asked.select("vec_id", "head", "part").join(held, "vec_id").groupBy("head", "part").agg(F.collect_list("vec_id").alias("held_ids"), F.collect_list("held").alias("held"))
    wanted = stored(groups.join(held, ["head", "part"], "left").mapInPandas(want(True), kind), "wanted")
    rest = solved(wanted)
    return ranked(begun.select("query_id", "vec_id", "score").unionByName(rest)).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Each query's ``k`` best vectors by inner product of floor(``scale`` x): query_id, rank, vec_id, score.

    Queries are the vectors whose id is divisible by ``every``; candidates are
    all but the query's own id, of the same length; ties go to smaller ids.
    Vectors that are null or empty, or hold null or non-finite components, and
    null ids take no part. Rows that repeat an id and vector count once. An
    empty table gives no rows; fewer candidates than ``k`` are all returned.

    Data and queries are grouped by pivots (a sample of at most 1024). Each
    cell's summary (radius, and distances of its k + 1 vectors nearest to the
    pivot) bounds the scores in it. Each query first searches the cell of its best
    pivot, whose k-th score is then a threshold for all others: a group
    of queries gets the blocks of just those cells that one of its queries may
    still need, for these queries alone. Each pair of a group and a block is
    solved in a task of bounded size. Components so large that an inner product
    may not fit 64 bits raise an error.
    """
    bounded_batches(vectors.sparkSession, 8 << 20)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    rows = stored(rows.select("vec_id", integers(F.col("v"), scale).alias("x")).distinct(), "integers")
    out = None
    for r in rows.select(F.size("x").alias("d")).distinct().orderBy("d").collect():  # as a rule one length
        one = _search(rows.where(F.size("x") == r.d), k, every)
        out = one if out is None else out.unionByName(one)
    return out if out is not None else rows.selectExpr("vec_id as query_id", "1 as rank", "vec_id", "vec_id as score")
