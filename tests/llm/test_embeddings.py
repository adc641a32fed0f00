"""Embedding links and exact top-k against all pairs."""

from __future__ import annotations

import math

import numpy as np
import pytest

from gridloom.llm import embed_dedup, knn
from gridloom.llm.embed_dedup import link_embeddings, tile_links
from gridloom.llm.knn import top_k

SCHEMA = "vec_id long, embedding array<float>, label int"


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


def vectors(seed=2, n=160, dims=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, dims))
    rows = [(i, [float(x) for x in (centres[i % 9] + 0.25 * rng.normal(size=dims)).astype(np.float32)], i % 3 if i % 11 else None) for i in range(n)]
    rows += [(n + k, rows[0][1], rows[4][2]) for k in range(30)]
    rows += [(900, None, 1), (901, [], 1), (902, [0.0] * dims, 1), (903, [float("nan")] * dims, 1), (904, [None] + [1.0] * (dims - 1), 1), (905, [float("inf")] + [1.0] * (dims - 1), 1), (906, [1.0, 2.0], 1), (907, [2.0, 4.0], 1), (3, rows[3][1], rows[3][2])]
    return rows


def brute_links(rows, least):
    rows = {i: (np.array(v, float), y) for i, v, y in rows if usable(v) and any(v) and y is not None}
    links = {i: set() for i in rows}
    for i, (a, y) in rows.items():
        for j, (b, z) in rows.items():
            if i < j and y == z and len(a) == len(b) and a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= least:
                links[i].add(j), links[j].add(i)
    return links


@pytest.mark.parametrize(("tile", "least"), [(7, 0.93), (1024, 0.93), (16, 0.8)])
def test_links(spark, tile, least):
    rows = vectors()
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as n_links", "2 as rep", "3 as v")
    links = brute_links(rows, least)
    comp = {}
    for i in sorted({r[0] for r in rows}):
        seen, todo = {i}, [i]
        while todo:
            new = links.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        comp[i] = min(seen)
    got = link_embeddings(df, least, tile=tile).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == {i: (len(links.get(i, ())), c, c == i) for i, c in comp.items()}
    assert len(got) == len(comp)


def test_an_id_is_one_vector(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.01], 0), (2, [0.0, 1.0], 0), (3, [0.0, 1.0], 0), (3, None, 0), (None, [0.0, 1.0], 0), (None, None, None)]
    got = sorted(tuple(r) for r in link_embeddings(spark.createDataFrame(rows, SCHEMA)).where("vec_id is not null").collect())
    assert got == [(1, 0, 1, True), (2, 1, 2, True), (3, 1, 2, False)]


def test_doubles_are_compared_as_doubles(spark):
    """Two vectors that are equal as floats, and a cosine just below the bound."""
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 1e-12], 0), (3, [1e300, 0.0], 0), (4, [0.93, math.sqrt(1 - 0.93**2) * (1 + 1e-10)], 0)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in link_embeddings(spark.createDataFrame(rows, SCHEMA.replace("float", "double"))).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4)}


def test_cells_that_are_far_apart_have_no_links():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(30, 8))[rng.integers(30, size=900)] + 0.05 * rng.normal(size=(900, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    p = x[:40]
    cell = (x @ p.T).argmax(1)
    reach = np.array([np.arccos(np.clip((x[cell == c] @ p[c]).min(), -1, 1)) for c in range(40)])
    apart = embed_dedup.far_apart(p, reach, 0.93)
    i, j = np.nonzero(x @ x.T >= 0.93)
    assert not apart[cell[i], cell[j]].any() and apart.mean() > 0.3


def test_tiles_bound_what_they_leave_out():
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(80, 16)), rng.normal(size=(70, 16))
    b[:40] = a[:40] + rng.normal(size=(40, 16)) * np.linspace(0, 0.6, 40)[:, None]
    cos = (a / np.linalg.norm(a, axis=1)[:, None]) @ (b / np.linalg.norm(b, axis=1)[:, None]).T
    for least in (0.5, 0.93, 0.99):
        i, j = tile_links(a, b, least, False)
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(map(tuple, np.argwhere(cos >= least).tolist()))


def test_odd_embedding_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert link_embeddings(empty).collect() == [] and top_k(empty).collect() == []
    lone = spark.createDataFrame([(None, [1.0, 2.0], 1), (5, [1.0, 2.0], 1)], SCHEMA)
    assert [(r.vec_id, r.n_links, r.component_id, r.kept) for r in link_embeddings(lone).orderBy("vec_id").collect()] == [(None, 0, None, False), (5, 0, 5, True)]
    assert top_k(lone).collect() == []


def brute_top(rows, k, every):
    x = {i: np.floor(1024 * np.array(v, float)).astype(np.int64) for i, v, _ in rows if usable(v)}
    out = set()
    for q in x:
        if q % every == 0:
            found = sorted((-int(x[q] @ v), i) for i, v in x.items() if i != q and len(v) == len(x[q]))
            out |= {(q, r, i, -s) for r, (s, i) in enumerate(found[:k], 1)}
    return out


@pytest.mark.parametrize(("k", "every"), [(10, 100), (3, 7), (500, 50)])
def test_top_k(spark, monkeypatch, k, every):
    monkeypatch.setattr(knn, "BLOCK", 16)
    monkeypatch.setattr(knn, "GROUP", 4)
    rows = vectors(5)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as rank", "2 as cell", "3 as score")
    got = {tuple(r) for r in top_k(df, k, every).select("query_id", "rank", "vec_id", "score").collect()}
    assert got == brute_top(rows, k, every)


def test_all_embeddings(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    assert {tuple(r) for r in top_k(df).select("query_id", "rank", "vec_id", "score").collect()} == brute_top(rows, 10, 100)
    links = brute_links(rows, 0.93)
    assert {r.vec_id: r.n_links for r in link_embeddings(df).collect()} == {i: len(links.get(i, ())) for i, _, _ in rows}
    assert embed_dedup.TILE > 0


def test_cells_are_left_out_where_the_data_has_clusters():
    """The share of (query, cell) that has to be searched; isotropic vectors leave none out."""
    rng = np.random.default_rng(6)
    for spread, most in ((0.05, 0.15), (None, 1.0)):
        x = rng.normal(size=(4000, 24))
        if spread:
            x = rng.normal(size=(40, 24))[rng.integers(40, size=4000)] + spread * x
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        pivots, q = x[:60], x[60:160]
        cell = (x @ pivots.T - (pivots**2).sum(1) / 2).argmax(1)
        far = np.linalg.norm(x - pivots[cell], axis=1)
        radius = np.array([far[cell == c].max() for c in range(60)])
        near = [np.sort(far[cell == c])[:11] for c in range(60)]
        s = q @ x.T
        own = cell[60:160]
        known = np.array([np.sort(s[i, cell == own[i]])[-11] if (cell == own[i]).sum() > 10 else -np.inf for i in range(100)])
        need = knn.needed(q, pivots, radius, near, 10, known)
        reach = np.sort(s, axis=1)[:, -11]
        assert all(need[i, cell[j]] for i in range(100) for j in np.flatnonzero(s[i] >= reach[i]))
        assert need.mean() <= most


def test_scores_that_do_not_fit_are_told():
    with pytest.raises(OverflowError):
        knn._scores(np.array([[2**40, 1]]), np.array([[2**40, 1]]))
