"""Access patterns and splits against fixed values."""

from __future__ import annotations

import pytest
from hypothesis import given
from hypothesis import strategies as st

from gridloom.operators.mappers import All, Chunk, Custom, EvenSplit, Fixed, Neighborhood, OneToOne, Slice, even_bounds, transposed
from gridloom.operators.regions import Box, Region
from gridloom.operators.splits import run_of, split_1d, split_2d, split_constraint, tile_of


def one(mapper, chunk, shape):
    (b,) = mapper.region(chunk, shape).boxes
    return b.min, b.range


C = Chunk


def test_simple_patterns():
    assert one(OneToOne(), C((64, 32), (32, 4), (128, 128)), (128, 128)) == ((64, 32), (32, 4))
    assert one(Fixed((3,), (97,)), C((5,), (1,), (9,)), (128,)) == ((3,), (97,))
    assert one(Fixed((0, 100, 127), (256, 64, 32)), C((0,), (1,), (1,)), (128, 128, 128)) == ((0, 100, 127), (128, 28, 1))
    for d in range(3):
        want = ((32,) * d + (0,) + (32,) * (2 - d), (32,) * d + (128,) + (32,) * (2 - d))
        assert one(Slice(d), C((32,) * 3, (32,) * 3, (128,) * 3), (128,) * 3) == want
    assert one(All(), C((1,), (1,), (4,)), (128, 64, 32)) == ((0, 0, 0), (128, 64, 32))
    with pytest.raises(ValueError):
        OneToOne().region(C((0,), (1,), (1,)), (4, 4))


def test_neighbourhoods():
    def found(m, chunk, shape):
        return m.region(chunk, shape)

    assert found(Neighborhood((10,)), C((15,), (10,), (128,)), (128,)) == Region.of(Box((5,), (35,)))
    assert found(Neighborhood((10, 10)), C((5, 100), (10, 20), (128, 128)), (128, 128)) == Region.of(Box((0, 90), (25, 128)))
    assert found(Neighborhood((3, 4, 5)), C((3, 4, 5), (1, 1, 1), (128,) * 3), (128,) * 3) == Region.of(Box((0, 0, 0), (7, 9, 11)))
    assert found(Neighborhood((10, 10), True), C((5, 100), (10, 20), (128, 128)), (128, 128)) == Region.of(Box((0, 100), (25, 120)), Box((5, 90), (15, 128)))
    axes = Region.of(Box((0, 4, 5), (7, 5, 6)), Box((3, 0, 5), (4, 9, 6)), Box((3, 4, 0), (4, 5, 11)))
    assert found(Neighborhood((3, 4, 5), True), C((3, 4, 5), (1, 1, 1), (128,) * 3), (128,) * 3) == axes


# Extent, granularity, first worker, workers of the chunk, all workers, offset, extent.
@pytest.mark.parametrize(("n", "g", "node", "many", "nodes", "at", "size"), [(128, 1, 0, 1, 8, 0, 16), (128, 1, 4, 2, 8, 64, 32), (131, 1, 5, 2, 7, 95, 36), (128, 10, 0, 1, 8, 0, 20), (131, 10, 0, 1, 7, 0, 20), (131, 10, 5, 2, 7, 100, 31), (236, 10, 6, 1, 7, 200, 36)])
def test_even_split(n, g, node, many, nodes, at, size):
    assert one(EvenSplit(g), C((node,), (many,), (nodes,)), (n, 5)) == ((at, 0), (size, 5))
    assert EvenSplit(g).region(C((0,), (0,), (0,)), (n,)).empty


def test_custom_patterns():
    assert one(transposed(), C((2, 5), (3, 4), (9, 9)), (9, 9)) == ((5, 2), (4, 3))
    assert one(Custom(lambda c, shape: Box((0,), (shape[0],))), C((2,), (3,), (9,)), (9,)) == ((0,), (9,))
    assert one(Custom(lambda c: Region.of(Box((0,), (99,)))), C((2,), (3,), (9,)), (9,)) == ((0,), (9,))


def sizes(boxes, d):
    return [b.range[d] for b in boxes]


@pytest.mark.parametrize(("n", "g", "parts", "want"), [(128, 1, 4, [32] * 4), (13, 1, 5, [3, 3, 3, 2, 2]), (80, 16, 3, [32, 32, 16]), (96, 48, 3, [48, 48])])
def test_split_1d(n, g, parts, want):
    got = split_1d(Box((7,), (7 + n,)), (g,), parts)
    assert sizes(got, 0) == want and got[0].min == (7,) and got[-1].max == (7 + n,)


@pytest.mark.parametrize(
    ("shape", "g", "parts", "rows", "cols"),
    [
        ((128, 128), (1, 1), 4, [64, 64], [64, 64]), ((128, 128), (8, 8), 8, [32] * 4, [64, 64]), ((256, 128), (8, 128), 8, [32] * 8, [128]), ((128, 128), (32, 8), 4, [64, 64], [64, 64]),
        ((100, 100), (1, 1), 6, [34, 33, 33], [50, 50]), ((128, 120), (8, 8), 4, [64, 64], [64, 56]), ((128, 128), (16, 8), 12, [32] * 4, [48, 40, 40]), ((128, 128), (64, 64), 3, [64, 64], [128]),
        ((128, 128), (8, 64), 8, [32] * 4, [64, 64]), ((128, 128), (64, 8), 8, [64, 64], [32] * 4), ((256, 64), (1, 1), 8, [64] * 4, [32, 32]), ((64, 256), (1, 1), 8, [32, 32], [64] * 4),
    ],
)
def test_split_2d(shape, g, parts, rows, cols):
    got = split_2d(Box.full(shape), g, parts)
    assert [b.range for b in got] == [(r, c) for r in rows for c in cols]
    assert Region.of(*got) == Region.of(Box.full(shape)) and sum(b.area for b in got) == shape[0] * shape[1]


def test_constraints():
    assert split_constraint((100,), (5,), (10,)) == (10,)
    for extent, c, local in (((10,), (0,), None), ((10,), (3,), None), ((100,), (3,), (10,))):
        with pytest.raises(ValueError):
            split_constraint(extent, c, local)


@given(st.integers(1, 300), st.integers(1, 12), st.integers(1, 9))
def test_even_bounds_cover(n, parts, g):
    b = even_bounds(n, parts, g)
    assert len(b) == parts and b[0][0] == 0 and b[-1][1] == n and all(x[1] == y[0] for x, y in zip(b, b[1:], strict=False))


@pytest.mark.parametrize(("n", "parts", "g"), [(128, 8, 1), (131, 7, 10), (236, 7, 10), (5, 8, 1), (40, 3, 16)])
def test_run_of_is_the_formula_of_even_bounds(spark, n, parts, g):
    got = {r.id: r.p for r in spark.range(n).select("id", run_of("id", n, parts, g).alias("p")).collect()}
    assert got == {i: k for k, (a, b) in enumerate(even_bounds(n, parts, g)) for i in range(a, b)}


def test_tile_of(spark):
    shape = (100, 60)
    df = spark.range(6000).selectExpr("id div 60 as i0", "id % 60 as i1")
    got = {(r.i0, r.i1): r.t for r in df.select("i0", "i1", tile_of(shape, (1, 1), 6).alias("t")).collect()}
    for k, b in enumerate(split_2d(Box.full(shape), (1, 1), 6)):
        assert all(got[i, j] == k for i in range(b.min[0], b.max[0]) for j in range(b.min[1], b.max[1]))
