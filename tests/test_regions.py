"""Boxes, regions, region maps."""

from __future__ import annotations

import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.operators.regions import (
    Box,
    Region,
    RegionBuilder,
    RegionMap,
    bounding_box,
    combine_regions,
    connected_bounding_boxes,
    dissected,
    interval_join,
    intersections,
    merge_intervals,
    merged_intervals,
    merged_overlapping,
    overlay,
    overwrite_runs,
    split_overlapping,
)


def boxes(*rows):
    return [Box(tuple(a), tuple(b)) for a, b in rows]


def cells(bs):
    out = set()
    for b in bs:
        if len(b.min) == 2:
            out |= {(i, j) for i in range(b.min[0], b.max[0]) for j in range(b.min[1], b.max[1])}
        else:
            out |= {(i,) for i in range(b.min[0], b.max[0])}
    return out


# Regions, and their canonical boxes.
UNION_A = boxes(((0, 0), (3, 3)), ((4, 0), (7, 3)), ((0, 7), (1, 9)), ((4, 7), (6, 9)))
UNION_B = boxes(((2, 3), (5, 6)), ((6, 3), (9, 6)), ((1, 7), (2, 9)), ((4, 7), (6, 9)))
UNION = boxes(((0, 0), (2, 3)), ((2, 0), (3, 6)), ((3, 3), (4, 6)), ((4, 0), (5, 6)), ((5, 0), (6, 3)), ((6, 0), (7, 6)), ((7, 3), (9, 6)), ((0, 7), (2, 9)), ((4, 7), (6, 9)))
BOTH_A = boxes(((2, 2), (6, 6)), ((6, 2), (8, 4)), ((8, 0), (9, 4)), ((0, 12), (3, 14)), ((2, 9), (4, 11)))
BOTH_B = boxes(((3, 4), (7, 8)), ((7, 1), (8, 4)), ((8, 2), (9, 5)), ((2, 9), (3, 14)))
BOTH = boxes(((3, 4), (6, 6)), ((7, 2), (9, 4)), ((2, 9), (3, 11)), ((2, 12), (3, 14)))
LESS_A = boxes(((0, 0), (6, 6)), ((1, 8), (4, 11)), ((8, 2), (10, 4)))
LESS_B = boxes(((1, 1), (3, 3)), ((2, 2), (4, 4)), ((0, 9), (2, 12)), ((4, 11), (6, 13)), ((7, 1), (11, 5)))
LESS = boxes(((0, 0), (1, 6)), ((1, 0), (3, 1)), ((3, 0), (4, 2)), ((1, 3), (2, 6)), ((2, 4), (4, 6)), ((4, 0), (6, 6)), ((1, 8), (2, 9)), ((2, 8), (4, 11)))


def test_set_operations():
    assert list((Region.of(*UNION_A) | Region.of(*UNION_B)).boxes) == sorted(UNION)
    assert list((Region.of(*BOTH_A) & Region.of(*BOTH_B)).boxes) == sorted(BOTH)
    assert list((Region.of(*LESS_A) - Region.of(*LESS_B)).boxes) == sorted(LESS)


def test_canonical_form():
    assert Region.of(*boxes(((0, 0), (4, 4)), ((2, 2), (6, 6)), ((4, 8), (5, 9)))).boxes == tuple(boxes(((0, 0), (2, 4)), ((2, 0), (4, 6)), ((4, 2), (6, 6)), ((4, 8), (5, 9))))
    fast = Region.of(*boxes(((0, 0), (8, 2)), ((0, 2), (2, 4)), ((6, 2), (8, 4)), ((0, 4), (8, 6))))
    assert fast.boxes == tuple(boxes(((0, 0), (2, 6)), ((2, 0), (6, 2)), ((2, 4), (6, 6)), ((6, 0), (8, 6))))
    assert Region.of().empty and Region.of(Box((1,), (1,))).empty and Region.of(Box((), ())).boxes == (Box((), ()),)


small = st.tuples(st.integers(0, 8), st.integers(0, 8), st.integers(0, 4), st.integers(0, 4)).map(lambda t: Box.at(t[:2], t[2:]))


@given(st.lists(small, max_size=6), st.lists(small, max_size=6))
def test_operations_are_those_of_sets(a, b):
    x, y = Region.of(*a), Region.of(*b)
    for got, want in ((x, cells(a)), (x | y, cells(a) | cells(b)), (x & y, cells(a) & cells(b)), (x - y, cells(a) - cells(b))):
        assert cells(got.boxes) == want and got.area == len(want)
    if cells(a) == cells(b):
        assert x == y
    assert Region.of(*random.Random(1).sample(a, len(a))) == x


@given(st.lists(small, max_size=6))
def test_dissection(a):
    parts = dissected(a)
    assert cells(parts) == cells(a) and sum(b.area for b in parts) == len(cells(a))
    assert all(p & b in (p, Box((0, 0), (0, 0))) for p in parts for b in a)


def test_intervals():
    assert merged_intervals([(0, 2), (2, 4), (4, 8), (10, 12)]) == [(0, 8), (10, 12)]
    assert merged_intervals([(0, 6), (2, 4), (8, 12), (10, 16), (16, 18), (5, 5)]) == [(0, 6), (8, 18)]
    assert connected_bounding_boxes(Region.of(*[Box((a,), (b,)) for a, b in [(0, 5), (6, 10), (10, 15), (19, 25), (12, 21), (30, 39), (35, 40)]])) == [Box((0,), (5,)), Box((6,), (25,)), Box((30,), (40,))]


def test_boxes():
    a, b = Box((0, 0), (4, 4)), Box((4, 0), (6, 4))
    assert a.touches(b) and not a.touches(Box((4, 4), (5, 5))) and not a.touches(Box((5, 0), (6, 1)))
    assert a.covers(Box((1, 1), (2, 4))) and not a.covers(b) and a.covers(Box((9, 9), (9, 9)))
    assert bounding_box([a, b, Box((0, 0), (0, 0))]) == Box((0, 0), (6, 4))
    assert Box((1,), (3,)).cast(3) == Box((1, 0, 0), (3, 1, 1)) and a.cast(1) == Box((0,), (4,))
    with pytest.raises(ValueError):
        bounding_box([])
    assert merged_overlapping(boxes(((0, 0), (2, 2)), ((1, 1), (4, 4)), ((3, 0), (5, 2)), ((9, 9), (10, 10)))) == boxes(((0, 0), (5, 4)), ((9, 9), (10, 10)))
    assert RegionBuilder().add(a).add(b).build() == Region.of(Box((0, 0), (6, 4)))


@given(st.lists(st.lists(small, max_size=4), max_size=4))
def test_split_overlapping(groups):
    given_ = [Region.of(*g) for g in groups]
    parts = split_overlapping(given_)
    assert sum(p.area for p in parts) == len(set().union(*[cells(g) for g in groups]) if groups else set())
    for p in parts:
        for r in given_:
            assert (p & r).empty or (p & r) == p


def test_region_map():
    m = RegionMap((128,), "default")
    m.update(Box((0,), (64,)), 1337)
    assert m.values(Box((0,), (1000,))) == [(Box((0,), (64,)), 1337), (Box((64,), (128,)), "default")]
    m.update(Box((32,), (500,)), 7)
    m.update(Box((200,), (300,)), 8)
    assert m.values(Box((0,), (128,))) == [(Box((0,), (32,)), 1337), (Box((32,), (128,)), 7)]
    m.apply(lambda v: 0)
    assert m.values(Box((0,), (128,))) == [(Box((0,), (128,)), 0)]


@given(st.lists(st.tuples(small, st.integers(0, 3)), max_size=8), small)
def test_region_map_is_last_writer(updates, asked):
    m, truth = RegionMap((10, 10), -1), {(i, j): -1 for i in range(10) for j in range(10)}
    for b, v in updates:
        m.update(b, v)
        truth |= {c: v for c in cells([b]) if c in truth}
    got = {c: v for b, v in m.values(asked) for c in cells([b])}
    assert got == {c: v for c, v in truth.items() if c in cells([asked])}


@pytest.mark.parametrize("longest", [1, 30, 100_000])
def test_interval_join(spark, longest):
    rng = random.Random(longest)
    a = [(rng.randrange(2), x, x + rng.randrange(0, 9), k) for k in range(40) for x in [rng.randrange(60)]] + [(0, -5, longest - 5, 99)]
    b = [(rng.randrange(2), x, x + rng.randrange(0, 30), k) for k in range(20) for x in [rng.randrange(60)]] + [(0, -longest, 3, 77)]
    out = interval_join(spark.createDataFrame(a, "g int, lo long, hi long, x int"), spark.createDataFrame(b, "g int, lo long, hi long, y int"), ["g"])
    want = sorted((g, max(lo, p), min(hi, q), x, y) for g, lo, hi, x in a for h, p, q, y in b if g == h and max(lo, p) < min(hi, q))
    assert sorted(map(tuple, out.select("g", "lo", "hi", "x", "y").collect())) == want


BOXES = "min0 long, max0 long, min1 long, max1 long"


def relation(spark, bs):
    return spark.createDataFrame([(b.min[0], b.max[0], b.min[1], b.max[1]) for b in bs], BOXES)


@pytest.mark.parametrize("width", [3, 64])
def test_relations_of_boxes_have_the_canonical_regions(spark, width):
    """Against the algebra of the driver, with empty and equal boxes."""
    rng = random.Random(width)
    a, b = ([Box.at((rng.randrange(-9, 20), rng.randrange(-9, 20)), (rng.randrange(0, 9), rng.randrange(1, 7))) for _ in range(25)] for _ in "ab")
    x, y = Region.of(*a), Region.of(*b)
    rx, ry = relation(spark, a + a[:3]), relation(spark, b)
    in_a, in_b = F.col("in_a"), F.col("in_b")
    for keep, want in ((in_a | in_b, x | y), (in_a & in_b, x & y), (in_a & ~in_b, x - y), (in_a & in_a, x)):
        got = combine_regions(rx, ry, keep, width)
        assert sorted(Box((r.min0, r.min1), (r.max0, r.max1)) for r in got.collect()) == list(want.boxes)
    owned = overlay(rx, ry, width).collect()
    assert sum((r.max0 - r.min0) * (r.max1 - r.min1) for r in owned) == (x | y).area
    got = sorted((r.min0, r.min1, r.max0, r.max1) for r in intersections(rx, ry, 2, width).collect())
    assert got == sorted((*c.min, *c.max) for p in a + a[:3] for q in b if not (c := p & q).empty)
    assert combine_regions(rx.where("false"), ry.where("false"), in_a | in_b).collect() == []


def test_runs_overwrite_runs(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(2), x, x + rng.randrange(0, 25), k, rng.randrange(4)) for k in range(60) for x in [rng.randrange(-20, 90)]]
    truth = {}
    for g, lo, hi, _, v in rows:
        truth |= {(g, i): v for i in range(lo, hi)}
    for width in (7, 1024):
        out = overwrite_runs(spark.createDataFrame(rows, "g int, lo long, hi long, at int, v int"), "at", "v", width, ["g"]).collect()
        assert {(r.g, i): r.v for r in out for i in range(r.lo, r.hi)} == truth and sum(r.hi - r.lo for r in out) == len(truth)
        assert not {(r.g, r.hi, r.v) for r in out} & {(r.g, r.lo, r.v) for r in out}


@pytest.mark.parametrize("width", [4, 50, None])
def test_intervals_are_merged_in_pieces(spark, width):
    rng = random.Random(5)
    rows = [(rng.randrange(3), x, x + rng.choice([0, 1, 3, 40])) for _ in range(80) for x in [rng.randrange(-50, 400)]]
    got = merge_intervals(spark.createDataFrame(rows, "g int, lo long, hi long"), ["g"], width)
    want = [(g, *i) for g in range(3) for i in merged_intervals((lo, hi) for h, lo, hi in rows if h == g)]
    assert sorted((r.g, r.lo, r.hi) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("width", [64, None])
def test_tasks_of_merged_intervals_are_bounded(spark, monkeypatch, width):
    """More intervals have more tasks, whatever the session's shuffle partitions, and a task holds no islands."""
    monkeypatch.setattr("gridloom.operators.regions.TASK_INTERVALS", 100, raising=False)
    rows = [(i % 97, x, x + i % 40) for i in range(3000) for x in [i * 7919 % 5000]]
    got = merge_intervals(spark.createDataFrame(rows, "g int, lo long, hi long"), ["g"], width)
    assert got.rdd.getNumPartitions() >= 30 and "Aggregate" not in got._jdf.queryExecution().executedPlan().toString()
    want = [(g, *i) for g in range(97) for i in merged_intervals((lo, hi) for h, lo, hi in rows if h == g)]
    assert sorted((r.g, r.lo, r.hi) for r in got.collect()) == sorted(want)
