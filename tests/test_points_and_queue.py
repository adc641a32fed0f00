"""Coordinate arithmetic, and queues."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gridloom.functions.points import Point
from gridloom.operators import kernels
from gridloom.operators.buffer import index_space
from gridloom.operators.host import HostObject
from gridloom.plans.queue import Queue


def test_points():
    a, b = Point(6, 7), Point(4, 2)
    assert a + b == (10, 9) and a - 1 == (5, 6) and 10 - b == (6, 8) and a * b == (24, 14) and a // b == (1, 3) and a % b == (2, 1)
    assert a << 1 == (12, 14) and a >> b == (0, 1) and a & b == (4, 2) and a | b == (6, 7) and a ^ 1 == (7, 6) and -b == (-4, -2) and ~b == (-5, -3)
    assert a.min(b) == b and a.max(Point(5, 9)) == (6, 9) and a.equal(Point(6, 0)) == (True, False)
    assert b.less(a).all_true() and not a.less(b).all_true() and a.at_most(a).all_true()
    assert a.cast(3) == (6, 7, 0) and a.cast(3, 1) == (6, 7, 1) and a.cast(1) == (6,) and a.linear((10, 10)) == 67
    with pytest.raises(ValueError):
        Point(1, 2, 3, 4)


@pytest.mark.parametrize("lookahead", ["none", "automatic", "infinite"])
def test_queue(spark, lookahead):
    q = Queue(lookahead, horizon=3)
    q.bind("a", index_space(spark, (8,), v=F.col("i0")))
    q.bind("b", index_space(spark, (8,), v=F.lit(0).cast("long")))
    for k in range(4):
        q.submit(f"add {k}", "b", lambda a, b: kernels.parallel_for(b, v=F.col("v") + 1), "a", "b")
        q.swap("a", "b")
    q.wait()
    assert q.fence("a").result().tolist() == [i + 2 for i in range(8)]
    assert q.fence("b", (2,), (3,)).result().tolist() == [2, 2, 2]
    state = HostObject([])
    q.host_task("note", state, lambda v: v.append(len(q.log)))
    assert q.log == ["add 0", "add 1", "add 2", "add 3", "note"] and state.value == [5]
    with pytest.raises(ValueError):
        q.set_lookahead("some")
