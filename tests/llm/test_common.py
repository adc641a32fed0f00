"""Shared helpers: components against a search, stored tables, side tables."""

from __future__ import annotations

import os
import random
import subprocess
import sys

import pytest

from gridloom.llm.common import components, few_or_many, stored


def brute(edges):
    near: dict[int, set[int]] = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out = {}
    for start in sorted(near):
        if start not in out:
            todo = [start]
            while todo:
                x = todo.pop()
                if x not in out:
                    out[x] = start
                    todo += near[x]
    return out


@pytest.mark.parametrize("kind", ["random", "chain", "star", "odd", "none"])
def test_components(spark, kind):
    rng = random.Random(8)
    edges = {
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(220)], "chain": [(i * 7 % 211, (i + 1) * 7 % 211) for i in range(200)], "star": [(99, i) for i in range(300)],
        "odd": [(None, 1), (2, None), (3, 3), (5, 4), (4, 5), (5, 4), (-7, 5)], "none": [],
    }[kind]
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    got = components(df)
    assert {r.node: r.component for r in got.collect()} == brute(edges) and got.count() == len(brute(edges))


def test_stored_and_side_tables(spark):
    df = spark.range(10).selectExpr("id", "if(id > 5, null, id) as x")
    assert stored(df, "t").orderBy("id").collect() == df.orderBy("id").collect()
    assert "BroadcastExchange" in spark.range(20).join(few_or_many(df), "id")._jdf.queryExecution().executedPlan().toString()
    assert few_or_many(df, most=3).count() == 10


def test_stored_tables_can_be_dropped(tmp_path):
    """In a process of its own, as it drops all tables of the application."""
    code = f"""
from pyspark.sql import SparkSession
from gridloom.llm.common import drop_stored, stored
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}/shared").getOrCreate()
assert stored(spark.range(3), "t").count() == 3
import os
assert len(os.listdir("{tmp_path}/shared/tables")) == 1
assert drop_stored(spark) and os.listdir("{tmp_path}/shared/tables") == [] and not drop_stored(spark)
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert subprocess.run([sys.executable, "-c", code], env=os.environ | {"PYTHONPATH": root}, cwd=tmp_path, timeout=120).returncode == 0
