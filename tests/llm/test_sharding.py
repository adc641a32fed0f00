"""Extendible hashing against a bucket-splitting loop."""

from __future__ import annotations

import hashlib
import random

import pytest

from gridloom.llm.sharding import BITS, shard_documents, shard_rows


def bits(key):
    return int(hashlib.md5(str("" if key is None else key).encode()).hexdigest()[:15], 16)


def brute(rows, limit):
    """Splits buckets on the next bit until each fits."""
    out, todo = {}, [("", list(rows))]
    while todo:
        name, bucket = todo.pop()
        if sum(n for _, n in bucket) <= limit or len(bucket) <= 1:
            out |= {i: name for i, _ in bucket}
            continue
        for b in "01":
            todo.append((name + b, [(i, n) for i, n in bucket if format(bits(i), f"0{BITS}b")[len(name)] == b]))
    return out


@pytest.mark.parametrize("limit", [50, 400, 10**9])
def test_shards_are_those_of_splitting(spark, limit):
    rng = random.Random(limit)
    rows = [(i, rng.choice([0, 1, 30, 200])) for i in range(500)]
    df = spark.createDataFrame([(i, "x" * n) for i, n in rows], "doc_id long, text string")
    got = shard_documents(df, limit).collect()
    assert {r.doc_id: r.shard for r in got} == brute(rows, limit)
    total: dict[str, list[int]] = {}
    for r in got:
        total.setdefault(r.shard, []).append(r.n_bytes)
    assert all(r.shard_bytes == sum(total[r.shard]) and r.shard_rows == len(total[r.shard]) and r.depth == len(r.shard) for r in got)
    assert all(sum(v) <= limit or len(v) == 1 for v in total.values())


def test_one_key_with_very_many_rows(spark):
    df = spark.range(3000).selectExpr("if(id < 2000, 7, id) as doc_id", "'0123456789' as text")
    got = shard_documents(df, 500).collect()
    assert len(got) == 3000
    total: dict[str, int] = {}
    for r in got:
        total[r.shard] = total.get(r.shard, 0) + r.n_bytes
    assert max(total.values()) <= 500 and any("+" in s for s in total)
    assert all(r.shard_bytes == total[r.shard] for r in got)


def test_odd_rows(spark):
    rows = [(None, "aé"), (1, None), (2, ""), (3, "y" * 100_000), (3, "y" * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as shard", "2 as bits", "3 as size", "4 as root", "5 as slot")
    got = shard_documents(df, 10).collect()
    assert sorted(r.n_bytes for r in got) == [0, 0, 3, 100_000, 100_000]
    assert sorted(r.shard_rows for r in got if r.n_bytes > 10) == [1, 1]
    assert shard_documents(df.where("false"), 10).collect() == []


def test_general_rows_keep_columns(spark):
    df = spark.createDataFrame([("a", 5, None), ("b", 6, 3)], "name string, bits long, size long")
    assert shard_rows(df, 100).columns == ["name", "bits", "size", "shard", "depth", "shard_bytes", "shard_rows"]


def test_no_python_on_the_way(spark, sf_dir):
    plan = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), 1 << 16)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
