"""Every query against its SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from gridloom.catalog import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(rows, columns):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted([tuple(repr(round(v, 9) + 0.0) if isinstance(v, float) else repr(v) for v in (r[i] for i in at)) for r in rows])


@pytest.fixture(scope="module")
def sql(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    got = rows_of([tuple(r) for r in df.collect()], df.columns)
    assert name in ORACLES
    cur = sql.execute(ORACLES[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows_of(cur.fetchall(), columns)


@pytest.mark.parametrize("odd", [[(k, [k / 100.0]) for k in range(-99, 100)], [(0, None), (1, []), (2, [None]), (3, [None, 0.5]), (4, [0.1] * 9), (5, [None] * 9 + [0.2]), (6, [0.1] * 9 + [None, 0.3])]])
def test_joint_algorithms_on_odd_vectors(spark, tmp_path, odd):
    """Products that single and double precision round to different sides of an integer; nulls and short vectors."""
    spark.createDataFrame(odd, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    df = QUERIES["joint_algorithms"](spark, str(tmp_path))
    with duckdb.connect() as con:
        con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
        cur = con.execute(ORACLES["joint_algorithms"])
        columns = [c[0] for c in cur.description]
        assert rows_of([tuple(r) for r in df.collect()], df.columns) == rows_of(cur.fetchall(), columns)


def test_entry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["i0", "i1", "r", "g", "b", "a"]
