"""The tables as buffers, and a register of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.buffer import Buffer, from_arrays, from_columns
from ..sources.files import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Entries of an embedding.
WIDTH = 64


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def events(spark: SparkSession, d: str) -> Buffer:
    """One dimension: event_id → value."""
    return from_columns(table(spark, d, "events"), ["event_id"], v="value")


def cells(spark: SparkSession, d: str) -> Buffer:
    """Two dimensions: (vec_id, place) → entry, as a double."""
    b = from_arrays(table(spark, d, "embeddings"), "vec_id", "embedding", WIDTH)
    return b.with_df(b.df.withColumn("v", F.col("v").cast("double")))


def parts(spark: SparkSession, d: str) -> Buffer:
    return from_columns(table(spark, d, "part"), ["p_partkey"], v="p_retailprice")


def orders(spark: SparkSession, d: str) -> Buffer:
    return from_columns(table(spark, d, "orders"), ["o_orderkey"], v="o_totalprice")


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Rounded without a negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits) + F.lit(0.0)


def byte(c: Column | str) -> Column:
    """An entry of an embedding as a grey value from 0 to 255."""
    c = F.col(c) if isinstance(c, str) else c
    return F.least(F.lit(255), F.greatest(F.lit(0), F.floor((c + 0.6) / 1.2 * 256).cast("int")))


#: The cells of the embeddings in SQL, and as grey values.
CELLS = "cells as (select vec_id as i0, (generate_subscripts(embedding, 1) - 1)::bigint as i1, unnest(embedding)::double as v from embeddings)"
GREY = CELLS + ", grey as (select i0, i1, least(255, greatest(0, floor((v + 0.6) / 1.2 * 256)::int)) as v from cells)"
