"""Shared helpers: durable intermediate tables and connected components."""

from __future__ import annotations

import ctypes
import functools
import re
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.sources.storage import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tables(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}"


def drop_stored(spark: SparkSession) -> bool:
    """Removes the intermediate tables of this application; frames that read them are then of no use."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_tables(spark))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read back.

    It cuts the lineage and survives the loss of executors. The tables of an
    application share a folder; drop_stored removes it.
    """
    spark = df.sparkSession
    path = f"{_tables(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Lets Arrow batches of texts to Python workers have about ``most`` bytes, where the session allows more."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.sub(r"[bB]$", "", spark.conf.get(name, "67108864"))
    if not now.isdigit() or not 0 < int(now) <= most:
        spark.conf.set(name, str(most))


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, after which its worker gives free memory back to the machine: workers wait for other tasks, and keep what they once took."""

    @functools.wraps(run)
    def go(batches: Iterator) -> Iterator:
        yield from run(batches)
        _give_back()

    return go


def few_or_many(df: DataFrame, most: int = 500_000) -> DataFrame:
    """``df``, stored, with a hint to broadcast it if it has at most ``most`` rows (of a few numbers); else it is shuffled."""
    df = stored(df, "side")
    return F.broadcast(df) if df.count() <= most else df


#: Nodes that a task holds at once while it shrinks its edges.
HELD = 500_000


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A spanning forest of each run of a partition's edges (of about HELD nodes), as (a, root) rows."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def forest() -> Iterator[pd.DataFrame]:
        pairs = [(r, x) for x in list(parent) if (r := find(x)) != x]
        parent.clear()
        for i in range(0, len(pairs), 100_000):
            part = pairs[i : i + 100_000]
            yield pd.DataFrame({"a": [p[0] for p in part], "b": [p[1] for p in part]})

    for pdf in batches:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
            ra, rb = find(a), find(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
        if len(parent) > HELD:
            yield from forest()
    yield from forest()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a long, b long)``.

    Returns ``(node, component)`` for every node that has an edge to another
    node, where ``component`` is the smallest node reachable. Rows with a null
    end, loops and repeated edges are allowed and change nothing.

    Each partition first shrinks its edges to a spanning forest. Then large-star
    and small-star rounds alternate: each is one grouped minimum (combined
    before the shuffle) and one equi-join that can be split if a node is hot.
    Every round is written to the shared folder. No edge list is collected. The
    rounds go on until one changes nothing; they end for any input, as a round
    that changes an edge gives a node a smaller neighbour.
    """
    clean = edges.where("a is not null and b is not null and a <> b").select(F.col("a").cast("long"), F.col("b").cast("long"))
    e = stored(clean.mapInPandas(_forest, "a long, b long").distinct(), "edges")
    before = None
    while True:
        # Large star: each node's larger neighbours point to its smallest neighbour.
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        # Small star: a node and its smaller neighbours point to the smallest of them.
        lows = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(lows, "b").select(F.col("m"), F.explode(F.array("a", "b")).alias("x")).where("m <> x").select(F.col("m").alias("a"), F.col("x").alias("b")).distinct()
        e = stored(small, "edges")
        # An edge list is final when it is the same as before: count and checksum.
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum(F.xxhash64("b", "a") % 998_244_353)).first()
        if before == now:
            break
        before = now
    out = e.groupBy("b").agg(F.min("a").alias("component")).select(F.col("b").alias("node"), "component")
    return out.unionByName(e.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
