"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: A word of the mix is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``sizes(source, source_size)`` with its number ``k``, ``target`` and copy rate ``rate``.

    Sources by code point, null last, weigh ``weights`` in turn. They share
    ``share`` times all sizes; a target stops at ``most`` times its source's
    size, and the excess is shared by weight among the rest. That is a water
    level: sources in order of cap / weight are full up to the level at which
    the rest takes what remains.
    """
    one = Window.orderBy(F.lit(0))
    s = sizes.withColumn("k", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    s = s.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("k") % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.lit(float(most)) * F.col("source_size")).withColumn("level", F.col("cap") / F.col("w"))
    up = Window.orderBy("level", "k").rowsBetween(Window.unboundedPreceding, -1)
    every = one.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("full", F.coalesce(F.sum("cap").over(up), F.lit(0.0))).withColumn("rest", F.sum("w").over(every) - F.coalesce(F.sum("w").over(up), F.lit(0.0)))
    s = s.withColumn("at", (F.lit(float(share)) * F.sum("source_size").over(every) - F.col("full")) / F.col("rest"))
    s = s.withColumn("water", F.first(F.when(F.col("at") <= F.col("level"), F.col("at")), ignorenulls=True).over(Window.orderBy("level", "k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    s = s.withColumn("target", F.least("cap", F.coalesce(F.col("water") * F.col("w"), F.col("cap"))))
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    return s.select("source", "source_size", "k", "target", rate.alias("rate"))


def pivot(sizes: np.ndarray, p: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Rounds probabilities one pair at a time, keeping the sum of ``p * size``.

    Each step moves mass between two open units until one is 0 or 1, up or down
    with the odds that keep both expectations. At most one unit stays open.
    """
    p, held = p.tolist(), -1
    size, u = sizes.tolist(), draws.tolist()
    for i in range(len(p)):
        if not 0.0 < p[i] < 1.0:
            continue
        if held < 0:
            held = i
            continue
        j = held
        up = min((1 - p[j]) * size[j], p[i] * size[i])  # j gains this, i loses it
        down = min(p[j] * size[j], (1 - p[i]) * size[i])
        if u[i] * (up + down) < down:
            end_j, end_i = (1 - p[j]) * size[j] <= up, p[i] * size[i] <= up
            p[j], p[i] = (1.0 if end_j else p[j] + up / size[j]), (0.0 if end_i else p[i] - up / size[i])
        else:
            end_j, end_i = p[j] * size[j] <= down, (1 - p[i]) * size[i] <= down
            p[j], p[i] = (0.0 if end_j else p[j] - down / size[j]), (1.0 if end_i else p[i] + down / size[i])
        held = next((x for x in (j, i) if 0.0 < p[x] < 1.0), -1)
    return np.array(p)


def _round_group(seed: int, level: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order", "id", "size"], kind="stable", na_position="last").reset_index(drop=True)
        tag = f"{seed}/{level}/{pdf['k'].iat[0]}/{pdf['chunk'].iat[0]}".encode()
        rng = np.random.Generator(np.random.PCG64(int.from_bytes(hashlib.sha256(tag).digest()[:8], "little")))
        pdf["p"] = pivot(pdf["size"].to_numpy(float), pdf["p"].to_numpy(float), rng.random(len(pdf)))
        return pdf

    return run


#: Copies that one row stands for, at most, while rows are dealt out again.
STEP = 4096


def mix_units(rows: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17, chunk_rows: int = 2000) -> DataFrame:
    """Copies of all equal rows of ``rows(id, source string, size long)`` together.

    Returns id, source, size, source_size, target, n (how many rows are equal),
    base (copies of each) and more (how many of them get one copy more).
    """
    spark = rows.sparkSession
    units = stored(rows.groupBy("source", "id", "size").agg(F.count("*").alias("n")), "units")
    about = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count("*").alias("units"))
    src = source_targets(about.select("source", "source_size"), weights, share, most).join(about.select(F.col("source").alias("source_"), "units"), F.col("source").eqNullSafe(F.col("source_"))).drop("source_")
    src = stored(src, "targets")
    few = src.count() <= 100_000
    info = src.withColumnRenamed("source", "source_")
    joined = units.join(F.broadcast(info) if few else info, F.col("source").eqNullSafe(F.col("source_"))).drop("source_")
    joined = joined.withColumn("chunk", F.pmod(F.xxhash64(F.lit(seed), "id", "size"), F.ceil(F.col("units") / chunk_rows)).cast("long"))
    joined = joined.withColumn("order", F.xxhash64(F.lit(seed + 1), "id", "size")).withColumn("base", F.floor("rate").cast("int"))
    joined = joined.withColumn("all", F.when(F.col("size") > 0, (F.col("rate") - F.col("base")) * F.col("n")).otherwise(0.0))
    joined = joined.withColumn("whole", F.floor("all")).withColumn("p", F.col("all") - F.col("whole")).drop("rate", "units", "all")
    schema = joined.schema
    state = stored(joined.groupBy("k", "chunk").applyInPandas(_round_group(seed, 0), schema), "rounded")
    decided, level = [state.where("p <= 0 or p >= 1")], 0
    open_rows = state.where("p > 0 and p < 1")
    while True:
        most_open = open_rows.groupBy("k").count().agg(F.max("count")).first()[0] or 0
        if most_open <= 1:
            break
        level += 1
        up = open_rows.withColumn("chunk", F.floor(F.col("chunk") / chunk_rows).cast("long"))
        state = stored(up.groupBy("k", "chunk").applyInPandas(_round_group(seed, level), schema), "rounded")
        decided.append(state.where("p <= 0 or p >= 1"))
        open_rows = state.where("p > 0 and p < 1")
    u = F.pmod(F.xxhash64(F.lit(seed + 2), "k"), F.lit(1 << 30)) / float(1 << 30)
    out = open_rows.withColumn("p", F.when(u < F.col("p"), 1.0).otherwise(0.0))
    for d in decided:
        out = out.unionByName(d)
    return out.select("id", "source", "size", "source_size", "target", "n", "base", (F.col("whole") + F.col("p").cast("long")).alias("more"))


def _dealt(units: DataFrame, many: str) -> DataFrame:
    """Each row ``many`` times, numbered by ``_i`` from 1: rows of great numbers are cut and dealt out before they are multiplied."""

    def number(df: DataFrame, first: Column, last: Column) -> DataFrame:
        return df.select("*", F.explode(F.sequence(first, last)).alias("_i"))

    units = units.where(F.col(many) > 0)
    few = number(units.where(F.col(many) <= STEP), F.lit(1).cast("long"), F.col(many))
    hot = units.where(F.col(many) > STEP)
    if hot.isEmpty():
        return few
    cut = hot.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(many) - 1) / STEP))).alias("_part")).repartition("id", "size", "_part")
    return few.unionByName(number(cut, F.col("_part") * STEP + 1, F.least(F.col(many), (F.col("_part") + 1) * STEP)).drop("_part"))


def mix_copies(rows: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17, chunk_rows: int = 2000) -> DataFrame:
    """Copies of each row of ``rows(id, source string, size long)``; an id is a long or a string.

    Returns id, source, size, source_size, target and copies (int, at most
    ``most``), one row for each input row. Every row of a source expects the
    same number of copies, its target over its size; the fraction of that is
    rounded so that the source's taken words stay at the target but for less
    than one row's size. Equal rows are one unit with a count: they share whole
    copies, and only what is left of them is rounded, so that an id with very
    many rows is one unit too. Units go by a hash into chunks of about
    ``chunk_rows`` within their source, a chunk rounds its units in the order of
    another hash, and the one open unit that each chunk leaves goes up a tree of
    the same step, so that no task holds a whole source. (The targets of all
    sources are made in one task: a row for each source.) Reruns agree: every
    draw follows from ``seed`` and the rows. Null and repeated ids, rows of size
    0 (no copies matter; they take 0 words) and null sources (a source of their
    own) are allowed; no rows give no rows.
    """
    units = stored(mix_units(rows, weights, share, most, seed, chunk_rows), "mixed")
    copies = F.col("base") + (F.col("_i") <= F.col("more")).cast("int")
    return _dealt(units, "n").select("id", "source", "size", "source_size", "target", copies.alias("copies"))


def mix_documents(docs: DataFrame, text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as the mix takes it, columns unchanged.

    Rows that are equal in every column share their copies. Documents of no
    words keep their place once each, as they weigh nothing.
    """
    cols = [F.col(f"`{c}`") for c in docs.columns]
    key = F.concat(F.hex(F.xxhash64(*cols)), F.lit("-"), F.hex(F.xxhash64(F.lit(1), *cols)))
    narrow = stored(docs.select(key.alias("id"), F.col(source).alias("source"), word_count(text).alias("size")), "words")
    units = mix_units(narrow, **options)
    times = F.when(F.col("size") > 0, F.col("n") * F.col("base") + F.col("more")).otherwise(F.col("n"))
    times = stored(units.select("id", "size", times.alias("_times")).where("_times > 0"), "times")
    one = docs.select(F.struct(*cols).alias("row"), key.alias("id")).dropDuplicates(["id"])
    cold = one.join(times.where(F.col("_times") <= STEP), "id").select("row", F.explode(F.array_repeat(F.lit(0), F.col("_times").cast("int"))).alias("_copy"))
    hot = times.where(F.col("_times") > STEP)
    if hot.isEmpty():
        return cold.select("row.*")
    return cold.select("row").unionByName(_dealt(one.join(F.broadcast(hot) if hot.count() <= 100_000 else hot, "id"), "_times").select("row")).select("row.*")
