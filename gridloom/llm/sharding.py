"""Shards of bounded size by extendible hashing, in DataFrame operations only."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Bits of a key's hash: the first 15 hexadecimal digits of its MD5.
BITS = 60
#: Equal rows that are numbered in one place.
STEP = 4096


def hash_bits(key: Column) -> Column:
    """The first 60 bits of the MD5 of a string key (null: empty), as a long."""
    return F.conv(F.substring(F.md5(F.coalesce(key, F.lit(""))), 1, 15), 16, 10).cast("long")


def _prefix(bits: Column | str, depth: int | Column) -> Column:
    b = F.col(bits) if isinstance(bits, str) else bits
    if isinstance(depth, int):
        return F.shiftright(b, BITS - depth)
    return F.call_function("shiftright", b, (F.lit(BITS) - depth).cast("int"))


def _directory(rows: DataFrame, depth: int, start: int, limit: int) -> DataFrame:
    """From rows(root, bits, size): (root, slot, depth, shard bytes and rows) by prefixes of ``depth`` bits.

    Depth is null where even ``depth`` bits leave too much.
    """
    fine = rows.groupBy("root", _prefix("bits", depth).alias("slot")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    levels = fine.select("root", "slot", "bytes", "n", F.explode(F.sequence(F.lit(start), F.lit(depth))).alias("d"))
    levels = levels.withColumn("prefix", F.call_function("shiftright", F.col("slot"), (F.lit(depth) - F.col("d")).cast("int")))
    sums = levels.groupBy("root", "d", "prefix").agg(F.sum("bytes").alias("b"), F.sum("n").alias("k"))
    fits = sums.where((F.col("b") <= limit) | (F.col("k") <= 1))
    # A slot's shard is its shortest prefix that fits.
    best = levels.join(fits, ["root", "d", "prefix"]).groupBy("root", "slot").agg(F.min_by(F.struct("d", "b", "k"), "d").alias("s"))
    return fine.select("root", "slot").join(best, ["root", "slot"], "left").select("root", "slot", F.col("s.d").alias("depth"), F.col("s.b").alias("shard_bytes"), F.col("s.k").alias("shard_rows"))


def shard_rows(rows: DataFrame, limit: int, step: int = 6) -> DataFrame:
    """Gives every row of ``rows(..., bits long, size long)`` its shard.

    The directory is indexed by hash-prefix bits and begins at the empty
    prefix; a bucket over ``limit`` bytes splits on its next bit, others do not.
    Adds ``shard`` (the prefix as a string of 0 and 1), ``depth``,
    ``shard_bytes`` and ``shard_rows``.

    Only sums by prefix are computed, and only for buckets still too large
    beyond the first directory. Rows whose 60 bits are all equal (one key with a
    great many rows) go on splitting by the bits of a hash of their columns and
    of a number among equal rows, after a ``+`` in the shard's name: reruns and
    other partitionings give the same shards. A shard is over ``limit`` only if it is one row
    that is. Null sizes count as 0; no rows give no rows.
    """
    cols = rows.columns
    out: list[DataFrame] = []
    todo = rows.withColumn("size", F.coalesce("size", F.lit(0)).cast("long")).withColumn("root", F.lit(""))
    while True:
        total, n = todo.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
        if not n:
            break
        depth, start = min(BITS, max(4, math.ceil(math.log2(max(1, total) / limit + 1)) + 3)), 0
        while True:
            found = stored(_directory(todo, depth, start, limit), "directory")
            have = todo.withColumn("slot", _prefix("bits", depth)).join(found, ["root", "slot"], "left")
            name = F.concat("root", F.expr(f"if(depth = 0, '', lpad(bin(shiftright(slot, {depth} - depth)), depth, '0'))"))
            out.append(have.where("depth is not null").select(*cols, name.alias("shard"), (F.length("root") + F.col("depth")).alias("depth"), "shard_bytes", "shard_rows"))
            left = found.where("depth is null").select("root", "slot")
            if left.isEmpty():
                return reduce(DataFrame.unionByName, out)
            todo = todo.withColumn("slot", _prefix("bits", depth)).join(left, ["root", "slot"], "left_semi").drop("slot")
            if depth == BITS:
                break
            start, depth = depth + 1, min(BITS, depth + step)
        # One hash value has too many rows: number equal ones (of great numbers in steps that are dealt out first), and split by that.
        more = todo.withColumn("root", F.concat("root", F.lpad(F.bin("bits"), BITS, "0"), F.lit("+")))
        same = more.groupBy(*more.columns).agg(F.count("*").alias("_n"))
        cut = same.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / STEP))).alias("_part")).repartition("root", *cols, "_part")
        each = cut.select(*more.columns, F.explode(F.sequence(F.col("_part") * STEP, F.least(F.col("_n"), (F.col("_part") + 1) * STEP) - 1)).alias("_i"))
        salt = F.xxhash64(*[c for c in cols if c != "bits"], "_i").cast("string")
        todo = stored(each.withColumn("bits", hash_bits(F.concat(F.col("bits").cast("string"), F.lit("/"), salt))).drop("_i"), "salted")
    return reduce(DataFrame.unionByName, out) if out else rows.select(*cols, F.lit("").alias("shard"), F.lit(0).alias("depth"), F.col("size").alias("shard_bytes"), F.lit(1).cast("long").alias("shard_rows"))


def shard_documents(docs: DataFrame, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shards of documents by the hash of ``key`` and the UTF-8 bytes of ``text``.

    Returns doc_id, n_bytes, shard, depth, shard_bytes, shard_rows, a row for
    each input row (also repeated ones). A null key counts as the empty string,
    a null text as 0 bytes. Other columns of any name are not read.
    """
    narrow = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("size"))
    rows = stored(narrow.withColumn("bits", hash_bits(F.col("doc_id").cast("string"))), "sizes")
    return shard_rows(rows, limit).select("doc_id", F.col("size").alias("n_bytes"), "shard", "depth", "shard_bytes", "shard_rows")
