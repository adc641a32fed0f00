"""Token counts of whole texts by a two-tier lookup of pre-token lengths."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import bounded_batches, lean

#: Entries of the broadcast table, at most; and of a worker's cache before it starts anew.
FREQUENT, CACHE = 65_536, 600_000
#: A task reports a pre-token that makes up this share of all that it saw, so at most 1 / SHARE of them.
SHARE = 2.0**-16

_PUNCTUATION = ".,;:!?"


def units(text: str) -> list[str]:
    """Pre-tokens: what stands between spaces and line breaks, which no token crosses."""
    return text.replace("\n", " ").split(" ")


class Counting:
    """Counts tokens with a Tokenizer file; what is neither frequent nor cached goes to the library."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.cache: dict[str, int] = {"": 0}

    def ask(self, unit: str) -> int:
        return len(self.library.encode(unit, add_special_tokens=False).ids)

    def miss(self, unit: str, frequent: dict[str, int]) -> int:
        """Letters and the punctuation after them are separate matches of the tokenizer's pattern."""
        core = unit.rstrip(_PUNCTUATION)
        if len(core) < len(unit) and core.isalpha() and core.lower().isalpha():
            return self.word(core, frequent) + self.word(unit[len(core) :], frequent)
        return self.word(unit, frequent)

    def word(self, unit: str, frequent: dict[str, int]) -> int:
        if unit.isascii():
            low = unit.lower()
            if "<|" not in low:  # the special strings are matched as they are written
                unit = low
        n = frequent.get(unit)
        if n is None:
            n = self.cache.get(unit)
        if n is None:
            if len(self.cache) >= CACHE:
                self.cache = {"": 0}
            n = self.ask(unit)
            if len(unit) <= 64:
                self.cache[unit] = n
        return n

    def count(self, text: str, frequent: dict[str, int]) -> int:
        total, get, miss = 0, frequent.get, self.miss
        for u in units(text):
            n = get(u)
            total += miss(u, frequent) if n is None else n
        return total


_COUNTERS: dict[str, Counting] = {}


def counting(path: str) -> Counting:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counting(path)
    return _COUNTERS[path]


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter[str] = Counter()
    total = 0
    for b in batches:
        for text in b.column("text").to_pylist():
            if text:
                got = units(text)
                total += len(got)
                seen.update(got)
        if len(seen) > 4 * FREQUENT:  # entries below their share so far go; counts of the rest may be too low by that share at most
            least = total * SHARE
            seen = Counter({k: v for k, v in seen.items() if v >= least})
    rows = [(k, v) for k, v in seen.items() if v >= total * SHARE and v > 1 and 0 < len(k) <= 64]
    if rows:
        yield pa.RecordBatch.from_pydict({"unit": [r[0] for r in rows], "n": pa.array([r[1] for r in rows], pa.int64())})


def frequent_units(docs: DataFrame, text: str = "text", most: int = FREQUENT) -> list[str]:
    """The corpus' most frequent pre-tokens, ``most`` at the utmost, from all its texts.

    Each task counts its own texts and passes on only what makes up a share of
    2**-16 of them. The table only speeds up the lookup: counts of tokens don't
    depend on it.
    """
    part = docs.select(F.col(text).alias("text")).mapInArrow(lean(_frequent), "unit string, n long")
    top = part.groupBy("unit").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "unit").limit(most)
    return [r.unit for r in top.select("unit").collect()]


def count_tokens(docs: DataFrame, path: str, text: str = "text", limit: int = 2048, columns: list[str] | None = None, most: int = FREQUENT) -> DataFrame:
    """Adds n_bytes (UTF-8), n_tokens and over_limit (n_tokens > ``limit``) to each
    row's ``columns`` (all, if None); each input row gives one row.

    Tokens are those of the Tokenizer file at ``path`` without added special
    tokens, truncation or padding; special strings inside texts are matched as
    the library does. A null text counts as empty: 0 bytes, 0 tokens. Columns
    of the added names are replaced. The file must be at ``path`` on every
    machine.

    A broadcast table (at most ``most`` short strings) holds the lengths of
    the corpus' frequent pre-tokens; the others are encoded once by each worker
    and cached. Pre-tokens are never shuffled, but for the tasks' summaries
    from which the table is made. A pre-token is what stands between spaces and
    line breaks; it goes to the library whole (or, if letters and then
    punctuation, as these two), so the sum over a text equals the library's
    count of the text.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    c = counting(path)
    none: dict[str, int] = {}
    sent = spark.sparkContext.broadcast({u: c.miss(u, none) for u in frequent_units(docs, text, most)} | {"": 0})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, frequent = counting(path), sent.value
        for b in batches:
            n = pa.array([c.count(t, frequent) if t else 0 for t in b.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("n_bytes"), n], names=["row", "n_bytes", "n_tokens"])

    rest = [F.col(f"`{x}`") for x in (docs.columns if columns is None else columns) if x not in ("n_bytes", "n_tokens", "over_limit")]
    base = docs.select(F.struct(*rest).alias("row"), F.col(text).alias("text"), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("n_bytes"))
    out = base.mapInArrow(lean(run), f"row {base.schema['row'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return out.select("row.*", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
