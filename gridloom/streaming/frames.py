"""Sampled frames of a loop, appended to one table, read as a stream, and packed into one file."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.coordinates import linear_id
from ..operators.buffer import Buffer
from ..sources.files import in_order, write_bytes

#: Cells in a piece of a packed frame.
PIECE = 1 << 20


@dataclass
class FrameSink:
    """An ordered sink: each append adds a frame's cells with its number; ``close`` writes the header (extent of a frame, frames) beside them."""

    path: str
    frames: int = 0
    closed: bool = False
    extent: tuple[int, ...] = ()
    spark: SparkSession | None = field(default=None, repr=False)

    def append(self, buffer: Buffer) -> None:
        if self.closed:
            raise ValueError("the sink is closed")
        if self.spark is None:
            self.spark, self.extent = buffer.df.sparkSession, buffer.extent()
        buffer.df.select(F.lit(self.frames).alias("frame"), *buffer.keys, *buffer.values).write.mode("append").parquet(self.path)
        self.frames += 1

    def close(self) -> int:
        if not self.closed and self.spark is not None:
            self.spark.createDataFrame([(list(self.extent), self.frames)], "extent array<long>, frames long").coalesce(1).write.parquet(self.path.rstrip("/") + "-header")
        self.closed = True
        return self.frames


def read_header(spark: SparkSession, path: str) -> tuple[tuple[int, ...], int]:
    """The extent of a frame and the number of frames that a closed sink has written to ``path``."""
    row = spark.read.parquet(path.rstrip("/") + "-header").first()
    return tuple(row["extent"]), row["frames"]


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def stream_frames(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The frames as an unbounded table: a reader that follows a running loop."""
    return spark.readStream.schema(schema).parquet(path)


def pack_frames(spark: SparkSession, path: str, file: str, value: str = "v", kind: str = "<f4") -> None:
    """Packs the frames of a closed sink into one file: two unsigned 64-bit numbers (first extent, frames), then each frame's cells in row-major order.

    Numbers are little-endian, cells of the numpy type ``kind``; absent and null
    cells are 0. Pieces of at most PIECE cells are packed in parallel and passed
    on in order.
    """
    extent, frames = read_header(spark, path)
    n = int(np.prod(extent, dtype=object)) if extent else 1
    pieces = -(-n // PIECE)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf["piece"].iat[0])
        a = np.zeros(min(PIECE, n - k % pieces * PIECE), kind)
        a[pdf["place"]] = pdf["v"].fillna(0)
        return pd.DataFrame({"piece": [k], "content": [a.tobytes()]})

    inside = F.lit(True)
    for k, most in enumerate(extent):
        inside = inside & F.col(f"i{k}").between(0, most - 1)
    place = F.when(inside, linear_id(extent)).otherwise(F.raise_error(F.lit(f"a cell beyond a frame of {extent}")).cast("long"))
    cells = read_frames(spark, path).select(F.col("frame").cast("long").alias("frame"), place.alias("place"), F.col(value).alias("v"))
    cells = cells.select((F.col("frame") * pieces + F.floor(F.col("place") / PIECE)).alias("piece"), (F.col("place") % PIECE).alias("place"), "v")
    packed = cells.groupBy("piece").applyInPandas(pack, "piece long, content binary")

    def content() -> Iterator[bytes]:
        yield struct.pack("<QQ", extent[0] if extent else 1, frames)
        at = 0
        for r in in_order(packed, "piece"):
            while at < r["piece"]:  # pieces without a cell
                yield bytes(min(PIECE, n - at % pieces * PIECE) * np.dtype(kind).itemsize)
                at += 1
            yield bytes(r["content"])
            at += 1
        while at < frames * pieces:
            yield bytes(min(PIECE, n - at % pieces * PIECE) * np.dtype(kind).itemsize)
            at += 1

    write_bytes(spark, file, content())


def unpack_frames(spark: SparkSession, file: str, extent: Sequence[int], kind: str = "<f4") -> DataFrame:
    """``frame, i0, …, v`` of a packed file of frames of ``extent``, of up to the two gigabytes that a row of Spark holds."""
    n, names = int(np.prod(extent, dtype=object)), [f"i{k}" for k in range(len(extent))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for raw in pdf["content"]:
                first, frames = struct.unpack_from("<QQ", raw)
                if first != extent[0] or len(raw) != 16 + frames * n * np.dtype(kind).itemsize:
                    raise ValueError(f"no file of frames of {tuple(extent)}")
                flat = np.frombuffer(raw, kind, offset=16)
                for at in range(0, len(flat), PIECE):
                    v = flat[at : at + PIECE]
                    where = np.arange(at, at + len(v))
                    yield pd.DataFrame({"frame": where // n} | dict(zip(names, np.unravel_index(where % n, tuple(extent)), strict=True)) | {"v": v.astype(float)})

    return spark.read.format("binaryFile").load(file).select("content").mapInPandas(run, "frame long, " + ", ".join(f"{k} long" for k in names) + ", v double")
