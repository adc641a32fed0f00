"""Arrays in files: Parquet in runs of the first dimension, portable grey images, single files of bytes, and the folder that all machines share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..operators.buffer import Buffer
from .storage import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def stream_of(spark: SparkSession, path: str, write: bool = False):
    """The Java stream of one file in any store that Spark knows, open for reading, or new for writing."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = fs.create(p, True) if write else fs.open(p)
    try:
        yield stream
    finally:
        stream.close()


def write_bytes(spark: SparkSession, path: str, pieces: Iterator[bytes]) -> None:
    """Writes one file, a piece at a time; what a failure left of it is removed."""
    try:
        with stream_of(spark, path, write=True) as out:
            for piece in pieces:
                out.write(piece)
    except BaseException:
        remove(spark, path)
        raise


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def in_order(pieces: DataFrame, *by: str) -> Iterator[Row]:
    """The rows one after another by ``by``, a partition of them at the driver at a time; they are made once, and stored until read."""
    spark, path = pieces.sparkSession, scratch(pieces.sparkSession, "pieces")
    pieces.write.parquet(path)
    try:
        yield from spark.read.parquet(path).repartitionByRange(*by).sortWithinPartitions(*by).toLocalIterator()
    finally:
        remove(spark, path)


def save(buffer: Buffer, path: str, parts: int | None = None) -> None:
    """Writes a buffer as Parquet, in ranges of its coordinates, so that readers of a box skip the other files."""
    df = buffer.df.select(*buffer.keys, *buffer.values)
    if buffer.keys:
        df = df.repartitionByRange(parts, *buffer.keys) if parts else df.repartitionByRange(*buffer.keys)
        df = df.sortWithinPartitions(*buffer.keys)
    df.write.parquet(path)


def load(spark: SparkSession, path: str, shape: tuple[int | None, ...], values: tuple[str, ...] = ("v",)) -> Buffer:
    return Buffer(spark.read.parquet(path), shape, values)


def save_grey(buffer: Buffer, path: str, rows: int = 256) -> None:
    """Writes a two-dimensional buffer of bytes as binary portable grey maps, one file row for each strip of ``rows`` lines.

    Files are Parquet rows (first line, content), as Spark has no writer of raw bytes.
    """
    width, value = buffer.extent()[1], buffer.values[0]

    def strip(pdf: pd.DataFrame) -> pd.DataFrame:
        first = int(pdf["i0"].min())
        pixels = np.zeros((int(pdf["i0"].max()) - first + 1, width), np.uint8)
        pixels[pdf["i0"] - first, pdf["i1"]] = pdf[value]
        raw = f"P5\n{width} {len(pixels)}\n255\n".encode() + pixels.tobytes()
        return pd.DataFrame({"first": [first], "content": [raw]})

    buffer.df.withColumn("_s", F.floor(F.col("i0") / rows)).groupBy("_s").applyInPandas(strip, "first long, content binary").write.parquet(path)


def decoded_grey(images: DataFrame) -> Buffer:
    """Pixels of binary portable grey maps in ``images(first, content)``; ``first`` is the image's first line."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for first, raw in zip(pdf["first"], pdf["content"], strict=True):
                magic, w, h, most, pixels = bytes(raw).split(maxsplit=2)[0], *_grey_header(bytes(raw))
                if magic != b"P5" or most != 255:
                    raise ValueError("not a binary portable grey map of bytes")
                i, j = np.indices((h, w)).reshape(2, -1)
                yield pd.DataFrame({"i0": i + first, "i1": j, "v": np.frombuffer(pixels, np.uint8, h * w).astype(np.int32)})

    return Buffer(images.mapInPandas(run, "i0 long, i1 long, v int"), (None, None))


def _grey_header(raw: bytes) -> tuple[int, int, int, bytes]:
    _, size, most, pixels = raw.split(b"\n", 3)
    w, h = size.split()
    return int(w), int(h), int(most), pixels


def read_grey(spark: SparkSession, path: str) -> Buffer:
    """Pixels of the image files of a folder, each counted from its own first line (for one image)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pgm").load(path)
    return decoded_grey(files.select(F.lit(0).cast("long").alias("first"), "content"))
