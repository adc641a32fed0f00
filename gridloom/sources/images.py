"""Image files: 8-bit interleaved channels as arrays, read by Spark's image source, written as PNG or JPEG."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.buffer import Buffer
from .files import in_order, remove, scratch, stream_of, write_bytes

#: Value columns by the number of channels.
CHANNELS = {1: ("v",), 3: ("r", "g", "b"), 4: ("r", "g", "b", "a")}
#: 256ths of red, green and blue in a grey value.
LUMA = (77, 150, 29)
#: Fixed values of the PNG format: its signature, and its colour types by the number of channels.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
COLOUR_TYPES = {1: 0, 3: 2, 4: 6}
#: Pixels in a strip, and in an image that becomes a JPEG (which one process encodes), at most.
STRIP, WHOLE = 1 << 22, 1 << 26
_ADLER = 65521


def _converted(a: np.ndarray, channels: int) -> np.ndarray:
    """Pixels of 1, 3 (BGR) or 4 (BGRA) interleaved bytes as ``channels`` channels in the order r, g, b, a."""
    have = a.shape[2]
    if have > 1:
        a = a[:, :, [2, 1, 0, 3][:have]]
    if channels == 1 and have > 1:
        return (a[:, :, :3].astype(np.int32) @ np.array(LUMA, np.int32) >> 8)[:, :, None]
    if channels > 1 and have == 1:
        a = np.repeat(a, 3, axis=2)
    if channels == 4 and a.shape[2] == 3:
        a = np.concatenate([a, np.full((*a.shape[:2], 1), 255, np.uint8)], axis=2)
    return a[:, :, :channels]


def pixels(images: DataFrame, channels: int = 3) -> DataFrame:
    """``origin, i0, i1`` and the channels (0 to 255) of every pixel of ``images(image)``, as Spark's image source gives them.

    Colours become grey by LUMA, grey becomes equal colours, and an absent alpha
    is 255. An image is decoded in one task and passed on in strips. What is no
    image raises an error that names it.
    """
    names = CHANNELS[channels]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for origin, h, w, n, data in pdf.itertuples(index=False):
                if n not in CHANNELS:
                    raise ValueError(f"no image of 1, 3 or 4 channels of bytes: {origin}")
                a, rows = np.frombuffer(data, np.uint8).reshape(h, w, n), max(1, STRIP // max(1, 4 * w))
                for at in range(0, h, rows):
                    part = _converted(a[at : at + rows], channels)
                    i, j = np.indices(part.shape[:2]).reshape(2, -1)
                    yield pd.DataFrame({"origin": origin, "i0": i + at, "i1": j} | {c: part[:, :, k].ravel().astype(np.int32) for k, c in enumerate(names)})

    found = images.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")
    return found.mapInPandas(run, "origin string, i0 long, i1 long, " + ", ".join(f"{c} int" for c in names))


def read_image(spark: SparkSession, path: str, channels: int = 3) -> Buffer:
    """The pixels of one image file (PNG, JPEG, GIF, BMP)."""
    df = pixels(spark.read.format("image").load(path), channels)
    return Buffer(df.drop("origin"), (None, None), CHANNELS[channels])


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def _deflated(strip: np.ndarray) -> tuple[bytes, int, int]:
    """A strip of lines (height, width, channels) as deflate blocks that can follow others, its Adler-32 and its length."""
    lines = strip.reshape(len(strip), -1)
    raw = np.concatenate([np.zeros((len(lines), 1), np.uint8), lines], axis=1).tobytes()
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    return c.compress(raw) + c.flush(zlib.Z_FULL_FLUSH), zlib.adler32(raw), len(raw)


def _joined(first: int, second: int, n: int) -> int:
    """The Adler-32 of two runs of bytes, the second ``n`` long, by theirs."""
    a, b = first & 0xFFFF, first >> 16
    return ((b + (second >> 16) + n * (a - 1)) % _ADLER) << 16 | (a + (second & 0xFFFF) - 1) % _ADLER


def save_image(buffer: Buffer, path: str) -> None:
    """Writes a two-dimensional buffer of one value (grey), three (r, g, b) or four (with alpha) as one image file, by its suffix.

    Values are cut to 0 to 255; absent and null cells are 0. Strips of lines are
    compressed in parallel; the driver only passes them on to the file in their
    order. A JPEG (.jpg, .jpeg; no alpha) is made of the PNG by one process, of
    at most WHOLE pixels.
    """
    suffix = path.rsplit(".", 1)[-1].lower()
    spark, names, n = buffer.df.sparkSession, list(buffer.values), len(buffer.values)
    height, width = buffer.extent()
    if suffix not in ("png", "jpg", "jpeg") or n not in COLOUR_TYPES or min(height, width) < 1:
        raise ValueError(f"a .png, .jpg or .jpeg of 1, 3 or 4 channels and at least one pixel, not {path} of {height} x {width} x {n}")
    if suffix != "png":
        if n == 4 or height * width > WHOLE:
            raise ValueError(f"a JPEG has no alpha, and at most {WHOLE} pixels here: write a .png")
        between = scratch(spark, "image") + ".png"
        save_image(buffer, between)
        try:
            with stream_of(spark, between) as source, stream_of(spark, path, write=True) as out:
                io = spark._jvm.javax.imageio.ImageIO
                if not io.write(io.read(source), "jpg", out):
                    raise RuntimeError("this Java has no writer of JPEG files")
        finally:
            remove(spark, between)
        return
    rows = max(1, min(256, STRIP // width))

    def strip(pdf: pd.DataFrame) -> pd.DataFrame:
        s = int(pdf["_s"].iat[0])
        a = np.zeros((min(rows, height - s * rows), width, n), np.uint8)
        a[pdf["i0"] - s * rows, pdf["i1"]] = pdf[names].fillna(0).clip(0, 255).astype(np.uint8)
        data, adler, size = _deflated(a)
        return pd.DataFrame({"at": [s], "adler": [adler], "size": [size], "content": [data]})

    cells = buffer.df.where(f"i0 >= 0 and i0 < {height} and i1 >= 0 and i1 < {width}").withColumn("_s", F.floor(F.col("i0") / rows))
    strips = cells.groupBy("_s").applyInPandas(strip, "at long, adler long, size long, content binary")

    def file() -> Iterator[bytes]:
        yield SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, COLOUR_TYPES[n], 0, 0, 0)) + _chunk(b"IDAT", b"\x78\x9c")
        adler, at = 1, 0
        for r in in_order(strips, "at"):
            while at < r["at"]:  # strips without a cell
                data, check, size = _deflated(np.zeros((rows, width, n), np.uint8))
                adler, at = _joined(adler, check, size), at + 1
                yield _chunk(b"IDAT", data)
            adler, at = _joined(adler, r["adler"], r["size"]), at + 1
            yield _chunk(b"IDAT", bytes(r["content"]))
        while at * rows < height:
            data, check, size = _deflated(np.zeros((min(rows, height - at * rows), width, n), np.uint8))
            adler, at = _joined(adler, check, size), at + 1
            yield _chunk(b"IDAT", data)
        yield _chunk(b"IDAT", b"\x03\x00" + struct.pack(">I", adler)) + _chunk(b"IEND", b"")

    write_bytes(spark, path, file())
