"""Grey 16-bit PNG images from and to sparse pixels."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SIGNATURE = b"\x89PNG\r\n\x1a\n"


def encode(image: np.ndarray) -> bytes:
    """A two-dimensional array as a grey image of 16 bits."""
    h, w = image.shape
    raw = np.zeros((h, 1 + 2 * w), np.uint8)
    raw[:, 1:] = image.astype(">u2").view(np.uint8).reshape(h, 2 * w)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return SIGNATURE + chunk(b"IHDR", struct.pack(">2I5B", w, h, 16, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw.tobytes())) + chunk(b"IEND", b"")


def decode(data: bytes) -> np.ndarray:
    """Array of a grey image of 8 or 16 bits, not interlaced."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, parts, head = 8, [], None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        own = data[at + 8 : at + 8 + n]
        at += 12 + n
        if kind == b"IHDR":
            head = struct.unpack(">2I5B", own)
        elif kind == b"IDAT":
            parts.append(own)
    w, h, depth, colour, _, _, laced = head
    if colour or laced or depth not in (8, 16):
        raise ValueError("only plain grey images of 8 or 16 bits")
    step = depth // 8
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(h, 1 + w * step)
    out = np.zeros((h, w * step), np.uint8)
    above = np.zeros(w * step, np.int32)
    for r in range(h):
        kind, line = int(raw[r, 0]), raw[r, 1:].astype(np.int32)
        if kind == 0:
            own = line
        elif kind == 1:
            own = np.stack([np.cumsum(line[k::step]) for k in range(step)], 1).reshape(-1) if step > 1 else np.cumsum(line)
        elif kind == 2:
            own = line + above
        else:
            own = np.zeros_like(line)
            for k in range(len(line)):
                a, b, c = own[k - step] if k >= step else 0, above[k], above[k - step] if k >= step else 0
                if kind == 3:
                    own[k] = (line[k] + (a + b) // 2) % 256
                else:
                    p = a + b - c
                    near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                    own[k] = (line[k] + near) % 256
        above = own % 256
        out[r] = above
    return out if step == 1 else out.view(">u2").astype(np.uint16)


def read(spark: SparkSession, path: str) -> DataFrame:
    """file, row, col, v of the pixels that aren't zero."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(path).select("path", "content")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                image = decode(bytes(content))
                r, c = np.nonzero(image)
                yield pd.DataFrame({"file": p.rpartition("/")[2], "row": r, "col": c, "v": image[r, c].astype(np.int64)})

    return files.mapInPandas(each, "file string, row long, col long, v long")


def write(pixels: DataFrame, path: str, height: int, width: int) -> None:
    """One image of a tile's pixels; an image is dense, so keep it to one tile."""
    spark = pixels.sparkSession
    pdf = pixels.select("row", "col", "v").toPandas()
    image = np.zeros((height, width), np.uint16)
    ok = pdf["row"].between(0, height - 1) & pdf["col"].between(0, width - 1)
    image[pdf["row"][ok], pdf["col"][ok]] = pdf["v"][ok]
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(encode(image)))
    finally:
        out.close()
