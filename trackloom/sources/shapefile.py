"""Polyline shapefiles without any library: bytes, a reader and a writer.

Files are found and read by Spark's own binary source, so any store will do.
Rows of a reading: file, record, points (array of x, y).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format.
MAGIC, VERSION, POLYLINE = 9994, 1000, 3


def encode(lines: list[list[tuple[float, float]]]) -> tuple[bytes, bytes]:
    """Bytes of the .shp and of its .shx index."""
    body, index, at = [], [], 50
    xs = [p[0] for line in lines for p in line] or [0.0]
    ys = [p[1] for line in lines for p in line] or [0.0]
    for n, line in enumerate(lines, 1):
        lx, ly = [p[0] for p in line] or [0.0], [p[1] for p in line] or [0.0]
        own = struct.pack("<i4d2ii", POLYLINE, min(lx), min(ly), max(lx), max(ly), 1, len(line), 0) + b"".join(struct.pack("<2d", *p) for p in line)
        body.append(struct.pack(">2i", n, len(own) // 2) + own)
        index.append(struct.pack(">2i", at, len(own) // 2))
        at += 4 + len(own) // 2
    box = struct.pack("<4d", min(xs), min(ys), max(xs), max(ys)) + bytes(32)

    def head(words: int) -> bytes:
        return struct.pack(">7i", MAGIC, 0, 0, 0, 0, 0, words) + struct.pack("<2i", VERSION, POLYLINE) + box

    return head(at) + b"".join(body), head(50 + 4 * len(lines)) + b"".join(index)


def decode(data: bytes) -> Iterator[tuple[int, list[tuple[float, float]]]]:
    """(record, points) of each polyline; parts of one record follow each other."""
    if len(data) < 100 or struct.unpack(">i", data[:4])[0] != MAGIC:
        raise ValueError("not a shapefile")
    at = 100
    while at + 8 <= len(data):
        n, words = struct.unpack(">2i", data[at : at + 8])
        own = data[at + 8 : at + 8 + 2 * words]
        at += 8 + 2 * words
        kind = struct.unpack("<i", own[:4])[0]
        if kind == 0:
            yield n, []
            continue
        if kind != POLYLINE:
            raise ValueError(f"shape type {kind} isn't a polyline")
        parts, points = struct.unpack("<2i", own[36:44])
        yield n, [struct.unpack("<2d", own[k : k + 16]) for k in range(44 + 4 * parts, 44 + 4 * parts + 16 * points, 16)]


def read(spark: SparkSession, path: str) -> DataFrame:
    """file, record, points of all .shp files of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.shp").load(path).select("path", "content")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                rows = [(p.rpartition("/")[2], n, [{"x": x, "y": y} for x, y in line]) for n, line in decode(bytes(content))]
                yield pd.DataFrame(rows, columns=["file", "record", "points"])

    return files.mapInPandas(each, "file string, record long, points array<struct<x:double,y:double>>")


def write(lines: DataFrame, path: str, key: str, points: str = "points") -> None:
    """A .shp and .shx for each partition, lines in order of their key; written through Hadoop's file system from the driver, file by file."""
    spark = lines.sparkSession
    own = lines.select(key, points).sortWithinPartitions(key)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        all_lines = [[(p["x"], p["y"]) for p in line] for pdf in batches for line in pdf[points]]
        if all_lines:
            shp, shx = encode(all_lines)
            yield pd.DataFrame({"shp": [shp], "shx": [shx]})

    jvm = spark.sparkContext._jvm
    fs_path = jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for k, r in enumerate(own.mapInPandas(each, "shp binary, shx binary").toLocalIterator()):
        for ext, data in (("shp", r.shp), ("shx", r.shx)):
            out = fs.create(fs_path(f"{path}/part-{k:05d}.{ext}"), False)
            try:
                out.write(bytearray(data))
            finally:
                out.close()
