"""Dividing an area into tiles, and running a pipeline over all of them in one job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def tile_boxes(spark: SparkSession, box: tuple[float, float, float, float], rows: int, cols: int) -> DataFrame:
    """tile, south, west, north, east of a grid of tiles over a box."""
    s, w, n, e = box
    dy, dx = (n - s) / rows, (e - w) / cols
    t = spark.range(rows * cols).withColumnRenamed("id", "tile")
    r, c = F.floor(F.col("tile") / cols), F.col("tile") % cols
    return t.select("tile", (s + r * dy).alias("south"), (w + c * dx).alias("west"), (s + (r + 1) * dy).alias("north"), (w + (c + 1) * dx).alias("east"))


def tile_of(lat: str, lon: str, box: tuple[float, float, float, float], rows: int, cols: int) -> Column:
    """The tile of a place; null outside the box. The upper edges belong to the last tiles."""
    s, w, n, e = box
    r = F.least(F.lit(rows - 1), F.floor((F.col(lat) - s) / ((n - s) / rows)))
    c = F.least(F.lit(cols - 1), F.floor((F.col(lon) - w) / ((e - w) / cols)))
    inside = F.col(lat).between(s, n) & F.col(lon).between(w, e)
    return F.when(inside, r * cols + c).cast("long")


def by_tile(df: DataFrame, box: tuple[float, float, float, float], rows: int, cols: int, steps: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """A pipeline of steps, each keyed by ``tile``, over the rows inside the box: one job for all tiles."""
    out = df.withColumn("tile", tile_of("lat", "lon", box, rows, cols)).where("tile IS NOT NULL")
    for s in steps:
        out = out.transform(s)
    return out
