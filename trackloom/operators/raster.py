"""Sparse rasters: a row for each pixel that isn't zero (row, col, v).

Everything that looks at a pixel's surroundings spreads pixels to their
neighbours and groups by target, so only set pixels cost anything. Iterated
operators (thinning, flood fill) write each round to the checkpoint folder.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions import geo
from trackloom.kernels import raster as kernels


@dataclass(frozen=True)
class Grid:
    """Pixels of a box: rows count down from the north."""

    south: float
    west: float
    per_lat: float  # pixels a degree
    per_lon: float
    height: int

    @staticmethod
    def of(box: tuple[float, float, float, float], cell: float) -> Grid:
        """Grid of a box (south, west, north, east) with cells of so many metres."""
        s, w, n, e = box
        width, height = grid_size(box, cell)
        return Grid(s, w, height / (n - s), width / (e - w), height)

    def row(self, lat) -> Column:
        lat = F.col(lat) if isinstance(lat, str) else lat
        return F.lit(self.height) - F.floor((lat - self.south) * self.per_lat).cast("long")

    def col(self, lon) -> Column:
        lon = F.col(lon) if isinstance(lon, str) else lon
        return F.floor((lon - self.west) * self.per_lon).cast("long")

    def lat(self, row: Column) -> Column:
        return self.south + (self.height - row) / self.per_lat

    def lon(self, col: Column) -> Column:
        return self.west + col / self.per_lon


def metres(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    a, b, c, d = np.radians([lat1, lon1, lat2, lon2])
    h = np.sin((c - a) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin((d - b) / 2) ** 2
    return float(2 * geo.EARTH_RADIUS * np.arctan2(np.sqrt(h), np.sqrt(1 - h)))


def grid_size(box: tuple[float, float, float, float], cell: float) -> tuple[int, int]:
    """Width and height in cells; the width along the north, the height along the east."""
    s, w, n, e = box
    return int(metres(n, w, n, e) / cell), int(metres(s, e, n, e) / cell)


def line_pixels(df: DataFrame, r1: str, c1: str, r2: str, c2: str) -> DataFrame:
    """``df`` exploded to the pixels of an 8-connected line: one for each step along the longer axis, rounded half up."""
    n = F.greatest(F.abs(F.col(r2) - F.col(r1)), F.abs(F.col(c2) - F.col(c1)))
    own = df.withColumn("_n", n).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n"))))
    # floor((2 i d + n) / 2 n) in whole numbers
    at = lambda a, b: F.col(a) + F.when(F.col("_n") == 0, 0).otherwise(F.expr(f"floor((2 * _i * ({b} - {a}) + _n) / (2.0D * _n))")).cast("long")
    return own.withColumn("row", at(r1, r2)).withColumn("col", at(c1, c2)).drop("_n", "_i")


def drawn(steps: DataFrame, trip: str) -> DataFrame:
    """Pixels that each trip touches, once a trip, from steps (r1, c1, r2, c2)."""
    return line_pixels(steps, "r1", "c1", "r2", "c2").select(trip, "row", "col").distinct()


def density(pixels: DataFrame, value: int = 32, most: int = 65535) -> DataFrame:
    """``value`` for each trip on a pixel, saturating; ``pixels`` hold each pixel once a trip."""
    return pixels.groupBy("row", "col").agg(F.least(F.count(F.lit(1)) * value, F.lit(most)).alias("v"))


def kernel(taps: int = 17, sigma: float = 2.9) -> list[float]:
    """Normalised Gaussian weights."""
    x = np.arange(taps) - taps // 2
    w = np.exp(-(x**2) / (2 * sigma**2))
    return (w / w.sum()).tolist()


def blurred(pixels: DataFrame, taps: int = 17, sigma: float = 2.9) -> DataFrame:
    """Separable Gaussian blur of (row, col, v): along rows, then along columns; values are doubles."""
    weights = F.array(*[F.struct(F.lit(k - taps // 2).cast("long").alias("o"), F.lit(w).alias("w")) for k, w in enumerate(kernel(taps, sigma))])
    out = pixels.select("row", "col", F.col("v").cast("double").alias("v"))
    for axis in ("row", "col"):
        spread = out.withColumn("_k", F.explode(weights)).withColumn(axis, F.col(axis) + F.col("_k.o"))
        out = spread.groupBy("row", "col").agg(F.sum(F.col("v") * F.col("_k.w")).alias("v"))
    return out


def disc(radius: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if i * i + j * j <= radius * radius]


def _spread(pixels: DataFrame, offsets: list[tuple[int, int]], sign: int = 1) -> DataFrame:
    at = F.array(*[F.struct(F.lit(sign * i).cast("long").alias("i"), F.lit(sign * j).cast("long").alias("j")) for i, j in offsets])
    return pixels.withColumn("_o", F.explode(at)).withColumn("row", F.col("row") + F.col("_o.i")).withColumn("col", F.col("col") + F.col("_o.j")).drop("_o")


def dilated(pixels: DataFrame, radius: int) -> DataFrame:
    return _spread(pixels, disc(radius)).groupBy("row", "col").agg(F.max("v").alias("v"))


def eroded(pixels: DataFrame, radius: int) -> DataFrame:
    """Smallest value under a disc; pixels whose disc isn't wholly set are zero and go."""
    offsets = disc(radius)
    got = _spread(pixels, offsets, -1).groupBy("row", "col").agg(F.min("v").alias("v"), F.count(F.lit(1)).alias("_n"))
    return got.where(F.col("_n") == len(offsets)).drop("_n")


def closed(pixels: DataFrame, radius: int) -> DataFrame:
    """Grey closing."""
    return eroded(dilated(pixels, radius), radius)


NEIGHBOURS = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]


def neighbour_counts(pixels: DataFrame) -> DataFrame:
    """How many of each pixel's eight neighbours are set: row, col, n."""
    ones = _spread(pixels.select("row", "col"), NEIGHBOURS).groupBy("row", "col").agg(F.count(F.lit(1)).alias("n"))
    return pixels.select("row", "col").join(ones, ["row", "col"], "left").na.fill(0, ["n"])


def without_pools(pixels: DataFrame, most: int = 6) -> DataFrame:
    """Pixels with at most so many set neighbours, judged all at once."""
    solid = neighbour_counts(pixels).where(F.col("n") > most)
    return pixels.join(solid.select("row", "col"), ["row", "col"], "left_anti")


def tiled(pixels: DataFrame, size: int, halo: int) -> DataFrame:
    """Pixels dealt to square tiles, with copies for the tiles whose halo they are in: tile_r, tile_c, own."""
    near = lambda c: F.sequence(F.floor((F.col(c) - halo) / size), F.floor((F.col(c) + halo) / size))
    out = pixels.withColumn("tile_r", F.explode(near("row"))).withColumn("tile_c", F.explode(near("col")))
    return out.withColumn("own", (F.floor(F.col("row") / size) == F.col("tile_r")) & (F.floor(F.col("col") / size) == F.col("tile_c")))


def thinned(pixels: DataFrame, size: int = 512, rounds: int = 8) -> DataFrame:
    """Zhang-Suen thinning to convergence: set pixels (row, col) that remain.

    A tile with a halo of 2 * ``rounds`` is thinned ``rounds`` rounds on its own,
    which is exact for its inner pixels since each sub-iteration looks one pixel
    further; tiles then exchange their halos. It ends when no tile changes, which it
    must, since pixels only go. Pixels with a true ``kept``, if there is such a column,
    stay.
    """
    fixed = F.col("kept") if "kept" in pixels.columns else F.lit(False)
    state = pixels.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), fixed.alias("kept")).groupBy("row", "col").agg(F.max("kept").alias("kept"))

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf["own"].to_numpy()
        r, c, kept = pdf["row"].to_numpy(), pdf["col"].to_numpy(), pdf["kept"].to_numpy(bool)
        left = kernels.thin(r, c, rounds, kept)
        stay = own & left
        return pd.DataFrame({"row": r[stay], "col": c[stay], "kept": kept[stay], "changed": np.full(int(stay.sum()), bool((own & ~left).any()))})

    while True:
        done = saved(tiled(state, size, 2 * rounds).groupBy("tile_r", "tile_c").applyInPandas(each, "row long, col long, kept boolean, changed boolean"))
        state = done.select("row", "col", "kept")
        if done.where("changed").isEmpty():
            return state.select("row", "col")


def saved(df: DataFrame) -> DataFrame:
    """Checkpointed where the session has a folder for it, else kept as a cached table (a local session)."""
    if df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return df.checkpoint()
    named = df.sparkSession.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        df.sparkSession.sparkContext.setCheckpointDir(named)
        return df.checkpoint()
    return df.cache()


#: Thresholds of the ladder.
LADDER = (256, 128, 64, 32, 16, 15, 14, 13, 12, 11, 10, 9, 8, 7, 6, 5, 4, 3, 2, 1)


def skeleton(dens: DataFrame, levels: tuple[int, ...] = LADDER, radius: int = 1, compat: bool = False) -> DataFrame:
    """Skeleton over a ladder of thresholds, highest first: each level's mask is laid over the skeleton so far, whose pixels stay, and the others are thinned.

    Returns row, col and level, the highest threshold at which a pixel belonged.
    ``compat`` takes every set pixel at every level. A level whose mask is that of the
    level before and that adds no pixel ends the run of such masks, since the next
    would do the same again.
    """
    grey = saved(closed(dens, radius))
    sizes = grey.agg(*[F.count_if(F.lit(True) if compat else F.col("v") >= t).alias(f"n{t}") for t in levels]).first()
    state, at, before, still = None, None, None, False
    for t in sorted(levels, reverse=True):
        n = sizes[f"n{t}"]
        if n == before and still:
            continue
        mask = grey.select("row", "col") if compat else grey.where(F.col("v") >= t).select("row", "col")
        if state is None:
            thin = without_pools(thinned(mask))
            state = saved(thin.withColumn("level", F.lit(t)))
            at = state.count()
        else:
            both = mask.join(state.select("row", "col", F.lit(True).alias("kept")), ["row", "col"], "full").na.fill(False, ["kept"])
            thin = thinned(both).join(state, ["row", "col"], "left")
            fresh = thin.where("level IS NULL").select("row", "col")
            solid = neighbour_counts(thin.select("row", "col")).where("n > 6").select("row", "col")
            state = saved(state.unionByName(fresh.join(solid, ["row", "col"], "left_anti").withColumn("level", F.lit(t))))
            now = state.count()
            still, at = now == at, now
        before = n
    return state


def crossings(pixels: DataFrame) -> DataFrame:
    """Each pixel's kind by its 5 x 5 surroundings: path, crossing, or noise, with n, the number of branches.

    A cell of the outer ring counts if it is set and touches a set cell of the inner
    ring; branches are runs of such cells around the ring.
    """
    around = [(i, j) for i in range(-2, 3) for j in range(-2, 3) if i or j]
    bits = F.array(*[F.struct(F.lit(-i).cast("long").alias("i"), F.lit(-j).cast("long").alias("j"), F.lit(1 << k).cast("long").alias("b")) for k, (i, j) in enumerate(around)])
    own = pixels.select("row", "col")
    masks = own.withColumn("_o", F.explode(bits)).withColumn("row", F.col("row") + F.col("_o.i")).withColumn("col", F.col("col") + F.col("_o.j")).groupBy("row", "col").agg(F.sum("_o.b").alias("m"))
    joined = own.join(masks, ["row", "col"], "left").na.fill(0, ["m"])
    place = {o: k for k, o in enumerate(around)}
    ring = kernels.outer_ring()
    cells = []
    for i, j in ring:
        touch = [place[(a, b)] for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and max(abs(a - i), abs(b - j)) == 1]
        inner = sum(1 << t for t in touch)
        cells.append(f"IF((m & {1 << place[(i, j)]}) != 0 AND (m & {inner}) != 0, 1, 0)")
    turns = " + ".join(f"IF({cells[k - 1]} = 0 AND {cells[k]} = 1, 1, 0)" for k in range(len(cells)))
    n = joined.withColumn("n", F.expr(turns).cast("long"))
    return n.select("row", "col", "n", F.when(F.col("n") == 0, "noise").when(F.col("n") == 2, "path").otherwise("crossing").alias("kind"))


def blobs(pixels: DataFrame) -> DataFrame:
    """8-connected components: row, col, blob (the smallest row * 2**31 + col of the component)."""
    from trackloom.operators.graph import components

    key = F.col("row") * F.lit(1 << 31) + F.col("col")
    own = pixels.select("row", "col", key.alias("id"))
    half = [(0, 1), (1, -1), (1, 0), (1, 1)]
    moved = _spread(own.select("row", "col", F.col("id").alias("other")), half)
    pairs = own.join(moved, ["row", "col"]).select(F.col("other").alias("a"), F.col("id").alias("b"))
    roots = components(pairs)
    return own.join(roots, own.id == roots.node, "left").select("row", "col", F.coalesce("root", "id").alias("blob"))


def centres(labelled: DataFrame) -> DataFrame:
    """Mean place of each blob."""
    return labelled.groupBy("blob").agg(F.avg("row").alias("row"), F.avg("col").alias("col"), F.count(F.lit(1)).alias("n"))


def traced(kinds: DataFrame) -> DataFrame:
    """Paths between crossings: for each component of path pixels its pixels in order, and the crossings at both ends.

    kinds: row, col, kind. Returns path, ends (blobs of crossing pixels, one or two), pixels (array of row, col in order).
    """
    kinds = saved(kinds.select("row", "col", "kind"))
    nodes = blobs(kinds.where("kind = 'crossing'"))
    paths = blobs(kinds.where("kind = 'path'"))
    near = _spread(nodes.select("row", "col", F.col("blob").alias("node")), NEIGHBOURS)
    touching = paths.join(near, ["row", "col"]).groupBy("blob", "row", "col").agg(F.min("node").alias("node"))
    own = paths.join(touching, ["blob", "row", "col"], "left")

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        order = kernels.chain(pdf["row"].to_numpy(), pdf["col"].to_numpy(), pdf["node"].notna().to_numpy())
        pdf = pdf.iloc[order]
        ends = list(dict.fromkeys(int(x) for x in (pdf["node"].iloc[0], pdf["node"].iloc[-1]) if pd.notna(x)))
        return pd.DataFrame({"path": [int(pdf["blob"].iloc[0])], "ends": [ends], "pixels": [[{"row": int(a), "col": int(b)} for a, b in zip(pdf["row"], pdf["col"], strict=True)]]})

    return own.groupBy("blob").applyInPandas(each, "path long, ends array<long>, pixels array<struct<row:long,col:long>>")


def vectorised(kinds: DataFrame, levels: DataFrame | None = None, tolerance: float = 10.0) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, row, col) and segments (segment, source, target, weight, points) of a skeleton, each segment both ways.

    The weight is the mean level of a path's pixels. Points are simplified.
    """
    from trackloom.operators.geometry import simplify

    nodes = centres(blobs(kinds.where("kind = 'crossing'"))).select(F.col("blob").alias("node"), "row", "col")
    paths = traced(kinds).where(F.size("ends") > 0)
    lines = paths.select("path", "ends", F.transform("pixels", lambda p: F.struct(p["col"].cast("double").alias("x"), p["row"].cast("double").alias("y"))).alias("points"))
    lines = simplify(lines, tolerance)
    if levels is not None:
        each = paths.select("path", F.explode("pixels").alias("p")).select("path", "p.row", "p.col").join(levels, ["row", "col"]).groupBy("path").agg(F.avg("level").alias("weight"))
        lines = lines.join(each, "path", "left")
    else:
        lines = lines.withColumn("weight", F.lit(1.0))
    out = lines.select("path", F.element_at("ends", 1).alias("source"), F.element_at("ends", -1).alias("target"), "weight", "points")
    back = out.select("path", F.col("target").alias("source"), F.col("source").alias("target"), "weight", F.reverse("points").alias("points"))
    whole = out.withColumn("way", F.lit(0)).unionByName(back.withColumn("way", F.lit(1)))
    return nodes, whole.select((F.col("path") * 2 + F.col("way")).alias("segment"), "source", "target", "weight", "points")
