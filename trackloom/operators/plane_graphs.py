"""Graphs of a whole set of plane points: Delaunay triangles, Gabriel graph, minimum spanning tree.

The triangulation goes by tiles of about ``TILE`` points each: strips of even numbers by x,
cut into even numbers by y, so dense places have small tiles. A tile triangulates its own
points and those within a halo; a triangle holds for all points if the part of its
circumcircle inside the box of all points lies inside the tile's widened box, or if a join finds no
point inside the circle. Tiles with own points in triangles that don't hold yet add, of the points
inside a circle, those that see a side under the widest angle, in rounds. The corners of the
convex hull, found from hulls of Arrow batches, belong to every tile, so that no tile takes
its own edge for the edge of the whole.

Points equal in place are one, with the smallest id. Places are shifted by up to 1e-10 of
the extent, by a hash of the id, so that points on one circle are triangulated alike in all
tiles. Triangles along the hull whose circles are over 10,000 times the extent are left out.
Points without a place take no part.

The tree is found among the Delaunay edges, which hold it: rounds in which every component
takes its lightest outgoing edge, until few edges are left between components for one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.kernels import curves, planegraph
from trackloom.operators import graph
from trackloom.session import written

#: Points of a tile, and edges that one task takes for the last rounds of the tree.
TILE, FEW = 150, 50_000
SHIFT = 1e-10


def placed(points: DataFrame) -> DataFrame:
    """Points (id, x, y), one of each place."""
    there = points.where("x IS NOT NULL AND y IS NOT NULL AND id IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    return there.groupBy("x", "y").agg(F.min("id").alias("id")).select("id", "x", "y")


def hull_corners(points: DataFrame) -> pd.DataFrame:
    """Corners of the convex hull (id, x, y) of points at different places: the hull of the hulls of all batches."""

    def corners(pdf: pd.DataFrame) -> pd.DataFrame:
        xy = pdf[["x", "y"]].to_numpy(float)
        if len(xy) < 4:
            return pdf
        kept = set(map(tuple, curves.hull(xy)))
        return pdf[[tuple(p) in kept for p in xy]]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = None
        for pdf in batches:
            left = corners(pdf if left is None else pd.concat([left, pdf]))
        if left is not None:
            yield left

    return corners(points.select("id", "x", "y").mapInPandas(each, "id long, x double, y double").toPandas())  # a few of each partition


def _circles(xy: np.ndarray, tri: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b, c = (xy[tri[:, k]] for k in range(3))
    b, c = b - a, c - a
    d = 2 * (b[:, 0] * c[:, 1] - b[:, 1] * c[:, 0])
    bb, cc = (b * b).sum(axis=1), (c * c).sum(axis=1)
    u = np.stack([c[:, 1] * bb - b[:, 1] * cc, b[:, 0] * cc - c[:, 0] * bb], axis=1) / d[:, None]
    return a + u, np.hypot(u[:, 0], u[:, 1])


def _holds(mid: np.ndarray, r: np.ndarray, box: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether the part of each circle inside ``box`` lies inside ``known`` (both x0, y0, x1, y1)."""
    ok = np.ones(len(mid), bool)
    for axis in (0, 1):
        other = 1 - axis
        off = np.maximum(0, np.maximum(box[other] - mid[:, other], mid[:, other] - box[2 + other]))
        half = np.sqrt(np.maximum(0, r * r - off * off))
        low, high = np.maximum(box[axis], mid[:, axis] - half), np.minimum(box[2 + axis], mid[:, axis] + half)
        ok &= (low >= known[axis]) & (high <= known[2 + axis])
    return ok


def _below(bounds: Column | str, v: Column) -> Column:
    """How many of the bounds a value has reached."""
    return F.size(F.filter(bounds, lambda b: b <= v))


def delaunay(points: DataFrame, tile: int = TILE) -> DataFrame:
    """Triangles a < b < c of the ids of points (id, x, y)."""
    spark = points.sparkSession
    own = placed(points)
    box = own.agg(F.count(F.lit(1)), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    n, (x0, x1, y0, y1) = box[0], box[1:]
    none = spark.createDataFrame([], "a long, b long, c long")
    if n < 3:
        return none
    extent = max(x1 - x0, y1 - y0)
    move = lambda seed: F.xxhash64("id", F.lit(seed)) / float(1 << 63) * (SHIFT * extent)
    own = written(own.select("id", (F.col("x") + move(1)).alias("x"), (F.col("y") + move(2)).alias("y")), "plane-points")
    whole = [x0 - SHIFT * extent, y0 - SHIFT * extent, x1 + SHIFT * extent, y1 + SHIFT * extent]
    strips = max(1, math.ceil(math.sqrt(n / tile)))
    cuts = lambda k: F.array(*[F.lit(i / k) for i in range(1, k)]) if k > 1 else None
    edges = sorted(set(own.agg(F.percentile_approx("x", cuts(strips), 20 * strips)).first()[0])) if strips > 1 else []
    splits = [-math.inf, *[e for e in edges if whole[0] < e < whole[2]], math.inf]
    strips = len(splits) - 1
    if strips > 1:
        own = Bucketizer(splits=splits, inputCol="x", outputCol="_s").transform(own).withColumn("s", F.col("_s").cast("int")).drop("_s")
    else:
        own = own.withColumn("s", F.lit(0))
    rows = max(1, math.ceil(n / strips / tile))
    bound = F.array_distinct(F.percentile_approx("y", cuts(rows), 20 * rows)) if rows > 1 else F.array().cast("array<double>")
    rows_of = written(own.groupBy("s").agg(bound.alias("yb")), "tile-rows")
    own = written(own.join(rows_of, "s").withColumn("r", _below("yb", F.col("y"))).drop("yb"), "tiled-points")
    at = F.array(*[F.lit(float(v)) for v in [whole[0], *splits[1:-1], whole[2]]])
    tiles = rows_of.select("s", "yb", F.explode(F.sequence(F.lit(0), F.size("yb"))).alias("r"))
    tiles = tiles.select("s", "r", F.get(at, F.col("s")).alias("x0"), F.get(at, F.col("s") + 1).alias("x1"), F.coalesce(F.get("yb", F.col("r") - 1), F.lit(whole[1])).alias("y0"), F.coalesce(F.get("yb", F.col("r")), F.lit(whole[3])).alias("y1"))
    open_ = written(tiles.withColumn("h", F.least(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) / 2), "tiles")
    corners = hull_corners(own)
    sent = spark.sparkContext.broadcast((corners["id"].to_numpy(), corners[["x", "y"]].to_numpy(float), np.array(whole)))

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        more, place, all_ = sent.value
        first = pdf.iloc[0]
        new = ~np.isin(more, pdf["id"].to_numpy())
        ids = np.concatenate([pdf["id"].to_numpy(), more[new]])
        xy = np.concatenate([pdf[["x", "y"]].to_numpy(float), place[new]])
        mine = np.concatenate([pdf["own"].to_numpy(), np.zeros(new.sum(), bool)])
        order = np.argsort(ids)
        ids, xy, mine = ids[order], xy[order], mine[order]
        tri = np.array(sorted(planegraph.delaunay(xy)), int).reshape(-1, 3)
        tri = tri[mine[tri].any(axis=1)] if len(tri) else tri
        known = np.array([first["x0"] - first["h"], first["y0"] - first["h"], first["x1"] + first["h"], first["y1"] + first["h"]])
        mid, radius = _circles(xy, tri) if len(tri) else (np.zeros((0, 2)), np.zeros(0))
        out = pd.DataFrame(np.sort(ids[tri], axis=1) if len(tri) else np.zeros((0, 3), np.int64), columns=["a", "b", "c"])
        ends = {f"{p}{c}": xy[np.sort(tri, axis=1)[:, k], n] if len(tri) else np.zeros(0) for k, p in enumerate("abc") for n, c in enumerate("xy")}
        holds = _holds(mid, radius, all_, known) if len(tri) else np.zeros(0, bool)
        return out.assign(s=int(first["s"]), r=int(first["r"]), holds=holds, mx=mid[:, 0], my=mid[:, 1], radius=radius, **ends)

    filled = written(own.groupBy("s", "r").agg(*[f(c).alias(f"_{c}{n}") for c in "xy" for n, f in ((0, F.min), (1, F.max))]), "tile-boxes")

    def inside_circles(tri: DataFrame) -> DataFrame:
        """Points inside the circles of triangles, from the tiles whose points' box a circle meets; of each triangle those that see a side under the widest angle."""
        low, high = _below(at, F.col("mx") - F.col("radius")) - 1, _below(at, F.col("mx") + F.col("radius")) - 1
        spread = tri.withColumn("_s", F.explode(F.sequence(F.greatest(low, F.lit(0)), F.greatest(F.least(high, F.lit(strips - 1)), F.greatest(low, F.lit(0))))))
        off = lambda c: F.greatest(F.lit(0.0), F.col(f"_{c}0") - F.col(f"m{c}"), F.col(f"m{c}") - F.col(f"_{c}1"))
        met = spread.join(filled.withColumnsRenamed({"s": "_s", "r": "_r"}), "_s").where(F.hypot(off("x"), off("y")) <= F.col("radius"))
        points_in = met.join(own.select(F.col("s").alias("_s"), F.col("r").alias("_r"), "id", "x", "y"), ["_s", "_r"])
        points_in = points_in.where((F.col("id") != F.col("a")) & (F.col("id") != F.col("b")) & (F.col("id") != F.col("c")))
        square = lambda x, y: x * x + y * y
        points_in = points_in.where(square(F.col("x") - F.col("mx"), F.col("y") - F.col("my")) < F.col("radius") * F.col("radius") * (1 - 1e-12))

        def cosine(p: str, q: str) -> Column:
            (px, py), (qx, qy) = ((F.col(f"{k}x") - F.col("x"), F.col(f"{k}y") - F.col("y")) for k in (p, q))
            return (px * qx + py * qy) / (F.hypot(px, py) * F.hypot(qx, qy))

        seen = points_in.groupBy("s", "r", "a", "b", "c").agg(*[F.min(F.struct(cosine(p, q).alias("t"), "id", "x", "y")).alias(p + q) for p, q in ("ab", "ac", "bc")])
        return seen.select("s", "r", "a", "b", "c", F.explode(F.array("ab", "ac", "bc")).alias("p")).select("s", "r", "a", "b", "c", "p.id", "p.x", "p.y")

    found = []
    more = spark.createDataFrame([], "s int, r int, id long, x double, y double")
    while not open_.isEmpty():
        wide = open_.select("s", "r", "x0", "x1", "y0", "y1", "h")
        low, high = _below(at, F.col("x0") - F.col("h")) - 1, _below(at, F.col("x1") + F.col("h")) - 1
        spread = wide.withColumn("_s", F.explode(F.sequence(F.greatest(low, F.lit(0)), F.least(high, F.lit(strips - 1)))))
        met = spread.join(rows_of.withColumnRenamed("s", "_s"), "_s")
        low, high = _below("yb", F.col("y0") - F.col("h")), _below("yb", F.col("y1") + F.col("h"))
        met = met.withColumn("_r", F.explode(F.sequence(low, high))).drop("yb")
        near = met.join(own.withColumnsRenamed({"s": "_s", "r": "_r"}), ["_s", "_r"])
        inside = F.col("x").between(F.col("x0") - F.col("h"), F.col("x1") + F.col("h")) & F.col("y").between(F.col("y0") - F.col("h"), F.col("y1") + F.col("h"))
        is_own = ((F.col("_s") == F.col("s")) & (F.col("_r") == F.col("r"))).alias("own")
        local = near.where(inside).select("s", "r", "x0", "x1", "y0", "y1", "h", "id", "x", "y", is_own)
        added = open_.select("s", "r", "x0", "x1", "y0", "y1", "h").join(more, ["s", "r"]).withColumn("own", F.lit(False)).select(*local.columns)
        local = local.unionByName(added).groupBy("s", "r", "x0", "x1", "y0", "y1", "h", "id", "x", "y").agg(F.max("own").alias("own"))
        got = written(local.groupBy("s", "r").applyInPandas(each, "a long, b long, c long, s int, r int, holds boolean, mx double, my double, radius double, " + ", ".join(f"{p}{c} double" for p in "abc" for c in "xy")), "triangles")
        # a circle that goes beyond what the tile knows holds if no point at all is inside it; those inside are added
        wide = got.where("NOT holds AND NOT isnan(radius) AND radius < double('inf')")
        # what a tile has been given already is inside by rounding alone
        hits = written(inside_circles(wide).join(more.select("s", "r", "id"), ["s", "r", "id"], "left_anti"), "tile-hits")
        found.append(got.where("holds").select("a", "b", "c").unionByName(wide.join(hits.select("s", "r", "a", "b", "c").distinct(), ["s", "r", "a", "b", "c"], "left_anti").select("a", "b", "c")))
        more = written(more.unionByName(hits.select("s", "r", "id", "x", "y")).distinct(), "tile-more")
        open_ = written(open_.join(hits.select("s", "r").distinct(), ["s", "r"]), "tiles")
    out = none
    for f in found:
        out = out.unionByName(f)
    return out.distinct()


def edges_of(triangles: DataFrame, points: DataFrame) -> DataFrame:
    """Edges a < b of triangles with their length and whether the circle over each holds no other point (Gabriel's rule, for which the corners opposite suffice)."""
    sides = F.array(*[F.struct(F.col(p).alias("a"), F.col(q).alias("b"), F.col(o).alias("o")) for p, q, o in (("a", "b", "c"), ("a", "c", "b"), ("b", "c", "a"))])
    own = triangles.select(F.explode(sides).alias("e")).select("e.*")
    for k in "abo":
        own = own.join(points.select(F.col("id").alias(k), F.col("x").alias(f"{k}x"), F.col("y").alias(f"{k}y")), k)
    dot = (F.col("ax") - F.col("ox")) * (F.col("bx") - F.col("ox")) + (F.col("ay") - F.col("oy")) * (F.col("by") - F.col("oy"))
    length = F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"))
    return own.groupBy("a", "b").agg(F.first(length).alias("length"), F.min(dot >= 0).alias("gabriel"))


def spanning_tree(edges: DataFrame, few: int = FEW) -> DataFrame:
    """Minimum spanning forest (a, b, length) of undirected edges; of edges equally long the one with smaller ends comes first."""
    spark = edges.sparkSession
    left = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "length").where("a < b").select("*", F.col("a").alias("p"), F.col("b").alias("q")), "tree-edges")

    def last(pdf: pd.DataFrame) -> pd.DataFrame:
        root: dict[int, int] = {}

        def find(v: int) -> int:
            while root.get(v, v) != v:
                root[v] = root.get(root[v], root[v])
                v = root[v]
            return v

        rows = []
        for a, b, length, p, q in pdf.sort_values(["length", "a", "b"])[["a", "b", "length", "p", "q"]].itertuples(index=False):
            u, v = find(p), find(q)
            if u != v:
                root[max(u, v)] = min(u, v)
                rows.append((a, b, length))
        return pd.DataFrame(rows, columns=["a", "b", "length"])

    out = spark.createDataFrame([], "a long, b long, length double")
    while True:
        n = left.count()
        if n <= few:
            return out if n == 0 else out.unionByName(left.groupBy().applyInPandas(last, "a long, b long, length double"))
        key = F.struct("length", "a", "b", "p", "q")
        ends = left.select(F.col("p").alias("v"), key.alias("e")).unionByName(left.select(F.col("q").alias("v"), key.alias("e")))
        taken = written(ends.groupBy("v").agg(F.min("e").alias("e")).select("e.*").distinct(), "tree-taken")
        out = out.unionByName(taken.select("a", "b", "length"))
        roots = written(graph.components(taken.select(F.col("p").alias("a"), F.col("q").alias("b"))), "tree-roots")
        rooted = lambda k, df: df.join(roots.select(F.col("node").alias(k), F.col("root").alias(f"{k}_")), k).drop(k).withColumnRenamed(f"{k}_", k)
        left = written(rooted("q", rooted("p", left)).where("p != q").select("a", "b", "length", "p", "q"), "tree-edges")


def relative_neighbours(edges: DataFrame, points: DataFrame) -> DataFrame:
    """Those of the Delaunay edges (a, b, length) with no point closer to both ends than they are to each other.

    A point that breaks this for an edge lies within its length of one end; candidates are
    the points in the cells around the edge's middle, of the size of the longest edge of its class.
    """
    place = lambda k: points.select(F.col("id").alias(k), F.col("x").alias(f"{k}x"), F.col("y").alias(f"{k}y"))
    own = edges.select("a", "b", "length").where("gabriel") if "gabriel" in edges.columns else edges.select("a", "b", "length")
    own = own.join(place("a"), "a").join(place("b"), "b").withColumn("level", F.ceil(F.log2("length")).cast("int"))
    size = F.pow(F.lit(2.0), F.col("level"))
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    asked = own.withColumn("_d", around).withColumns({"_cx": F.floor((F.col("ax") + F.col("bx")) / 2 / size) + F.col("_d.i"), "_cy": F.floor((F.col("ay") + F.col("by")) / 2 / size) + F.col("_d.j")})
    levels = own.select("level").distinct()  # one for each doubling of length
    dealt = points.join(F.broadcast(levels)).select("level", F.col("id").alias("c"), F.col("x").alias("cx"), F.col("y").alias("cy"), F.floor(F.col("x") / size).alias("_cx"), F.floor(F.col("y") / size).alias("_cy"))
    met = asked.join(dealt, ["level", "_cx", "_cy"]).where((F.col("c") != F.col("a")) & (F.col("c") != F.col("b")))
    far = F.greatest(F.hypot(F.col("cx") - F.col("ax"), F.col("cy") - F.col("ay")), F.hypot(F.col("cx") - F.col("bx"), F.col("cy") - F.col("by")))
    return edges.join(own.select("a", "b"), ["a", "b"], "left_semi").join(met.where(far < F.col("length") * (1 - 1e-12)).select("a", "b").distinct(), ["a", "b"], "left_anti")


def voronoi_cells(points: DataFrame, box: tuple[float, float, float, float], tile: int = TILE) -> DataFrame:
    """The part of ``box`` (x0, y0, x1, y1) nearest to each point (id, x, y): id, area, corners (array of x, y, anticlockwise).

    A cell is the box cut along the bisectors to the point's Delaunay neighbours alone.
    Points without neighbours, as there are fewer than three, are cut along those to all.
    """
    own = placed(points)
    triangles = written(delaunay(own, tile), "cell-triangles")
    if triangles.isEmpty():  # fewer than three points, or all in a line
        line = own.count()
        if line > 2:
            raise ValueError("points in a line have no triangles")
        pairs = own.select(F.col("id").alias("a")).join(own.select(F.col("id").alias("b"))).where("a != b")
    else:
        sides = triangles.select(F.explode(F.array(*[F.struct(F.col(p).alias("a"), F.col(q).alias("b")) for p in "abc" for q in "abc" if p != q])).alias("e"))
        pairs = sides.select("e.*").distinct()
    other = own.select(F.col("id").alias("b"), "x", "y")
    around = pairs.join(other, "b").groupBy(F.col("a").alias("id")).agg(F.collect_list(F.struct("x", "y")).alias("near"))  # as many as the cell has sides
    sites = own.join(around, "id", "left").select("id", "x", "y", F.coalesce(F.transform("near", lambda p: p["x"]), F.array().cast("array<double>")).alias("nx"), F.coalesce(F.transform("near", lambda p: p["y"]), F.array().cast("array<double>")).alias("ny"))
    x0, y0, x1, y1 = box

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = np.array([[x0, y0], [x1, y0], [x1, y1], [x0, y1]], float)
        for pdf in batches:
            rows = []
            for i, x, y, nx, ny in pdf.itertuples(index=False):
                cell, p = frame, np.array([x, y])
                for q in sorted(zip(nx, ny, strict=True), key=lambda q: math.dist(p, q)):
                    cell = planegraph.nearer_part(cell, p, np.array(q))
                turned = np.roll(cell, -1, axis=0)
                area = float((cell[:, 0] * turned[:, 1] - cell[:, 1] * turned[:, 0]).sum() / 2) if len(cell) > 2 else 0.0
                rows.append((i, area, [{"x": float(u), "y": float(v)} for u, v in cell]))
            yield pd.DataFrame(rows, columns=["id", "area", "corners"])

    return sites.mapInPandas(each, "id long, area double, corners array<struct<x:double,y:double>>")


def centroidal(germs: DataFrame, samples: DataFrame, rounds: int, reach: float) -> DataFrame:
    """Germs (id, x, y) moved, a round at a time, to the mean of the samples (sample, x, y) that are nearest to them; germs without samples stay."""
    from trackloom.operators import joins

    seen = samples.select("sample", F.col("x").alias("sx"), F.col("y").alias("sy"))
    now = written(germs.select("id", "x", "y"), "germs")
    for _ in range(rounds):
        own = joins.nearest(seen, now, "sample", "id", ("sx", "sy"), ("x", "y"), reach).select("sample", "id")
        moved = own.join(seen, "sample").groupBy("id").agg(F.avg("sx").alias("mx"), F.avg("sy").alias("my"))
        now = written(now.join(moved, "id", "left").select("id", F.coalesce("mx", "x").alias("x"), F.coalesce("my", "y").alias("y")), "germs")
    return now
