"""Plane geometry and graphs over points."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions import plane
from trackloom.kernels import curves
from trackloom.operators import geometry
from trackloom.operators import plane_graphs as plane_graphs_of
from trackloom.plans.registry import query
from trackloom.plans.relations import micro, points2d, sql, u

TRIPLES = ", t AS (SELECT a.id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y, c.x AS cx, c.y AS cy FROM points2d a JOIN points2d b ON b.id = a.id + 1 JOIN points2d c ON c.id = a.id + 2)\n"


def triples(spark, d):
    p = points2d(spark, d)
    at = lambda k, n: p.select((F.col("id") - k).alias("id"), plane.point(F.col("x"), F.col("y")).alias(n))
    return at(0, "a").join(at(1, "b"), "id").join(at(2, "c"), "id")


AREA = "((ax * b_y - ay * bx + bx * cy - b_y * cx + cx * ay - cy * ax) / 2)"


@query("GE-23", sql("points2d", TRIPLES + f"SELECT id, {u(AREA)} AS area, {u('((ax + bx) * (ax * b_y - ay * bx) + (bx + cx) * (bx * cy - b_y * cx) + (cx + ax) * (cx * ay - cy * ax)) / (6 * ' + AREA + ')')} AS cx, CASE WHEN (bx - ax) * (cy - ay) - (b_y - ay) * (cx - ax) > 0 THEN 1 ELSE -1 END AS turn, {u('((cx - ax) * (b_y - ay) - (cy - ay) * (bx - ax)) / sqrt((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay))')} AS off, {u('least(ax, bx, cx)')} AS x0, {u('greatest(ay, b_y, cy)')} AS y1 FROM t WHERE abs({AREA}) > 0.5e0"))
def plane_functions(spark, d):
    own = triples(spark, d).withColumn("poly", F.array("a", "b", "c")).withColumn("s", plane.signed_area(F.col("poly"))).where(F.abs("s") > 0.5)
    a, b, c, poly = (F.col(x) for x in ("a", "b", "c", "poly"))
    return own.select("id", micro(F.col("s")).alias("area"), micro(plane.polygon_centroid(poly)["x"]).alias("cx"), plane.is_ccw(a, b, c).alias("turn"), micro(plane.line_distance(c, plane.line(a, b))).alias("off"), micro(plane.bounds(poly)["x0"]).alias("x0"), micro(plane.bounds(poly)["y1"]).alias("y1"))


PLANE = ", pt AS (SELECT min(id) AS id, x, y FROM points2d GROUP BY x, y), pr AS (SELECT a.id AS a, b.id AS b, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS length FROM pt a JOIN pt b ON a.id < b.id)"
#: The circles through a and b have their centres on a line; each other point rules out all beyond one place on it.
EMPTY = ", ct AS (SELECT pr.a, pr.b, (bx - ax) * (c.y - ay) - (b_y - ay) * (c.x - ax) AS side, (c.x - ax) * (c.x - bx) + (c.y - ay) * (c.y - b_y) AS dot FROM pr JOIN pt c ON c.id <> pr.a AND c.id <> pr.b), de AS (SELECT a, b, bool_and(dot >= 0) AS gabriel FROM ct GROUP BY a, b HAVING coalesce(max(-dot / side) FILTER (side > 0), -1e300) <= coalesce(min(-dot / side) FILTER (side < 0), 1e300))\n"


@query("GR-17", sql("points2d", PLANE + EMPTY + f"SELECT a, b, gabriel, {u('length')} AS length FROM de JOIN pr USING (a, b)"))
def plane_graphs(spark, d):
    """Delaunay edges of all points, marked where they are in the Gabriel graph."""
    own = plane_graphs_of.placed(points2d(spark, d))
    got = plane_graphs_of.edges_of(plane_graphs_of.delaunay(own), own)
    return got.select("a", "b", "gabriel", micro(F.col("length")).alias("length"))


@query("GR-17-tree")
def whole_tree(spark, d):
    """The minimum spanning tree of all points."""
    own = plane_graphs_of.placed(points2d(spark, d))
    got = plane_graphs_of.spanning_tree(plane_graphs_of.edges_of(plane_graphs_of.delaunay(own), own))
    return got.select("a", "b", micro(F.col("length")).alias("length"))


@query("GR-17-relative", sql("points2d", PLANE + f"\nSELECT a, b, {u('length')} AS length FROM pr WHERE NOT EXISTS (SELECT 1 FROM pt c WHERE c.id <> a AND c.id <> b AND sqrt((c.x - ax) * (c.x - ax) + (c.y - ay) * (c.y - ay)) < length * (1 - 1e-12) AND sqrt((c.x - bx) * (c.x - bx) + (c.y - b_y) * (c.y - b_y)) < length * (1 - 1e-12))"))
def relative_graph(spark, d):
    """Pairs of points with no third one closer to both."""
    own = plane_graphs_of.placed(points2d(spark, d))
    got = plane_graphs_of.relative_neighbours(plane_graphs_of.edges_of(plane_graphs_of.delaunay(own), own), own)
    return got.select("a", "b", micro(F.col("length")).alias("length"))


@query("GR-17-cells")
def cells(spark, d):
    """Voronoi cells of all points in a box that holds them."""
    got = plane_graphs_of.voronoi_cells(points2d(spark, d), (-100.0, -100.0, 100.0, 100.0))
    return got.select("id", F.size("corners").cast("long").alias("corners"), micro(F.col("area")).alias("area"))


@query("GR-17-centroidal", sql("points2d", ", g AS (SELECT id, x, y FROM points2d WHERE grp = 0), r AS (SELECT p.id AS s, p.x, p.y, g.id FROM points2d p JOIN g ON true QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY sqrt((p.x - g.x) * (p.x - g.x) + (p.y - g.y) * (p.y - g.y)), g.id) = 1), h AS (SELECT g.id, coalesce(avg(r.x), any_value(g.x)) AS x, coalesce(avg(r.y), any_value(g.y)) AS y FROM g LEFT JOIN r ON r.id = g.id GROUP BY g.id)\n" + f"SELECT id, {u('x')} AS x, {u('y')} AS y FROM h"))
def centroidal_round(spark, d):
    """A round of centroidal tessellation: the points of one group move to the mean of all points nearest to them."""
    own = points2d(spark, d)
    got = plane_graphs_of.centroidal(own.where("grp = 0"), own.withColumnRenamed("id", "sample"), 1, 4.0)
    return got.select("id", micro(F.col("x")).alias("x"), micro(F.col("y")).alias("y"))


@query("GE-23-hulls")
def hulls(spark, d):
    got = geometry.grouped_points(geometry.hull_members(points2d(spark, d), "grp"), "grp", curves.hull, "id")
    return got.select("grp", "n", micro(F.col("x")).alias("x"), micro(F.col("y")).alias("y"))
