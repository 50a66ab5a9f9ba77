"""Plane geometry against definitions and hand-computed values."""

import math

import numpy as np
import plain_graphs as g
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trackloom.functions import plane
from trackloom.kernels.curves import pairwise

POINTS = st.lists(st.tuples(st.integers(-50, 50), st.integers(-50, 50)), min_size=4, max_size=14, unique=True).map(lambda p: np.array(p, float) + np.arange(2 * len(p)).reshape(-1, 2) ** 2 * 1e-4)


def test_columns(spark):
    p = plane.point
    square = F.array(p(0, 0), p(4, 0), p(4, 2), p(0, 2))
    got = spark.range(1).select(
        plane.signed_area(square).alias("area"),
        plane.perimeter(square).alias("round"),
        plane.polygon_centroid(square).alias("mid"),
        plane.inside_polygon(p(1, 1), square).alias("inside"),
        plane.inside_polygon(p(5, 1), square).alias("outside"),
        plane.circumcircle(p(0, 0), p(2, 0), p(0, 2)).alias("circle"),
        plane.circumcircle(p(0, 0), p(1, 0), p(2, 0)).alias("none"),
        plane.meeting(plane.line(p(0, 0), p(1, 1)), plane.line(p(0, 2), p(1, 1))).alias("meet"),
        plane.line_distance(p(1, -3), plane.line(p(0, 0), p(5, 0))).alias("off"),
        plane.edge_distance(p(7, 4), plane.edge(p(0, 0), p(4, 0))).alias("away"),
        plane.clipped_edge(plane.edge(p(-2, 1), p(6, 1)), (0, 4, 0, 2)).alias("clip"),
        plane.clipped_edge(plane.edge(p(-2, 5), p(6, 5)), (0, 4, 0, 2)).alias("gone"),
        plane.angle_difference(0.1, 6.2).alias("turn"),
        plane.angle_between(p(1, 0), p(0, 0), p(0, 1)).alias("angle"),
        plane.transformed(p(1, 0), plane.rotation(math.pi / 2, (0, 0))).alias("rot"),
        plane.circle_crossings(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(5.0).alias("r")), F.struct(F.lit(6.0).alias("x"), F.lit(0.0).alias("y"), F.lit(5.0).alias("r"))).alias("two"),
        F.size(plane.circle_polygon(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("r")), 8)).alias("eight"),
        plane.box_overlap(plane.bounds(square), plane.bounds(F.array(p(3, 1), p(9, 9)))).alias("both"),
        plane.is_ccw(p(0, 0), p(1, 0), p(2, 0)).alias("flat"),
    ).first()
    assert (got.area, got.round, tuple(got.mid), got.inside, got.outside) == (8, 12, (2, 1), True, False)
    assert tuple(got.circle) == pytest.approx((1, 1, math.sqrt(2))) and got.none is None and tuple(got.meet) == (1, 1)
    assert got.off == 3 and got.away == 5 and tuple(got.clip) == (0, 1, 4, 1) and got.gone is None
    assert got.turn == pytest.approx(6.1 - 2 * math.pi) and got.angle == pytest.approx(math.pi / 2) and tuple(got.rot) == pytest.approx((0, 1))
    assert [tuple(q) for q in got.two] == [(3, 4), (3, -4)] and got.eight == 8 and tuple(got.both) == (3, 4, 1, 2) and got.flat == 0


@settings(max_examples=40, deadline=None)
@given(POINTS)
def test_graphs(xy):
    n, d = len(xy), pairwise(xy, xy)
    tri = g.delaunay(xy)
    for t in tri:  # no point inside a triangle's circle
        c = g.voronoi_vertices(xy).get(t)
        if c is not None:
            r = math.dist(c, xy[t[0]])
            assert (np.hypot(*(xy - np.array(c)).T) >= r * (1 - 1e-6)).all()
    tree = g.spanning_tree(xy)
    assert len(tree) == n - 1 and (g.hop_distances(n, tree, 0) >= 0).all()
    want = {(i, j) for i in range(n) for j in range(i + 1, n) if not any(d[i, k] ** 2 + d[j, k] ** 2 < d[i, j] ** 2 * (1 - 1e-12) for k in range(n) if k not in (i, j))}
    assert g.gabriel(xy) == want & g.triangle_edges(tri) and g.relative_neighbours(xy) <= g.gabriel(xy)
    assert all(len({b for e in g.nearest_graph(xy, 2) if i in e for b in e} - {i}) >= 2 for i in range(n))


def test_rest():
    assert g.clipped_polygon(np.array([[-1.0, -1], [3, -1], [3, 3], [-1, 3]]), np.array([[0.0, 0], [2, 0], [2, 2], [0, 2]])).shape == (4, 2)
    assert g.spread_labels(np.array([0, 5, 1]), {(0, 1), (1, 2)}, "dilate").tolist() == [5, 5, 5]
    assert g.spread_labels(np.array([0, 5, 1]), {(0, 1)}, "erode").tolist() == [0, 0, 1]
    assert g.relaxed(np.array([[0.0, 0], [10, 0]]), np.array([[1.0, 1], [-1, -1], [9, 0], [13, 0]])).tolist() == [[0, 0], [11, 0]]
