"""Graphs of whole point sets against their definitions over all points."""

import math

import numpy as np
import plain_graphs as planegraph
import pytest

from trackloom.operators import plane_graphs


def frame(spark, xy):
    return spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(xy)], "id long, x double, y double")


def clustered(n=260, seed=3):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.uniform(0, 1000, (n // 2, 2)), rng.normal(700, 4, (n // 2, 2))])


@pytest.mark.parametrize("tile", [20, 10_000])
def test_delaunay_by_tiles(spark, tile):
    xy = clustered()
    got = {(r.a, r.b, r.c) for r in plane_graphs.delaunay(frame(spark, xy), tile).collect()}
    want = planegraph.delaunay(xy)
    assert len(got ^ want) <= 2  # slivers along the hull
    for a, b, c in got:  # no point inside any circle
        mid, r = plane_graphs._circles(xy, np.array([[a, b, c]]))
        assert (np.hypot(*(xy - mid).T) >= r * (1 - 1e-7)).all()


@pytest.mark.parametrize("few", [0, 50_000])
def test_spanning_tree(spark, few):
    xy = clustered()
    df = frame(spark, xy)
    edges = plane_graphs.edges_of(plane_graphs.delaunay(df), df)
    got = plane_graphs.spanning_tree(edges, few).collect()
    want = planegraph.spanning_tree(xy)
    assert {(r.a, r.b) for r in got} == want
    assert sum(r.length for r in got) == pytest.approx(sum(math.dist(xy[a], xy[b]) for a, b in want))
    assert {(r.a, r.b) for r in edges.where("gabriel").collect()} == planegraph.gabriel(xy)


def test_grids_and_repeated_points(spark):
    """Points on common circles: the triangles cover the square once."""
    xy = [(i % 9, i // 9) for i in range(81)] * 2
    got = [(r.a, r.b, r.c) for r in plane_graphs.delaunay(frame(spark, xy), 12).collect()]
    area = [abs((xy[b][0] - xy[a][0]) * (xy[c][1] - xy[a][1]) - (xy[b][1] - xy[a][1]) * (xy[c][0] - xy[a][0])) / 2 for a, b, c in got]
    assert max(max(t) for t in got) < 81 and sum(area) == pytest.approx(64) and {round(v, 6) for v in area if v > 1e-6} == {0.5}
    few = frame(spark, [(0, 0), (1, 1)])
    assert plane_graphs.delaunay(few).collect() == [] and plane_graphs.delaunay(few.limit(0)).collect() == []
    odd = spark.createDataFrame([(1, None, 1.0), (None, 1.0, 1.0), (2, float("nan"), 0.0)], "id long, x double, y double")
    assert plane_graphs.placed(odd).collect() == []


def cell_by_hand(xy, k, box):
    x0, y0, x1, y1 = box
    cell = np.array([[x0, y0], [x1, y0], [x1, y1], [x0, y1]], float)
    for j in range(len(xy)):
        if j != k:
            cell = planegraph.nearer_part(cell, xy[k], xy[j])
    x, y = cell.T
    return abs((x * np.roll(y, -1) - y * np.roll(x, -1)).sum() / 2)


def test_cells_fill_the_box(spark):
    xy, box = clustered(), (-50.0, -20.0, 1100.0, 1010.0)
    got = {r.id: r for r in plane_graphs.voronoi_cells(frame(spark, xy), box, 40).collect()}
    assert sum(r.area for r in got.values()) == pytest.approx(1150 * 1030, rel=1e-6)
    for k in range(0, len(xy), 9):
        assert got[k].area == pytest.approx(cell_by_hand(xy, k, box), rel=1e-4, abs=1e-4)
    two = plane_graphs.voronoi_cells(frame(spark, [(0, 0), (10, 0)]), (-10.0, 0.0, 20.0, 10.0)).collect()
    assert [r.area for r in sorted(two)] == [150.0, 150.0]


def test_relative_neighbours_and_centroids(spark):
    xy = clustered()
    df = frame(spark, xy)
    edges = plane_graphs.edges_of(plane_graphs.delaunay(df), df)
    assert {(r.a, r.b) for r in plane_graphs.relative_neighbours(edges, df).collect()} == planegraph.relative_neighbours(xy)
    germs = df.where("id % 20 = 0")
    got = {r.id: (r.x, r.y) for r in plane_graphs.centroidal(germs, df.withColumnRenamed("id", "sample"), 2, 10.0).collect()}
    want = planegraph.relaxed(xy[::20], xy, 2)
    assert all(got[20 * k] == pytest.approx(tuple(w)) for k, w in enumerate(want)) and len(got) == len(want)
