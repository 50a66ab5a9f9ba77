"""Operators on tables larger than those at hand: dense places, copies under other ids, many prefixes of an order."""

import random

import numpy as np
import pytest

from trackloom.functions import geo
from trackloom.kernels import cluster as cluster_kernels
from trackloom.kernels import curves, freespace, planegraph
from trackloom.operators import aggregates, cluster, geometry, joins, plane_graphs


def test_turns_in_many_prefixes(spark, monkeypatch):
    """Copies of turns under other ids, few pairs held at a time."""
    from tests.test_whole_inputs import place_by_hand

    rnd = random.Random(6)
    once = [(rnd.uniform(0, 400), rnd.uniform(0, 400), float(rnd.randrange(360)), float(rnd.randrange(360)), rnd.uniform(20, 80)) for _ in range(120)]
    rows = [(i, *once[i % 120]) for i in range(360)]
    df = spark.createDataFrame(rows, "id long, x double, y double, heading_in double, heading_out double, extent double")
    held = []
    plain = joins.first_come_near
    monkeypatch.setattr(joins, "first_come_near", lambda own, near: plain(own, lambda a, b: held.append(1) or near(a, b), 12, 5))
    blocks = cluster._crossings
    monkeypatch.setattr(cluster, "_crossings", lambda own, about: blocks(own, about, 4))
    got = sorted((r.n, r.crossings, round(r.x, 5), round(r.y, 5)) for r in cluster.intersections(df).collect())
    a = np.array(rows)
    label = cluster_kernels.turn_clusters(a[:, 1:3], a[:, 3], a[:, 4], a[:, 5])
    assert got == sorted(place_by_hand(a[label == k]) for k in set(label.tolist()))
    assert len(held) >= 6 and max(r[0] for r in got) > 6


def test_points_thinned_in_many_prefixes(spark, monkeypatch):
    rnd = random.Random(8)
    once = [(rnd.uniform(0, 500), rnd.uniform(0, 500), rnd.uniform(0, 360)) for _ in range(150)]
    rows = [(i, *once[i % 150]) for i in range(450)]
    df = spark.createDataFrame(rows, "id long, x double, y double, bearing double")
    taken, plain = [], joins.first_come_near
    monkeypatch.setattr(joins, "first_come_near", lambda own, near: taken.append(own.count()) or plain(own, near, 40, 30))
    ids, xy, bearing = np.array([r[0] for r in rows]), np.array([r[1:3] for r in rows]), np.array([r[3] for r in rows])
    order = np.argsort((ids * 2654435761) % 2**32, kind="stable")
    assert sorted(r.id for r in cluster.thinned(df, 60.0, 40.0).collect()) == sorted(cluster_kernels.representatives(xy, bearing, order, 60.0, 40.0).tolist())
    assert taken == [150]


def test_no_crossing_from_one_place(spark):
    """Places in columns, since a crossing of literals is folded."""
    df = spark.createDataFrame([(1, 10.0, 10.0, 0.0, 10.0, 10.0, 90.0), (2, 10.0, 10.0, 45.0, 10.0, 11.0, 315.0)], "id long, a double, b double, c double, d double, e double, f double")
    got = {r.id: r.m for r in df.select("id", geo.great_circle_crossing(*"abcdef").alias("m")).collect()}
    assert got[1] is None and 10.4 < got[2].lat < 10.6


def test_sums_at_the_bound_whatever_the_order(spark):
    """Lists of tenths, as products of hundredths and ten, that sum to 4.5, 4.4 and 0, in many orders."""
    rnd = random.Random(4)
    sums = {0: [0.07, 0.09, 0.1, 0.1, 0.06, 0.03], 1: [0.07, 0.09, 0.1, 0.1, 0.06, 0.02], 2: [0.0, 0.0]}
    rows, below = [], set()
    for i in range(300):
        own = [x * 10 for x in sums[i % 3]]
        rnd.shuffle(own)
        total = 0.0
        for n, x in enumerate(own):
            rows.append((i, n, x))
            total += x
        below |= {i} if i % 3 == 0 and total < 4.5 else set()
    df = spark.createDataFrame(rows, "id long, n long, ep double")
    assert below and {r.id for r in aggregates.unmatched_ids(df, "id", "ep", 9, 0.5).collect()} == {i for i in range(300) if i % 3 == 1}


def test_lines_come_out_in_small_batches(spark):
    """Lines of any length, empty and null ones too, in order within a batch and each whole."""
    rnd = random.Random(3)
    lines = [(i, None if i == 7 else [(rnd.uniform(0, 300), rnd.uniform(0, 300)) for _ in range(rnd.choice((0, 1, 2, 40)))]) for i in range(30)]
    df = spark.createDataFrame(lines, "route long, points array<struct<x:double,y:double>>").coalesce(1)
    got = {r.route: r.points for r in geometry.on_lines(df, "points", lambda xy: curves.smoothed(xy, 30.0), 100).collect()}
    assert got[7] is None and len(got) == 30
    for i, p in lines:
        if p is not None:
            assert np.allclose([(q.x, q.y) for q in got[i]] or np.zeros((0, 2)), curves.smoothed(np.array(p, float).reshape(-1, 2), 30.0))


def random_lines(seed, n):
    """Edges of a grid with gaps, and lines over it of 1 to 7 points, still and far ones too."""
    from tests.test_whole_inputs import street_grid

    rnd = random.Random(seed)
    segs = np.array([[s, t, *xy] for _, s, t, _, *xy in street_grid(6, seed=seed, share=rnd.choice((0.5, 0.7, 0.95)))], float)
    lines = []
    for _ in range(n):
        x, y, step = rnd.uniform(0, 600) + rnd.choice((0, 0, 30, 300, 5000)), rnd.uniform(0, 600), rnd.choice((0, 20, 90))
        lines.append(np.array([(x + step * k + rnd.uniform(-20, 20), y + rnd.uniform(-20, 20)) for k in range(rnd.choice((1, 2, 3, 4, 7)))]))
    return segs, [*lines, np.array([(5.0, 5.0), (5.0, 5.0), (40.0, 5.0)])]


@pytest.mark.parametrize("kind", ["frechet", "hausdorff"])
def test_distances_of_many_lines(kind):
    for seed in range(3):
        segs, lines = random_lines(seed, 40)
        for most in (1, 50, 400):
            assert freespace.least_distances(lines, segs, kind, most) == [freespace.least_distance(xy, segs, kind, most) for xy in lines]


def test_a_longer_reach_has_the_walks_of_a_shorter_one():
    """A walk may come to a node only when the path is near it for the second time."""
    for seed in (1, 5, 10):
        segs, lines = random_lines(seed, 40)
        for xy in lines:
            if len(xy) > 1:
                does = [freespace.has_walk(xy, segs, float(eps)) for eps in range(30, 100, 5)]
                assert does == sorted(does)


def test_dense_clusters_without_their_pairs(spark, monkeypatch):
    """Copies of places, dense cells and lone points, against one run; pairs are aggregated, so none is handed to components but one for two cells."""
    from trackloom.operators import graph

    rnd = random.Random(10)
    once = [(rnd.gauss(0, 60), rnd.gauss(0, 60), rnd.uniform(0, 360)) for _ in range(220)] + [(rnd.uniform(-400, 400), rnd.uniform(-400, 400), rnd.uniform(0, 360)) for _ in range(120)]
    rows = [(i, *p) for i, p in enumerate(once + once[:200] + once[:90])]
    df = spark.createDataFrame([*rows, (9999, None, 1.0, 2.0)], "id long, x double, y double, bearing double")
    linked, plain = [], graph.components
    monkeypatch.setattr(graph, "components", lambda pairs: linked.append(pairs.count()) or plain(pairs))
    for reach, turn, least in ((45.0, 50.0, 3), (25.0, 20.0, 4)):
        got = {r.id: r.cluster for r in cluster.density_clusters(df, reach, turn, least).collect()}
        near = [[j for j, x, y, b in rows if np.sqrt((x - u) ** 2 + (y - v) ** 2) <= reach and min(abs(b - d) % 360, 360 - abs(b - d) % 360) <= turn] for _, u, v, d in rows]
        core = {i for i, n in enumerate(near) if len(n) >= least}
        root = {i: i for i in core}
        while (new := {i: min(root[j] for j in near[i] if j in core) for i in core}) != root:
            root = new
        want = {i: min((root[j] for j in n if j in core), default=-1) for i, n in enumerate(near)} | {9999: -1}
        assert got == want and -1 in want.values() and len(set(want.values())) > 3
        assert linked[-1] < sum(map(len, near)) / 8


@pytest.mark.parametrize("k", [1, 3])
def test_nearest_in_dense_cells(spark, monkeypatch, k):
    """Many rows and copies in a cell of the first size: few of them are met."""
    rnd = random.Random(k)
    left = [(i, rnd.gauss(0, 5), rnd.gauss(0, 5)) for i in range(200)]
    right = [(i, rnd.gauss(0, 5), rnd.gauss(0, 5)) for i in range(500)]
    right += [(500 + i, *right[7][1:]) for i in range(300)]
    met, plain = [], joins.within_distance
    monkeypatch.setattr(joins, "within_distance", lambda *a: met.append(plain(*a)) or met[-1])
    got = joins.nearest(spark.createDataFrame(left, "i long, x double, y double"), spark.createDataFrame(right, "j long, u double, v double"), "i", "j", ("x", "y"), ("u", "v"), 16.0, k).collect()
    want = sorted((i, j, n + 1) for i, x, y in left for n, (_, j) in enumerate(sorted((np.sqrt((u - x) ** 2 + (v - y) ** 2), j) for j, u, v in right)[:k]))
    assert sorted((r.i, r.j, r["rank"]) for r in got) == want
    assert sum(m.count() for m in met) < 200 * 800 / 3


def test_no_tile_triangulates_all_points(spark, monkeypatch):
    """Dense in the middle, with a hull far out whose circles go over most of the box."""
    from types import SimpleNamespace

    rnd = random.Random(15)
    rows = [(i, rnd.gauss(0, 10), rnd.gauss(0, 10)) for i in range(1200)]
    plain = planegraph.delaunay
    df = spark.createDataFrame(rows, "id long, x double, y double")

    def few(xy):
        if len(xy) > 800:
            raise ValueError(f"{len(xy)} points in a tile")
        return plain(xy)

    monkeypatch.setattr(plane_graphs, "planegraph", SimpleNamespace(delaunay=few))
    got = {(t.a, t.b, t.c) for t in plane_graphs.delaunay(df, 60).collect()}
    assert got == plain(np.array([r[1:] for r in rows]))
