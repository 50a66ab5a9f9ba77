"""Operators that must not depend on tiles, reaches or levels, against plain versions over everything."""

import math
import random

import numpy as np
import pytest

from trackloom.kernels import cluster as cluster_kernels
from trackloom.kernels import curves, freespace
from trackloom.kernels import raster as raster_kernels
from trackloom.operators import cluster, evaluation, graph, joins, matching, raster, road_trees


def near_by_hand(left, right, k):
    return sorted((i, j, n + 1) for i, x, y in left for n, (_, j) in enumerate(sorted((math.dist((x, y), (u, v)), j) for j, u, v in right)[:k]))


@pytest.mark.parametrize(("n_left", "n_right", "k"), [(60, 40, 2), (5, 1, 2), (30, 3, 7), (20, 0, 1), (0, 20, 1), (40, 200, 1)])
def test_nearest_of_all(spark, n_left, n_right, k):
    """Fewer rows than asked for, rows far from all others, and empty sides."""
    rnd = random.Random(n_left)
    left = [(i, rnd.uniform(0, 100), rnd.uniform(0, 100)) for i in range(n_left)]
    right = [(i, rnd.uniform(0, 100), rnd.uniform(0, 100)) for i in range(n_right)]
    if n_left > 5:
        left += [(1000, 90_000.0, -40_000.0), (1001, -7000.0, 50.0)]
        right += [(2000, 2500.0, 2500.0)] if n_right else []
    a = spark.createDataFrame([*left, (5000, None, 1.0), (5001, float("nan"), 2.0)], "i long, x double, y double")
    got = joins.nearest(a, spark.createDataFrame(right, "j long, u double, v double"), "i", "j", ("x", "y"), ("u", "v"), 1.0, k)
    assert got.columns == ["i", "j", "dist", "rank"]
    assert sorted((r.i, r.j, r["rank"]) for r in got.collect()) == near_by_hand(left, right, k)


def test_ties_go_to_the_smaller_id(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0)], "i long, x double, y double")
    b = spark.createDataFrame([(3, 5.0, 0.0), (2, 0.0, 5.0), (9, -5.0, 0.0)], "j long, u double, v double")
    assert [r.j for r in joins.nearest(a, b, "i", "j", ("x", "y"), ("u", "v"), 1.0, 2).orderBy("rank").collect()] == [2, 3]


def scattered_points(seed, n, side):
    rnd = random.Random(seed)
    return [(i, rnd.uniform(0, side), rnd.uniform(0, side), rnd.uniform(0, 360)) for i in range(n)]


def test_points_are_thinned_as_one(spark):
    rows = scattered_points(3, 400, 500)
    df = spark.createDataFrame(rows, "id long, x double, y double, bearing double")
    ids, xy, bearing = np.array([r[0] for r in rows]), np.array([r[1:3] for r in rows]), np.array([r[3] for r in rows])
    order = np.argsort((ids * 2654435761) % 2**32, kind="stable")
    assert sorted(r.id for r in cluster.thinned(df, 60.0, 40.0).collect()) == sorted(cluster_kernels.representatives(xy, bearing, order, 60.0, 40.0).tolist())


def place_by_hand(members):
    """The mean of the members, of their mean, and of the crossings of their lines near it."""
    mid = members[:, 1:3].mean(axis=0)
    reach = members[:, 5].max()
    lines = [(i, out, m[1:3], (90 - m[3 + out]) % 360) for i, m in enumerate(members) for out in (0, 1)]
    met = []
    for i, o, p, d in lines:
        for j, q, r, e in lines:
            if i < j and (45 if o and q else 25) <= abs(d - e) <= 320:
                u, v = (np.array([np.cos(np.radians(w)), np.sin(np.radians(w))]) for w in (d, e))
                across = u[0] * v[1] - u[1] * v[0]
                if abs(across) > 1e-9:
                    at = p + u * (((r - p)[0] * v[1] - (r - p)[1] * v[0]) / across)
                    if np.hypot(*(at - mid)) <= reach:
                        met.append(at)
    x, y = np.concatenate([[mid], members[:, 1:3], np.array(met).reshape(-1, 2)]).mean(axis=0)
    return len(members), len(met), round(float(x), 5), round(float(y), 5)


def test_turns_are_clustered_as_one(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.uniform(0, 600), rnd.uniform(0, 600), float(rnd.randrange(360)), float(rnd.randrange(360)), rnd.uniform(20, 80)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, x double, y double, heading_in double, heading_out double, extent double")
    a = np.array(rows)
    label = cluster_kernels.turn_clusters(a[:, 1:3], a[:, 3], a[:, 4], a[:, 5])
    want = sorted(place_by_hand(a[label == k]) for k in set(label.tolist()))
    got = sorted((r.n, r.crossings, round(r.x, 5), round(r.y, 5)) for r in cluster.intersections(df).collect())
    assert got == want and sum(r[1] for r in got) > 20


def test_density_clusters_are_those_of_one_run(spark):
    rows = scattered_points(7, 500, 700)
    df = spark.createDataFrame(rows, "id long, x double, y double, bearing double")
    label = cluster_kernels.density_clusters(np.array([r[1:3] for r in rows]), np.array([r[3] for r in rows]), 45.0, 50.0, 3)
    got = {r.id: r.cluster for r in cluster.density_clusters(df, 45.0, 50.0, 3).collect()}
    noise = {i for i, k in enumerate(label.tolist()) if k == -1}
    assert {i for i, k in got.items() if k == -1} == noise and 50 < len(noise) < 450
    # the same parts: numbers of one run go up with the smallest id of the core points
    pairs = {(got[i], int(label[i])) for i in range(500) if i not in noise}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def street_grid(n, step=100.0, seed=1, share=0.85):
    rnd = random.Random(seed)
    place = {i * n + j: (i * step + rnd.uniform(-9, 9), j * step + rnd.uniform(-9, 9)) for i in range(n) for j in range(n)}
    rows = []
    for a, (x, y) in place.items():
        for b in (a + 1 if (a + 1) % n else None, a + n if a + n < n * n else None):
            if b is not None and rnd.random() < share:
                for s, t in ((a, b), (b, a)):
                    rows.append((len(rows), s, t, math.dist(place[s], place[t]), *place[s], *place[t]))
    return rows


EDGES = "edge_id long, source long, target long, length double, ax double, ay double, bx double, by double"


def test_paths_over_tiles(spark):
    rows = street_grid(12)
    heads = {}
    for _, s, t, w, *_ in rows:
        heads.setdefault(s, []).append((t, w))
    rnd = random.Random(2)
    pairs = [(rnd.randrange(144), rnd.randrange(144)) for _ in range(60)] + [(3, 9999), (9999, 3)]
    edges = spark.createDataFrame(rows, EDGES)
    for limit, size in ((900.0, 250.0), (5000.0, 400.0)):
        got = {(r.a, r.b): r for r in graph.paths_within(spark.createDataFrame(pairs, "a long, b long"), edges, limit, size).collect()}
        assert set(got) == set(pairs)
        for a, b in pairs:
            dist, _ = graph.dijkstra(heads, a)
            want = dist.get(b) if a in heads else None
            if want is None or want > limit:
                assert got[(a, b)].dist is None
            else:
                assert got[(a, b)].dist == pytest.approx(want)
                nodes = got[(a, b)].nodes
                assert nodes[0] == a and nodes[-1] == b and sum(dict(heads[u])[v] for u, v in zip(nodes, nodes[1:], strict=False)) == pytest.approx(want)


def test_ways_up_to_a_limit(spark):
    rows = street_grid(8, seed=4)
    heads = {}
    for _, s, t, w, *_ in rows:
        heads.setdefault(s, []).append((t, w))
    got = {(r.source_id, r.node): r.dist for r in graph.shortest_within(spark.createDataFrame(rows, EDGES), spark.createDataFrame([(s,) for s in heads], "node_id long"), 450.0).collect()}
    want = {(s, n): d for s in heads for n, d in graph.dijkstra(heads, s, 450.0)[0].items()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)


def test_walks_over_tiles(spark):
    rows = street_grid(10, seed=6)
    edges = spark.createDataFrame([(s, t, w, *xy) for _, s, t, w, *xy in rows], "source long, target long, length double, x1 double, y1 double, x2 double, y2 double")
    heads, place = {}, {}
    for s, t, w, x, y, u, v in sorted((s, t, w, *xy) for _, s, t, w, *xy in rows):
        heads.setdefault(s, []).append((t, w))
        place[s], place[t] = (x, y), (u, v)
    starts = [0, 37, 99]
    got = graph.walk_points(edges, spark.createDataFrame([(s,) for s in starts], "node_id long"), 350.0, 60.0, 150.0).collect()
    for s in starts:
        want = graph.spread_points(heads, place, s, 350.0, 60.0)
        own = sorted((r.n, r.x, r.y) for r in got if r.start == s)
        assert len(own) == len(want) > 10 and np.allclose(np.array(own)[:, 1:], want)


@pytest.mark.parametrize("kind", ["frechet", "hausdorff"])
def test_path_distances_over_the_whole_graph(spark, kind):
    rows = street_grid(7, seed=8, share=0.7)
    rnd = random.Random(9)
    paths = []
    for p in range(25):
        x, y = rnd.uniform(0, 600), rnd.uniform(0, 600)
        far = rnd.choice((0.0, 30.0, 300.0, 5000.0)) if p > 5 else 0.0
        paths.append((p, [{"x": x + far + 90 * k + rnd.uniform(-20, 20), "y": y + rnd.uniform(-20, 20)} for k in range(4)]))
    segs = np.array([[s, t, *xy] for _, s, t, _, *xy in rows], float)
    df = spark.createDataFrame(paths, "path long, points array<struct<x:double,y:double>>")
    got = {r.path: r.distance for r in evaluation.path_distances(df, spark.createDataFrame(rows, EDGES), kind, 1600, 150.0).collect()}
    want = {p: freespace.least_distance(np.array([(q["x"], q["y"]) for q in line]), segs, kind, 1600) for p, line in paths}
    assert got == want and len({d for d in want.values() if d is not None}) > 8 and None in want.values()


def test_intervals_like_the_kernel(spark):
    rnd = random.Random(11)
    place = lambda: (rnd.uniform(0, 100), rnd.uniform(0, 100))
    own, other = ([(i, *place(), *place()) for i in range(40)] for _ in range(2))
    own += [(40, 10.0, 10.0, 10.0, 60.0), (41, 0.0, 50.0, 90.0, 50.0)]
    other += [(40, 15.0, 20.0, 15.0, 40.0), (41, 20.0, 55.0, 30.0, 55.0), (42, 5.0, 5.0, 5.0, 5.0)]
    kind = "edge_id long, ax double, ay double, bx double, by double"
    for reach in (3.0, 17.0):
        got = {r.edge_id: r for r in evaluation.covered(spark.createDataFrame(own, kind), spark.createDataFrame(other, kind), reach).collect()}
        for i, *xy in own:
            a, b = np.array(xy[:2]), np.array(xy[2:])
            parts = [t for o in other if (t := curves.tube_interval(a, b, np.array(o[1:3]), np.array(o[3:5]), reach))]
            assert got[i].inside == pytest.approx(curves.merged_length(parts) * math.dist(a, b), abs=1e-6)
            assert got[i].length == pytest.approx(math.dist(a, b))
    scores = evaluation.buffer_scores(spark.createDataFrame(own, kind), spark.createDataFrame(other, kind), [3.0, 17.0]).collect()
    whole = sum(r.inside for r in got.values()) / sum(r.length for r in got.values())
    assert {r.reach: r.completeness for r in scores}[17.0] == pytest.approx(whole)


def test_kept_pixels_stay(spark):
    rnd = random.Random(12)
    own = sorted({(rnd.randrange(30), rnd.randrange(30)) for _ in range(1200)})
    kept = set(own[::9])
    df = spark.createDataFrame([(*p, p in kept) for p in own], "row long, col long, kept boolean")
    r, c = np.array(own).T
    left = raster_kernels.thin(r, c, 10_000, np.array([p in kept for p in own]))
    got = {(x.row, x.col) for x in raster.thinned(df, 16, 4).collect()}
    assert got == {p for p, stays in zip(own, left.tolist(), strict=True) if stays} and kept <= got


def test_ladder_over_a_plain_one(spark):
    """Levels in turn on one image; pixels of the skeleton so far stay, solid new ones go."""
    rnd = random.Random(13)
    value = {(i, j): v for i in range(40) for j in range(40) if (v := int(70 * math.exp(-((j - 20 - 6 * math.sin(i / 5)) ** 2) / 18) + rnd.randrange(3)))}
    df = spark.createDataFrame([(*p, v) for p, v in value.items()], "row long, col long, v long")
    grey = {(r.row, r.col): r.v for r in raster.closed(df, 1).collect()}
    state = {}
    levels = (64, 32, 16, 8, 1)
    for t in levels:
        own = sorted({p for p, v in grey.items() if v >= t} | set(state))
        if not own:
            continue
        r, c = np.array(own).T
        left = raster_kernels.thin(r, c, 10_000, np.array([p in state for p in own]))
        thin = {p for p, stays in zip(own, left.tolist(), strict=True) if stays}
        solid = {p for p in thin if sum((p[0] + i, p[1] + j) in thin for i in (-1, 0, 1) for j in (-1, 0, 1)) > 7}
        state |= {p: t for p in thin - set(state) - solid}
    assert {(r.row, r.col): r.level for r in raster.skeleton(df, levels).collect()} == state and len(set(state.values())) > 3


def test_traces_without_what_is_near_an_unknown_point(spark):
    rows = [(1, n, n * 10_000_000, e) for n, e in enumerate((5, 5, 6, 7, 7, None, 7, 7, 7, 7, 8, 8))]
    df = spark.createDataFrame(rows, "trip long, n long, us long, edge_id long")
    segs = spark.createDataFrame([(5, 1), (6, 1), (7, 2), (8, 3)], "edge_id long, segment_id long")
    got = sorted((r.run, r.segment_id, r.n_points, r.first_us) for r in matching.traces_of(df, segs, 20_000_000).collect())
    assert [g[1:] for g in got] == [(1, 3, 0), (2, 2, 80_000_000), (3, 2, 100_000_000)]


def test_sticks_that_share_edges(spark):
    sticks = spark.createDataFrame([(1, 10), (1, 11), (2, 11), (2, 12), (3, 12), (4, 20), (5, 20), (6, 30)], "stick long, edge long")
    got = {r.stick: r.group for r in graph.shared_edge_groups(sticks, "stick", "edge").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6}


def test_road_trees_like_the_kernel(spark):
    rows = [(1, i, x, y, b) for i, x, y, b in scattered_points(1, 120, 400)]
    df = spark.createDataFrame(rows, "tile long, id long, x double, y double, bearing double")
    pairs = cluster.adjacent(df, 60.0, 400.0)
    got, _ = road_trees.contracted(df, pairs, 60.0, 3)
    place, near = {r[1]: r[2:4] for r in rows}, {r[1]: set() for r in rows}
    for p in pairs.collect():
        near[p.a].add(p.b)
        near[p.b].add(p.a)
    gone, _ = cluster_kernels.contract_all(sorted(place, key=lambda i: (i * 2654435761) % 2**32), place, near, set(place), 60.0, 3)
    assert {(r.a, r.b) for r in got.collect()} == {(a, b) for a, c in near.items() if a not in gone for b in c if a < b}
    assert len(gone) > 20


def test_stage_commands():
    from trackloom.__main__ import parser

    got = vars(parser().parse_args(["match", "--points", "p", "--edges", "e", "--out", "o", "--reach", "80"]))
    assert got == {"stage": "match", "points": "p", "edges": "e", "out": "o", "reach": 80.0, "keep": 300}


def test_stages_run(spark, tmp_path):
    from trackloom import stages

    rows = [(1, k, k * 5_000_000, 35.0 + k * 1e-4, 51.0) for k in range(6)]
    spark.createDataFrame(rows, "route_id long, event_id long, us long, lat double, lon double").write.parquet(str(tmp_path / "p"))
    stages.run(spark, "sessions", {"positions": str(tmp_path / "p")}, str(tmp_path / "s"), metres=1000.0)
    assert spark.read.parquet(str(tmp_path / "s")).where("session = 1").count() == 6
