"""Kernels against plain versions and hand-computed values."""

import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trackloom.kernels import cluster, curves, freespace, incremental, matching
from trackloom.kernels import raster as pixels
from trackloom.operators.graph import dijkstra, route, spread_points
from trackloom.operators.short_edges import collapsed_in_turn
from trackloom.sources import png, shapefile

A, B = np.array([[0.0, 0], [1, 0], [2, 0]]), np.array([[0.0, 1], [1, 2], [2, 1]])
LINES = st.lists(st.tuples(st.integers(-20, 20), st.integers(-20, 20)), min_size=2, max_size=9).map(lambda p: np.array(p, float))


def test_curve_distances():
    assert curves.hausdorff(A, B) == 2 and curves.discrete_frechet(A, B) == 2
    assert curves.modified_hausdorff(A, B) == pytest.approx(4 / 3)
    assert curves.average_vertical(A, A) == 0


def slow_frechet(a, b, i, j):
    d = math.dist(a[i], b[j])
    if i == j == 0:
        return d
    ways = [slow_frechet(a, b, i - 1, j)] if i else []
    ways += [slow_frechet(a, b, i, j - 1)] if j else []
    ways += [slow_frechet(a, b, i - 1, j - 1)] if i and j else []
    return max(d, min(ways))


@settings(max_examples=60, deadline=None)
@given(LINES.filter(lambda x: len(x) < 6), LINES.filter(lambda x: len(x) < 6))
def test_frechet_and_symmetry(a, b):
    f = curves.discrete_frechet(a, b)
    assert f == pytest.approx(slow_frechet(a, b, len(a) - 1, len(b) - 1))
    assert f >= curves.hausdorff(a, b) - 1e-9
    assert curves.hausdorff(a, b) == curves.hausdorff(b, a) >= curves.modified_hausdorff(a, b)


@settings(max_examples=100, deadline=None)
@given(LINES, st.floats(0.5, 10))
def test_simplified_lines_stay_close(xy, tol):
    kept = curves.simplified(xy, tol)
    assert kept[0] == 0 and kept[-1] == len(xy) - 1
    for a, b in zip(kept, kept[1:], strict=False):
        assert b - a < 2 or curves.chord_distances(xy, a, b).max() <= tol + 1e-9


@settings(max_examples=60, deadline=None)
@given(LINES)
def test_smallest_box(xy):
    box = curves.smallest_box(xy)
    side, up = box[1] - box[0], box[3] - box[0]
    area = abs(side[0] * up[1] - side[1] * up[0])
    spans = xy.max(axis=0) - xy.min(axis=0)
    assert area <= spans[0] * spans[1] + 1e-6
    for v in (side, up):
        if np.linalg.norm(v) > 1e-9:
            t = (xy - box[0]) @ v / (v @ v)
            assert (t > -1e-6).all() and (t < 1 + 1e-6).all()


def test_fit_of_a_bent_line():
    t = np.linspace(0, 100, 201)
    xy = np.stack([t, np.where(t < 50, 0.0, (t - 50) * 0.2)], 1)
    knots = curves.piecewise_fit(xy, 5)
    assert len(knots) == 5 and curves.to_segments(xy, knots).max() < 1.5
    assert [curves.knots_for(np.array([[0.0, 0], [s, 0]] * n)) for s, n in ((800, 20), (500, 20), (200, 20), (40, 20), (800, 1))] == [6, 4, 3, 2, 2]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.floats(-10, 10), min_size=8, max_size=8), st.floats(0.2, 6))
def test_tube_interval(v, eps):
    a, b, c, d = np.array(v).reshape(4, 2)
    got = curves.tube_interval(a, b, c, d, eps)
    t = np.linspace(0, 1, 101)
    near = curves.to_segments(a + (b - a) * t[:, None], np.stack([c, d])) <= eps - 1e-7
    assert not near.any() if got is None else not (near & ((t < got[0] - 1e-6) | (t > got[1] + 1e-6))).any()


def test_merged_length():
    assert curves.merged_length([(0, 1), (0.5, 2), (3, 4)]) == 3 and curves.merged_length([]) == 0


# matching


def chain_model():
    edges = {1: (1, 2, 3.0), 2: (2, 3, 1.0), 3: (2, 1, 1.0), 4: (3, 4, 2.0), 5: (2, 4, 2.0)}
    return edges, matching.transitions(edges)


def test_transitions():
    _, model = chain_model()
    one = dict(model[1])
    assert one[1] == 0.5 and one[matching.UNKNOWN] == 1e-5 and one[3] == 1e-5
    assert one[2] == pytest.approx((1 - 0.5 - 1e-5) * 1 / 4) and one[5] == pytest.approx((1 - 0.5 - 1e-5) * 2 / 4)
    assert sum(p for _, p in model[matching.UNKNOWN]) == pytest.approx(1)


@pytest.mark.parametrize("d, want", [(0, 0.4999999995), (25, 0.308538), (50, 0.158655), (149, 0.001441), (150, 0)])
def test_emission(d, want):
    assert matching.emission(d) == pytest.approx(want, abs=1e-6)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.floats(0.05, 1), min_size=3, max_size=3), min_size=1, max_size=5), st.randoms(use_true_random=False))
def test_viterbi_against_enumeration(obs, rnd):
    states = [0, 1, 2]
    p = {(s, t): rnd.uniform(0.05, 1) for s in [-1, *states] for t in states}
    got = matching.matched([list(zip(states, e, strict=True)) for e in obs], lambda s, t: p.get((s, t), 0.0), {-1: 1.0})

    def score(path):
        out, prev = 1.0, -1
        for s, e in zip(path, obs, strict=True):
            out *= p[(prev, s)] * e[s]
            prev = s
        return out

    assert score(got) == pytest.approx(max(score(x) for x in itertools.product(states, repeat=len(obs))))


def test_history_is_bounded_and_whole():
    v = matching.Viterbi(lambda s, t: 0.6 if s == t else 0.3, {0: 1.0}, keep=5)
    out = [x for k in range(40) if (x := v.step([(0, 0.9 if k % 8 < 4 else 0.1), (1, 0.1 if k % 8 < 4 else 0.9)])) is not None]
    assert len(out) + len(v.tail()) == 40 and len(v.back) <= 5


def test_nothing_emitted_starts_anew():
    assert matching.matched([[(1, 0.5)], [(1, 0.0)], [(1, 0.5)]], lambda s, t: 1.0, {-1: 1.0}) == [1, -1, 1]


def test_st_match_prefers_the_connected_edge():
    cand = [[(1, 5.0, 1.0)], [(2, 3.0, 2.0), (9, 3.0, 1.9)]]
    far = {(1, 2): 8.0}
    got = matching.st_match(cand, [8.0], lambda p, q: far.get((p[0], q[0]), math.inf), 20.0)
    assert [g[0] for g in got] == [1, 2] and got[1][2] == 1.0
    assert matching.st_match([[], [(1, 0.0, 1.0)]], [5.0], lambda p, q: 0.0, 20.0)[0] is None


# rasters


def plain_thin(points, rounds):
    on = set(points)
    ring = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]
    for _ in range(rounds):
        before = len(on)
        for step in (0, 1):
            gone = set()
            for r, c in on:
                p = [(r + a, c + b) in on for a, b in ring]
                rises = sum(not p[k] and p[(k + 1) % 8] for k in range(8))
                n, e, s, w = p[0], p[2], p[4], p[6]
                odd = not (n and e and s) and not (e and s and w) if step == 0 else not (n and e and w) and not (n and s and w)
                if 2 <= sum(p) <= 6 and rises == 1 and odd:
                    gone.add((r, c))
            on -= gone
        if len(on) == before:
            break
    return on


@settings(max_examples=60, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 11), st.integers(0, 11)), min_size=1), st.integers(1, 6))
def test_thinning(points, rounds):
    own = sorted(points)
    left = pixels.thin(np.array([p[0] for p in own]), np.array([p[1] for p in own]), rounds)
    assert {p for p, k in zip(own, left, strict=True) if k} == plain_thin(points, rounds)


def test_ring_and_chain():
    ring = pixels.outer_ring()
    assert len(set(ring)) == 16 and all(max(map(abs, p)) == 2 for p in ring) and all(max(abs(a[0] - b[0]), abs(a[1] - b[1])) == 1 for a, b in zip(ring, ring[1:] + ring[:1], strict=True))
    rows, cols = np.array([3, 1, 2, 0]), np.array([3, 1, 2, 0])
    order = pixels.chain(rows, cols, np.array([False, False, False, True]))
    assert rows[order].tolist() == [0, 1, 2, 3]


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.integers(0, 2**31))
def test_png(h, w, seed):
    image = np.random.default_rng(seed).integers(0, 65536, (h, w)).astype(np.uint16)
    assert (png.decode(png.encode(image)) == image).all()
    with pytest.raises(ValueError):
        png.decode(b"no image at all")


def test_shapefile_bytes():
    lines = [[(0.0, 1.0), (2.5, -3.0)], [(1e6, 2e6), (3.0, 4.0), (5.0, 6.0)]]
    shp, shx = shapefile.encode(lines)
    assert [p for _, p in shapefile.decode(shp)] == lines and len(shx) == 100 + 8 * 2
    assert int.from_bytes(shp[24:28], "big") * 2 == len(shp)
    with pytest.raises(ValueError):
        list(shapefile.decode(b"x" * 200))


# graphs


def test_dijkstra_and_route():
    heads = {1: [(2, 1.0), (3, 5.0)], 2: [(3, 1.0)], 3: [(4, 1.0)]}
    dist, prev = dijkstra(heads, 1)
    assert dist == {1: 0, 2: 1, 3: 2, 4: 3} and route(prev, 1, 4) == [1, 2, 3, 4] and route(prev, 1, 9) == []
    assert dijkstra(heads, 1, limit=1.5)[0] == {1: 0, 2: 1}


def test_spread_points():
    heads, place = {1: [(2, 10.0)], 2: [(1, 10.0)]}, {1: (0.0, 0.0), 2: (10.0, 0.0)}
    assert spread_points(heads, place, 1, 100, 4).tolist() == [[0, 0], [4, 0], [8, 0]]


def test_short_edges_collapse_unless_traces_suffer():
    place, edges = {1: (0.0, 0.0), 2: (30.0, 0.0), 3: (200.0, 0.0), 4: (-200.0, 0.0)}, {1: (1, 2), 2: (2, 3), 3: (1, 4)}
    assert collapsed_in_turn(place, edges, {}, 50.0, 12.0) == [1]
    assert edges == {2: (1, 3), 3: (1, 4)} and place[1] == (15.0, 0.0)
    bent, edges = {1: (0.0, 0.0), 2: (0.0, 49.0), 3: (200.0, 49.0), 4: (-200.0, 0.0)}, {1: (1, 2), 2: (2, 3), 3: (1, 4)}
    trace = np.array([(x, 0.0) for x in range(-200, 1, 10)])
    assert collapsed_in_turn(bent, edges, {3: [trace]}, 50.0, 5.0) == [1] and len(edges) == 3


def test_frechet_walk_in_a_graph():
    grid = np.array([(r * 3 + c, r2 * 3 + c2, c * 100, r * 100, c2 * 100, r2 * 100) for r in range(3) for c in range(3) for r2, c2 in ((r, c + 1), (r + 1, c), (r, c - 1), (r - 1, c)) if 0 <= r2 < 3 and 0 <= c2 < 3], float)
    path = np.array([[0.0, 7], [100, 4], [104, 100], [200, 103]])
    assert freespace.least_distance(path, grid, "frechet", 1600) in (7, 8)
    assert freespace.least_distance(path, grid, "hausdorff", 1600) <= 7
    assert freespace.least_distance(path + 5000, grid, "frechet", 1600) is None
    cut = grid[~((grid[:, 0] == 1) & (grid[:, 1] == 4))]
    assert freespace.least_distance(path, cut, "frechet", 1600) > 20


def length_of(edges):
    return sum(math.dist(e[:2], e[2:]) for e in edges)


def test_incremental_map():
    first, second = np.array([[0.0, 0], [100, 0], [200, 0]]), np.array([[0.0, 2], [100, 3], [100, 100]])
    got = incremental.constructed([first, second], 10.0).edges()
    assert any((100.0, 100.0) in (e[:2], e[2:]) for e in got)
    # the stretch that both drove is there once; and a connecting edge of the reach's length
    assert length_of(got) == pytest.approx(200 + 90 + 10, abs=0.2) and len(got) == 4
    again = incremental.constructed([first, first, first[::-1]], 10.0).edges()
    assert length_of(again) == pytest.approx(200, abs=1e-9) and len(again) == 2
    above = incremental.constructed([first, first], 10.0, [np.zeros(3), np.full(3, 20.0)], 4.0).edges()
    assert length_of(above) == pytest.approx(400)
    assert incremental.constructed([first[:1], np.zeros((0, 2)), np.zeros((3, 2))], 10.0).edges() == []


def test_tube_intervals_agree():
    rng = np.random.default_rng(4)
    for _ in range(300):
        a, b = rng.integers(-5, 6, (2, 2)).astype(float)
        c, d = rng.integers(-5, 6, (2, 20, 2)).astype(float)
        if (a == b).all():
            continue
        lo, hi = incremental.tube_intervals(a, b, c, d, 2.0)
        for k in range(20):
            one = curves.tube_interval(a, b, c[k], d[k], 2.0)
            assert (one is None and lo[k] > hi[k]) or one == pytest.approx((lo[k], hi[k]), abs=1e-9)


# clusters


def test_representatives_and_turns():
    xy, bearing = np.array([[0.0, 0], [1, 0], [1, 1], [50, 50]]), np.array([10.0, 12, 200, 10])
    assert cluster.representatives(xy, bearing, np.arange(4), 5, 20).tolist() == [0, 2, 3]
    label = cluster.turn_clusters(np.array([[0.0, 0], [5, 5], [500, 0]]), np.array([10.0, 12, 10]), np.array([90.0, 95, 90]), np.array([20.0, 10, 5]))
    assert label[0] == label[1] != label[2]


def test_density_clusters():
    rng = np.random.default_rng(3)
    xy = np.concatenate([rng.normal(0, 3, (30, 2)), rng.normal(200, 3, (30, 2)), [[1000.0, 0]]])
    bearing = np.concatenate([np.full(15, 10.0), np.full(15, 190.0), np.full(30, 359.0), [0.0]])
    label = cluster.density_clusters(xy, bearing, 20, 30, 4)
    assert len(set(label[:15])) == 1 and len(set(label[15:30])) == 1 and label[0] != label[15] and label[-1] == -1


def test_midpoints():
    assert len(cluster.midpoints(np.zeros(2), np.array([35.0, 0]), 10)) == 5


def test_knots_by_distance_from_the_mean():
    box = np.stack(np.meshgrid(np.linspace(0, 200, 10), np.linspace(0, 150, 6)), -1).reshape(-1, 2)  # 125 m from the mean, 250 across
    assert [curves.knots_for(box * f) for f in (0.3, 1, 2, 4)] == [2, 3, 4, 6] and curves.knots_for(np.repeat(box[:1], 9, axis=0)) == 2


def test_ball_and_contraction():
    place = {k: (10.0 * k, 0.0) for k in range(8)} | {20: (0.0, 15.0)}
    links = [(k, k + 1) for k in range(7)] + [(0, 20)]
    near = {k: {b if a == k else a for a, b in links if k in (a, b)} for k in place}
    # walks by breadth: 0, 1, 20, 2 lie below 25; 3, at 30, ends it
    assert cluster.ball(0, place, near, lambda q: True, 25.0) == ([0, 1, 20, 2], True)
    assert cluster.ball(6, place, near, lambda q: q > 4, 25.0) == ([6, 5, 7], False)
    gone, came = cluster.contract_all([0, 6], place, {k: set(v) for k, v in near.items()}, set(place), 25.0, 3)
    assert gone == {0, 2, 20, 4, 6, 7} and came == {(1, 3), (3, 5)}  # 6 takes 5, 7 and 4; of 5 and 6, equally near the mean, 5 stays
    assert cluster.contract_all([0], place, {k: set(v) for k, v in near.items()}, set(place), 25.0, 4) == (set(), set())
