"""Collapsing of short edges in rounds equals the rule in one place, shortest first."""

import random

import numpy as np
import pytest

from trackloom.operators import short_edges


def town(seed=4, side=6):
    """Streets with short edges at crossings, parallel ones too, and traces along the edges, some of which bend."""
    rnd = random.Random(seed)
    place, edges = {}, {}
    for r in range(side):
        for c in range(side):
            n = 2 * (r * side + c)
            place[n] = (150.0 * c + rnd.uniform(-9, 9), 150.0 * r + rnd.uniform(-9, 9))
            place[n + 1] = (place[n][0] + rnd.uniform(8, 35), place[n][1] + rnd.uniform(-30, 30))
            edges[len(edges)] = (n, n + 1)
            if c:
                edges[len(edges)] = (n - 1, n)
            if r:
                edges[len(edges)] = (n - 2 * side + rnd.randint(0, 1), n + rnd.randint(0, 1))
    edges[900], edges[901], edges[902] = (0, 1), (4, 4), (10_001, 10_002)
    place[10_001], place[10_002] = (5000.0, 0.0), (5010.0, 0.0)
    traces = {}
    for k, (a, b) in edges.items():
        if k % 3 == 0 and k < 900:
            f = np.linspace(0, 1, 12)[:, None]
            line = np.array(place[a]) * (1 - f) + np.array(place[b]) * f
            traces[k] = [line + rnd.uniform(-4, 4), line + np.array([[0.0, rnd.choice([0, 0, 14])]])]
    return place, edges, traces


def frames(spark, place, edges, traces):
    return (
        spark.createDataFrame([(i, *p) for i, p in place.items()], "id long, x double, y double"),
        spark.createDataFrame([(k, *e) for k, e in edges.items()], "edge_id long, a long, b long"),
        spark.createDataFrame([(k, n, float(x), float(y)) for k, ts in traces.items() for n, t in enumerate(ts) for x, y in t], "edge_id long, trace long, x double, y double"),
    )


@pytest.mark.parametrize("few", [0, 50_000])
def test_rounds_equal_shortest_first(spark, few):
    place, edges, traces = town()
    got, log = short_edges.collapse(*frames(spark, place, edges, traces), 50.0, 12.0, few)
    rows = {r.edge_id: (r.a, r.b, round(r.ax, 6), round(r.ay, 6), round(r.bx, 6), round(r.by, 6)) for r in got.collect()}
    order = [r.edge_id for r in sorted(log.collect())]
    for own in ([None, order] if few == 0 else [None]):
        at, left = dict(place), {k: e for k, e in edges.items() if e[0] != e[1]}
        tried = short_edges.collapsed_in_turn(at, left, traces, 50.0, 12.0, order=own)
        want = {k: (a, b, *(round(v, 6) for v in (*at[a], *at[b]))) for k, (a, b) in left.items()}
        assert {k: {v[:3:2] + v[3:4], v[1:2] + v[4:]} for k, v in rows.items()} == {k: {v[:3:2] + v[3:4], v[1:2] + v[4:]} for k, v in want.items()}
        assert 20 < len(tried) and 10 < len(edges) - len(left)
    assert 902 in rows  # nothing around it


def test_no_edges(spark):
    nodes, edges, traces = frames(spark, *town())
    assert short_edges.collapse(nodes, edges.limit(0), traces)[0].collect() == []
    assert short_edges.collapse(nodes, edges, traces.limit(0), 50.0, 12.0)[0].count() < edges.count() - 30
