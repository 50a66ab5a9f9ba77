"""Rounds of the road tree equal the plain rule over the same order of seeds."""

import math
import random
from collections import deque

from trackloom.operators import road_trees, sets


def town(n=170, seed=2):
    rnd = random.Random(seed)
    place = {}
    for k in range(n):
        along, at, off = rnd.uniform(0, 900), rnd.choice([0, 300, 600]), rnd.uniform(-8, 8)
        place[k * 7 - 50] = (along, at + off) if k % 2 else (at + off, along)
    ids = sorted(place)
    links = [(a, b) for a in ids for b in ids if a < b and math.dist(place[a], place[b]) < 45]
    return place, links


def by_rule(place, links, seeds, reach, delta):
    """One seed after another, on plain sets."""
    near = {k: set() for k in place}
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    marked = set()
    for s in seeds:
        if s in marked or s not in near:
            continue
        walk, queue, own, seen, ended = {s: 0.0}, deque([s]), [], {s}, False
        while queue:
            p = queue.popleft()
            if walk[p] >= reach:
                ended = True
                break
            own.append(p)
            for q in sorted(near[p] - seen - marked):
                seen.add(q)
                walk[q] = walk[p] + math.dist(place[p], place[q])
                queue.append(q)
        marked |= set(own)
        if ended and len(own) > delta:
            mx, my = (sum(place[p][k] for p in own) / len(own) for k in (0, 1))
            c = min(own, key=lambda p: (round(math.dist(place[p], (mx, my)), 9), p))
            around = {q for p in own for q in near[p]} - set(own)
            for p in own:
                for q in near.pop(p):
                    if q in near:
                        near[q].discard(p)
            near[c] = set(around)
            for q in around:
                near[q].add(c)
    return {(a, b) for a in near for b in near[a] if a < b}


def test_rounds_equal_the_rule(spark):
    place, links = town()
    points = spark.createDataFrame([(i, x, y) for i, (x, y) in place.items()], "id long, x double, y double")
    pairs = spark.createDataFrame(links, "a long, b long")
    hashed = {i: (i * sets.SCATTER) % (1 << 32) for i in place}
    for few in (60, 10_000):
        got, seeds = road_trees.contracted(points, pairs, 100.0, 4, few)
        order = [r.seed for r in sorted(seeds.collect(), key=lambda r: (r.round, hashed[r.seed]))]
        rest = sorted(place, key=lambda i: hashed[i])
        assert {(r.a, r.b) for r in got.collect()} == by_rule(place, links, order + rest, 100.0, 4)
        assert len(order) > 10 if few == 60 else not order
    assert len(by_rule(place, links, rest, 100.0, 4)) < 0.8 * len(links)  # it contracts much
    empty, none = road_trees.contracted(points.limit(0), pairs.limit(0), 100.0, 4)
    assert empty.collect() == [] and none.collect() == []
