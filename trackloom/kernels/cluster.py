"""Greedy clustering kernels for one tile."""

from __future__ import annotations

import math
from collections import deque

import numpy as np


def representatives(xy: np.ndarray, bearing: np.ndarray, order: np.ndarray, radius: float, turn: float) -> np.ndarray:
    """Indices kept: points are taken in the given order, and each removes all left within its radius and bearing difference."""
    left = np.ones(len(xy), bool)
    out = []
    for i in order:
        if not left[i]:
            continue
        out.append(int(i))
        near = np.hypot(xy[:, 0] - xy[i, 0], xy[:, 1] - xy[i, 1]) <= radius
        left &= ~(near & (np.abs(bearing - bearing[i]) <= turn))
        left[i] = False
    return np.array(out, int)


Place = tuple[float, float]


def ball(seed: int, place: dict[int, Place], near: dict[int, set[int]], free, reach: float) -> tuple[list[int], bool]:
    """Free nodes met from a seed in order of breadth, by walks shorter than ``reach``; and whether a free node at a walk of ``reach`` or more ended that.

    Walks go by straight lengths along the links by which nodes were met.
    """
    met, queue, taken = {seed}, deque([(seed, 0.0)]), []
    while queue:
        p, far = queue.popleft()
        if far >= reach:
            return taken, True
        taken.append(p)
        for q in sorted(near.get(p, ())):
            if q not in met and free(q):
                met.add(q)
                queue.append((q, far + math.dist(place[p], place[q])))
    return taken, False


def centre_member(nodes: list[int], place: dict[int, Place]) -> int:
    """The node nearest the mean of all, the smallest of equally near ones."""
    xy = np.array([place[p] for p in nodes])
    far = np.round(np.hypot(*(xy - xy.mean(axis=0)).T), 9)
    return min(zip(far, nodes, strict=True))[1]


def contract_all(seeds: list[int], place: dict[int, Place], near: dict[int, set[int]], free: set[int], reach: float, delta: int) -> tuple[set[int], set[tuple[int, int]]]:
    """Seeds in turn, those that are still free, take their balls; a ball that was ended and has more than ``delta`` nodes becomes its centre member, linked to all neighbours of the ball.

    ``near`` and ``free`` are changed. Returns the nodes that went and the links that came.
    """
    gone, links = set(), set()
    for s in seeds:
        if s not in free:
            continue
        taken, ended = ball(s, place, near, free.__contains__, reach)
        free.difference_update(taken)
        if ended and len(taken) > delta:
            c = centre_member(taken, place)
            around = set().union(*(near[p] for p in taken)) - set(taken)
            for p in taken:
                for q in near.pop(p):
                    near[q].discard(p) if q in near else None
            near[c] = around
            gone.update(set(taken) - {c})
            for q in around:
                near.setdefault(q, set()).add(c)
                links.add((min(c, q), max(c, q)))
    return gone, {x for x in links if not set(x) & gone}


def turn_clusters(xy: np.ndarray, entry: np.ndarray, leave: np.ndarray, extent: np.ndarray, degrees: float = 15.0) -> np.ndarray:
    """A cluster number for each turn: turns by falling extent take all free ones within their extent whose heading in or out is alike, up to reversal."""
    label = np.full(len(xy), -1)
    order = np.lexsort((np.arange(len(xy)), -extent))

    def alike(a: np.ndarray, b: float) -> np.ndarray:
        d = np.abs(a - b) % 180
        return np.minimum(d, 180 - d) <= degrees

    k = 0
    for i in order:
        if label[i] >= 0:
            continue
        inside = (np.abs(xy - xy[i]) <= extent[i]).all(axis=1) & (label < 0)
        own = inside & (alike(entry, entry[i]) | alike(leave, leave[i]))
        own[i] = True
        label[own] = k
        k += 1
    return label


def density_clusters(xy: np.ndarray, bearing: np.ndarray, reach: float, turn: float, least: int) -> np.ndarray:
    """DBSCAN whose neighbours also agree in direction; -1 for noise. Grid cells keep it near linear."""
    n = len(xy)
    cells: dict[tuple[int, int], list[int]] = {}
    for i, (x, y) in enumerate(np.floor(xy / reach).astype(int).tolist()):
        cells.setdefault((x, y), []).append(i)

    def around(i: int) -> list[int]:
        x, y = np.floor(xy[i] / reach).astype(int).tolist()
        own = np.array([j for a in (-1, 0, 1) for b in (-1, 0, 1) for j in cells.get((x + a, y + b), ())])
        d = np.abs(bearing[own] - bearing[i]) % 360
        ok = (np.hypot(xy[own, 0] - xy[i, 0], xy[own, 1] - xy[i, 1]) <= reach) & (np.minimum(d, 360 - d) <= turn)
        return own[ok].tolist()

    label = np.full(n, -2)
    k = 0
    for i in range(n):
        if label[i] != -2:
            continue
        near = around(i)
        if len(near) < least:
            label[i] = -1
            continue
        label[i] = k
        todo = [j for j in near if j != i]
        while todo:
            j = todo.pop()
            if label[j] == -1:
                label[j] = k
            if label[j] != -2:
                continue
            label[j] = k
            more = around(j)
            if len(more) >= least:
                todo += more
        k += 1
    return label


def midpoints(a: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
    """A link halved again and again until no piece is longer than ``most``."""
    length = math.dist(a, b)
    k = 1
    while length / k > most:
        k *= 2
    return a + (b - a) * (np.arange(k + 1) / k)[:, None]
