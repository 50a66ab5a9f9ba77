"""Triangles of plane points and cells cut along bisectors, for one group of points."""

from __future__ import annotations

import math

import numpy as np


def delaunay(xy: np.ndarray) -> set[tuple[int, int, int]]:
    """Triangles of a Delaunay triangulation, by adding points one after another; repeated points are left out."""
    n = len(xy)
    if n < 3:
        return set()
    mid, size = (xy.max(axis=0) + xy.min(axis=0)) / 2, max(1e-9, float((xy.max(axis=0) - xy.min(axis=0)).max()))
    far = 1e4 * size
    p = np.concatenate([xy, mid + np.array([[-far, -far], [far, -far], [0, far]])])

    def circle(t: tuple[int, int, int]) -> tuple[float, float, float]:
        (ax, ay), (bx, by), (cx, cy) = p[t[0]], p[t[1]], p[t[2]]
        bx, by, cx, cy = bx - ax, by - ay, cx - ax, cy - ay
        d = 2 * (bx * cy - by * cx)
        if d == 0:
            return ax, ay, math.inf
        ux, uy = (cy * (bx * bx + by * by) - by * (cx * cx + cy * cy)) / d, (bx * (cx * cx + cy * cy) - cx * (bx * bx + by * by)) / d
        return ax + ux, ay + uy, ux * ux + uy * uy

    # all triangles ever made, with their circles; those that went have none
    made: list[tuple[int, int, int]] = [(n, n + 1, n + 2)]
    circles = np.full((64, 3), -1.0)
    circles[0] = circle(made[0])
    seen: set[tuple[float, float]] = set()
    for i in range(n):
        x, y = map(float, p[i])
        if (x, y) in seen:
            continue
        seen.add((x, y))
        own = circles[: len(made)]
        bad = np.flatnonzero((x - own[:, 0]) ** 2 + (y - own[:, 1]) ** 2 < own[:, 2] * (1 - 1e-12))
        count: dict[tuple[int, int], int] = {}
        for k in bad.tolist():
            t = made[k]
            for a, b in ((t[0], t[1]), (t[1], t[2]), (t[0], t[2])):
                count[(a, b)] = count.get((a, b), 0) + 1
        own[bad, 2] = -1.0
        for (a, b), k in count.items():
            if k == 1:
                t = tuple(sorted((a, b, i)))
                if len(made) == len(circles):
                    circles = np.concatenate([circles, np.full((len(circles), 3), -1.0)])
                circles[len(made)] = circle(t)
                made.append(t)
    return {made[k] for k in np.flatnonzero(circles[: len(made), 2] >= 0).tolist() if made[k][2] < n}


def nearer_part(poly: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Part of a convex polygon that is at least as near to ``p`` as to ``q``."""
    side = (poly - (p + q) / 2) @ (q - p)
    out = []
    for k in range(len(poly)):
        s, t = side[k - 1], side[k]
        if (s <= 0) != (t <= 0):
            out.append(poly[k - 1] + (poly[k] - poly[k - 1]) * (s / (s - t)))
        if t <= 0:
            out.append(poly[k])
    return np.array(out, float).reshape(-1, 2)
