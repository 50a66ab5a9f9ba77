"""Graphs over plane points by their definitions, for tests."""

import numpy as np

from trackloom.kernels.curves import pairwise
from trackloom.kernels.planegraph import delaunay, nearer_part  # noqa: F401

Edges = set[tuple[int, int]]


def spanning_tree(xy: np.ndarray) -> Edges:
    """Minimum spanning tree of the complete graph; ties go to smaller indices."""
    n = len(xy)
    if n < 2:
        return set()
    best, near = pairwise(xy[:1], xy)[0], np.zeros(n, int)
    done, out = np.zeros(n, bool), set()
    done[0] = True
    for _ in range(n - 1):
        k = int(np.argmin(np.where(done, np.inf, best)))
        out.add((min(k, int(near[k])), max(k, int(near[k]))))
        done[k] = True
        d = pairwise(xy[k : k + 1], xy)[0]
        closer = d < best
        best, near = np.where(closer, d, best), np.where(closer, k, near)
    return out


def triangle_edges(triangles: set[tuple[int, int, int]]) -> Edges:
    return {e for a, b, c in triangles for e in ((a, b), (b, c), (a, c))}


def gabriel(xy: np.ndarray) -> Edges:
    """Pairs with no other point inside the circle that has them as a diameter."""
    d2 = pairwise(xy, xy) ** 2
    return {(i, j) for i, j in triangle_edges(delaunay(xy)) if not ((d2[i] + d2[j] < d2[i, j] * (1 - 1e-12)) & (np.arange(len(xy)) != i) & (np.arange(len(xy)) != j)).any()}


def relative_neighbours(xy: np.ndarray) -> Edges:
    """Pairs with no other point closer to both than they are to each other."""
    d = pairwise(xy, xy)
    return {(i, j) for i, j in triangle_edges(delaunay(xy)) if not (np.maximum(d[i], d[j]) < d[i, j] * (1 - 1e-12)).any()}


def nearest_graph(xy: np.ndarray, k: int) -> Edges:
    """Each point with its k nearest; ties go to smaller indices."""
    d = pairwise(xy, xy)
    np.fill_diagonal(d, np.inf)
    return {(min(i, int(j)), max(i, int(j))) for i, row in enumerate(np.argsort(d, axis=1, kind="stable")[:, :k]) for j in row if d[i, j] < np.inf}


def voronoi_vertices(xy: np.ndarray) -> dict[tuple[int, int, int], tuple[float, float]]:
    """Corner of the Voronoi diagram for each Delaunay triangle."""
    out = {}
    for t in delaunay(xy):
        (ax, ay), (bx, by), (cx, cy) = xy[list(t)]
        bx, by, cx, cy = bx - ax, by - ay, cx - ax, cy - ay
        d = 2 * (bx * cy - by * cx)
        if d:
            out[t] = (ax + (cy * (bx * bx + by * by) - by * (cx * cx + cy * cy)) / d, ay + (bx * (cx * cx + cy * cy) - cx * (bx * bx + by * by)) / d)
    return out


def relaxed(germs: np.ndarray, samples: np.ndarray, rounds: int = 1) -> np.ndarray:
    """Germs moved to the mean of the samples nearest to them, a round of centroidal tessellation at a time."""
    g = germs.astype(float).copy()
    for _ in range(rounds):
        own = pairwise(samples, g).argmin(axis=1)
        n = np.bincount(own, minlength=len(g))
        total = np.stack([np.bincount(own, weights=samples[:, c], minlength=len(g)) for c in (0, 1)], 1)
        g = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], g)
    return g


def spread_labels(labels: np.ndarray, edges: Edges, how: str) -> np.ndarray:
    """Morphology on a graph: each node gets the largest ("dilate") or smallest ("erode") label among itself and its neighbours."""
    out = labels.copy()
    pick = max if how == "dilate" else min
    for a, b in edges:
        out[a], out[b] = pick(out[a], labels[b]), pick(out[b], labels[a])
    return out


def hop_distances(n: int, edges: Edges, start: int) -> np.ndarray:
    """Steps from a node; -1 for nodes that can't be reached."""
    near: dict[int, list[int]] = {}
    for a, b in edges:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    out = np.full(n, -1)
    out[start], ring = 0, [start]
    while ring:
        new = []
        for u in ring:
            for v in near.get(u, ()):
                if out[v] < 0:
                    out[v] = out[u] + 1
                    new.append(v)
        ring = new
    return out


def clipped_polygon(poly: np.ndarray, window: np.ndarray) -> np.ndarray:
    """Part of a polygon inside a convex window whose corners go anticlockwise, side by side."""
    out = [tuple(p) for p in poly]
    for a, b in zip(window, np.roll(window, -1, axis=0), strict=True):
        side = [(b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) for p in out]
        new = []
        for k, p in enumerate(out):
            q, s, t = out[k - 1], side[k - 1], side[k]
            if (s >= 0) != (t >= 0):
                f = s / (s - t)
                new.append((q[0] + (p[0] - q[0]) * f, q[1] + (p[1] - q[1]) * f))
            if t >= 0:
                new.append(p)
        out = new
    return np.array(out, float).reshape(-1, 2)
