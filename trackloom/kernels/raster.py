"""Raster kernels for one tile or one component."""

from __future__ import annotations

import numpy as np


def thin(rows: np.ndarray, cols: np.ndarray, rounds: int, kept: np.ndarray | None = None) -> np.ndarray:
    """Which of the set pixels remain after so many rounds of Zhang-Suen thinning, or fewer if nothing changes; ``kept`` ones do."""
    if not len(rows):
        return np.zeros(0, bool)
    r, c = rows - rows.min() + 1, cols - cols.min() + 1
    image = np.zeros((r.max() + 2, c.max() + 2), np.uint8)
    image[r, c] = 1
    free = image[1:-1, 1:-1] == 1
    if kept is not None:
        free[r[kept] - 1, c[kept] - 1] = False
    for _ in range(rounds):
        before = int(image.sum())
        for step in (0, 1):
            p = image
            n, ne, e, se = p[:-2, 1:-1], p[:-2, 2:], p[1:-1, 2:], p[2:, 2:]
            s, sw, w, nw = p[2:, 1:-1], p[2:, :-2], p[1:-1, :-2], p[:-2, :-2]
            ring = [n, ne, e, se, s, sw, w, nw]
            count = sum(x.astype(np.int8) for x in ring)
            rises = sum(((ring[k] == 0) & (ring[(k + 1) % 8] == 1)).astype(np.int8) for k in range(8))
            odd = ((n & e & s) == 0) & ((e & s & w) == 0) if step == 0 else ((n & e & w) == 0) & ((n & s & w) == 0)
            gone = free & (p[1:-1, 1:-1] == 1) & (count >= 2) & (count <= 6) & (rises == 1) & odd
            image = image.copy()
            image[1:-1, 1:-1][gone] = 0
        if int(image.sum()) == before:
            break
    return image[r, c] == 1


def outer_ring() -> list[tuple[int, int]]:
    """Offsets of the 16 cells at distance two, clockwise from the upper left."""
    top = [(-2, j) for j in range(-2, 2)]
    right = [(i, 2) for i in range(-2, 2)]
    bottom = [(2, j) for j in range(2, -2, -1)]
    left = [(i, -2) for i in range(2, -2, -1)]
    return top + right + bottom + left


def chain(rows: np.ndarray, cols: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """An order of a path's pixels from one end to the other: a walk that always goes to the nearest pixel left.

    It starts at a pixel that touches a crossing, else at one with the fewest neighbours.
    """
    n = len(rows)
    at = {(int(r), int(c)): i for i, (r, c) in enumerate(zip(rows, cols, strict=True))}
    near = [[at[q] for d in ((-1, 0), (0, -1), (0, 1), (1, 0), (-1, -1), (-1, 1), (1, -1), (1, 1)) if (q := (int(rows[i]) + d[0], int(cols[i]) + d[1])) in at] for i in range(n)]
    order_by = sorted(range(n), key=lambda i: (not ends[i], len(near[i]), int(rows[i]), int(cols[i])))
    left, out, now = set(range(n)), [], order_by[0]
    while True:
        out.append(now)
        left.discard(now)
        if not left:
            return np.array(out)
        step = next((k for k in near[now] if k in left), None)
        if step is None:
            rest = np.fromiter(left, int)
            step = int(rest[np.lexsort((rest, (rows[rest] - rows[now]) ** 2 + (cols[rest] - cols[now]) ** 2))[0]])
        now = step
