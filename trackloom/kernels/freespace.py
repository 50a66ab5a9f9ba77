"""Whether a graph has a curve close to a path, by free-space intervals.

Edges are arrays of rows (source, target, ax, ay, bx, by); only those near the
path's box are looked at, and intervals of all of them are computed at once.
"""

from __future__ import annotations

import heapq
import math

import numpy as np

from trackloom.kernels.curves import disc_interval

NONE = np.nan


def disc_intervals(p: np.ndarray, a: np.ndarray, b: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Parts of the segment a-b, as fractions, within ``eps`` of each of many points; NaN for none."""
    d, r = b - a, a - p
    qa = float(d @ d)
    qb, qc = 2 * r @ d, (r * r).sum(axis=1) - eps * eps
    if qa == 0:
        ok = qc <= 0
        return np.where(ok, 0.0, NONE), np.where(ok, 1.0, NONE)
    disc = qb * qb - 4 * qa * qc
    root = np.sqrt(np.where(disc >= 0, disc, NONE))
    lo, hi = np.maximum(0.0, (-qb - root) / (2 * qa)), np.minimum(1.0, (-qb + root) / (2 * qa))
    ok = lo <= hi
    return np.where(ok, lo, NONE), np.where(ok, hi, NONE)


def tube_intervals(a: np.ndarray, b: np.ndarray, segs: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Parts of the segment a-b within ``eps`` of each segment (cx, cy, dx, dy)."""
    c, d = segs[:, :2], segs[:, 2:]
    axis = d - c
    size = np.hypot(axis[:, 0], axis[:, 1])
    u = axis / np.where(size > 0, size, 1)[:, None]
    v = np.stack([-u[:, 1], u[:, 0]], 1)
    lo, hi = np.zeros(len(segs)), np.ones(len(segs))
    with np.errstate(divide="ignore", invalid="ignore"):
        for w, least, most in ((u, np.zeros(len(segs)), size), (v, np.full(len(segs), -eps), np.full(len(segs), eps))):
            v0, v1 = ((a - c) * w).sum(axis=1), ((b - c) * w).sum(axis=1)
            step = v1 - v0
            x, y = (least - v0) / step, (most - v0) / step
            flat = step == 0
            inside = (least <= v0) & (v0 <= most)
            lo = np.maximum(lo, np.where(flat, np.where(inside, 0.0, 2.0), np.minimum(x, y)))
            hi = np.minimum(hi, np.where(flat, np.where(inside, 1.0, -1.0), np.maximum(x, y)))
    strip = (lo <= hi) & (size > 0)
    parts = [(np.where(strip, lo, NONE), np.where(strip, hi, NONE)), disc_intervals(c, a, b, eps), disc_intervals(d, a, b, eps)]
    return np.fmin.reduce([p[0] for p in parts]), np.fmax.reduce([p[1] for p in parts])


def near(xy: np.ndarray, edges: np.ndarray, eps: float) -> np.ndarray:
    """Edges whose box comes within ``eps`` of the path's."""
    lo, hi = xy.min(axis=0) - eps, xy.max(axis=0) + eps
    a, b = np.minimum(edges[:, 2:4], edges[:, 4:6]), np.maximum(edges[:, 2:4], edges[:, 4:6])
    return edges[((a <= hi) & (b >= lo)).all(axis=1)]


def path_intervals(xy: np.ndarray, point: np.ndarray, eps: float) -> list[tuple[float, float]]:
    """Parts of a path, in positions 0 to n - 1, within ``eps`` of a point, touching ones joined."""
    out: list[list[float]] = []
    for i in range(len(xy) - 1):
        got = disc_interval(point, xy[i], xy[i + 1], eps)
        if got:
            a, b = i + got[0], i + got[1]
            if out and a <= out[-1][1] + 1e-12:
                out[-1][1] = max(out[-1][1], b)
            else:
                out.append([a, b])
    return [(a, b) for a, b in out]


def along_edge(xy: np.ndarray, a: np.ndarray, b: np.ndarray, start: float, white_b: list[tuple[float, float]], eps: float) -> list[float]:
    """The earliest path positions at which b can be reached on the edge a-b from path position ``start``, one in each interval near b that can be.

    Going along, the position on the edge never falls, so at each path vertex the
    reachable part of the edge begins at the largest lower bound so far. One may also stay on the
    edge while the path leaves b and comes again.
    """
    n = len(xy) - 1
    low, i, at, k = 0.0, min(int(start), n), start, 0
    found = []
    while True:
        while k < len(white_b) and white_b[k][0] <= i + 1:
            p, q = white_b[k]
            if q >= at - 1e-12 and q >= i:
                found.append(max(p, at))
            k += 1
        if i >= n or k >= len(white_b):
            return found
        got = disc_interval(xy[i + 1], a, b, eps)
        if got is None or got[1] < low - 1e-12:
            return found
        low = max(low, got[0])
        i += 1
        at = float(i)


def has_walk(xy: np.ndarray, edges: np.ndarray, eps: float) -> bool:
    """Whether a walk along edges, from node to node, stays within Frechet distance ``eps`` of the path."""
    n = len(xy) - 1
    place: dict[int, np.ndarray] = {}
    out: dict[int, list[int]] = {}
    for row in near(xy, edges, eps):
        s, t = int(row[0]), int(row[1])
        place.setdefault(s, row[2:4])
        place.setdefault(t, row[4:6])
        out.setdefault(s, []).append(t)
    white = {v: path_intervals(xy, p, eps) for v, p in place.items()}
    seen: set[tuple[int, int]] = set()
    heap = [(0.0, v) for v, w in white.items() if w and w[0][0] <= 1e-9]
    heapq.heapify(heap)
    while heap:
        at, v = heapq.heappop(heap)
        k = next((k for k, (a, b) in enumerate(white[v]) if a - 1e-9 <= at <= b + 1e-9), None)
        if k is None or (v, k) in seen:
            continue
        seen.add((v, k))
        if white[v][k][1] >= n - 1e-9:
            return True
        for u in out.get(v, ()):
            for got in along_edge(xy, place[v], place[u], at, white[u], eps) if white[u] else ():
                heapq.heappush(heap, (got, u))
    return False


def is_near(xy: np.ndarray, edges: np.ndarray, eps: float) -> bool:
    """Whether every point of the path is within ``eps`` of an edge."""
    own = near(xy, edges, eps)[:, 2:]
    for i in range(len(xy) - 1):
        lo, hi = tube_intervals(xy[i], xy[i + 1], own, eps)
        ok = ~np.isnan(lo)
        order = np.argsort(lo[ok])
        lo, reach = lo[ok][order], np.maximum.accumulate(np.concatenate([[0.0], hi[ok][order]]))
        if (lo > reach[:-1] + 1e-9).any() and reach[int(np.argmax(lo > reach[:-1] + 1e-9))] < 1 - 1e-9 or reach[-1] < 1 - 1e-9:
            return False
    return True


def least_distance(xy: np.ndarray, edges: np.ndarray, kind: str, most: int) -> int | None:
    """Least whole number from 1 for which the test holds: doubling, then bisection, since tests are monotone."""
    test = has_walk if kind == "frechet" else is_near
    if len(xy) < 2 or not len(edges):
        return None
    hi = 1
    while not test(xy, edges, float(hi)):
        if hi >= most:
            return None
        hi = min(2 * hi, most)
    lo = hi // 2
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if test(xy, edges, float(mid)):
            hi = mid
        else:
            lo = mid
    return hi


def _disc(px: float, py: float, ax: float, ay: float, bx: float, by: float, eps: float) -> tuple[float, float] | None:
    """``curves.disc_interval`` on numbers."""
    dx, dy, rx, ry = bx - ax, by - ay, ax - px, ay - py
    qa, qb, qc = dx * dx + dy * dy, 2 * (dx * rx + dy * ry), rx * rx + ry * ry - eps * eps
    if qa == 0:
        return (0.0, 1.0) if qc <= 0 else None
    disc = qb * qb - 4 * qa * qc
    if disc < 0:
        return None
    root = math.sqrt(disc)
    lo, hi = (-qb - root) / (2 * qa), (-qb + root) / (2 * qa)
    lo, hi = (lo if lo > 0.0 else 0.0), (hi if hi < 1.0 else 1.0)
    return (lo, hi) if lo <= hi else None


def _walk(xy: list[tuple[float, float]], place: dict[int, tuple[float, float]], out: dict[int, list[int]], starts: list[int], eps: float) -> bool:
    """``has_walk`` on numbers, with the intervals of those nodes alone that a walk from the given starts meets."""
    n = len(xy) - 1
    whites: dict[int, list[tuple[float, float]]] = {}

    def white(v: int) -> list[tuple[float, float]]:
        if v not in whites:
            px, py = place[v]
            found: list[tuple[float, float]] = []
            for i in range(n):
                if got := _disc(px, py, *xy[i], *xy[i + 1], eps):
                    a, b = i + got[0], i + got[1]
                    if found and a <= found[-1][1] + 1e-12:
                        found[-1] = (found[-1][0], max(found[-1][1], b))
                    else:
                        found.append((a, b))
            whites[v] = found
        return whites[v]

    def along(v: int, u: int, start: float) -> list[float]:
        low, i, at, k = 0.0, min(int(start), n), start, 0
        found, there = [], white(u)
        while True:
            while k < len(there) and there[k][0] <= i + 1:
                p, q = there[k]
                if q >= at - 1e-12 and q >= i:
                    found.append(max(p, at))
                k += 1
            if i >= n or k >= len(there):
                return found
            got = _disc(*xy[i + 1], *place[v], *place[u], eps)
            if got is None or got[1] < low - 1e-12:
                return found
            low = max(low, got[0])
            i += 1
            at = float(i)

    heap = [(0.0, v) for v in starts if (w := white(v)) and w[0][0] <= 1e-9]
    heapq.heapify(heap)
    seen: set[tuple[int, int]] = set()
    while heap:
        at, v = heapq.heappop(heap)
        k = next((k for k, (a, b) in enumerate(white(v)) if a - 1e-9 <= at <= b + 1e-9), None)
        if k is None or (v, k) in seen:
            continue
        seen.add((v, k))
        if white(v)[k][1] >= n - 1e-9:
            return True
        for u in out.get(v, ()):
            for got in along(v, u, at):
                heapq.heappush(heap, (got, u))
    return False


def least_walks(lines: list[np.ndarray], edges: np.ndarray, most: int) -> list[int | None]:
    """``least_distance`` of kind "frechet" for many lines in one graph.

    A walk begins and ends at a node, so no distance is below those of the ends of a line to
    the nearest nodes: the search goes up from there.
    """
    place: dict[int, tuple[float, float]] = {}
    out: dict[int, list[int]] = {}
    for s, t, ax, ay, bx, by in edges.tolist():
        place.setdefault(int(s), (ax, ay))
        place.setdefault(int(t), (bx, by))
        out.setdefault(int(s), []).append(int(t))
    ids, at = list(place), np.array(list(place.values())).reshape(-1, 2)
    found: list[int | None] = [None] * len(lines)
    own = [k for k, xy in enumerate(lines) if len(xy) > 1] if ids else []
    first, last = (np.hypot(*(at.T[:, None, :] - np.array([lines[k][e] for k in own]).reshape(-1, 2).T[:, :, None])) for e in (0, -1))
    bounds = np.maximum(1, np.ceil(np.maximum(first.min(axis=1, initial=np.inf), last.min(axis=1, initial=np.inf)) - 1e-6)) if own else []
    for number, (k, least) in enumerate(zip(own, bounds, strict=True)):
        if least > most:
            continue
        least = int(least)
        points, away = list(map(tuple, lines[k].tolist())), first[number]
        test = lambda eps: _walk(points, place, out, [ids[v] for v in np.flatnonzero(away <= eps + 1e-6)], float(eps))  # noqa: B023, E731
        lo, hi, step = least - 1, least, 1
        while hi <= most and not test(hi):
            lo, hi, step = hi, (most if lo < most < hi + step else hi + step), 2 * step
            if lo == most:
                hi = most + 1
        if hi > most:
            continue
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if test(mid) else (mid, hi)
        found[k] = hi
    return found


def least_cover(lines: list[np.ndarray], edges: np.ndarray, most: int) -> list[int | None]:
    """``least_distance`` of kind "hausdorff" for many lines: all their segments are tested at once, each at its line's distance."""
    ends = np.unique(np.where((edges[:, 2:3] < edges[:, 4:5]) | (edges[:, 2:3] == edges[:, 4:5]) & (edges[:, 3:4] <= edges[:, 5:6]), edges[:, 2:6], edges[:, [4, 5, 2, 3]]), axis=0) if len(edges) else np.zeros((0, 4))
    own = [k for k, xy in enumerate(lines) if len(xy) > 1] if len(ends) else []
    a = np.concatenate([np.zeros((0, 2)), *[lines[k][:-1] for k in own]])
    b = np.concatenate([np.zeros((0, 2)), *[lines[k][1:] for k in own]])
    line = np.repeat(np.arange(len(own)), [len(lines[k]) - 1 for k in own])
    low_e, high_e = np.minimum(ends[:, :2], ends[:, 2:]), np.maximum(ends[:, :2], ends[:, 2:])
    low_s, high_s = np.minimum(a, b), np.maximum(a, b)

    def pairs_of(segs: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
        met = np.ones((len(segs), len(ends)), bool)
        for axis in (0, 1):
            met &= (low_e[None, :, axis] <= high_s[segs, axis, None] + eps) & (high_e[None, :, axis] >= low_s[segs, axis, None] - eps)
        i, j = np.nonzero(met)
        return segs[i], j

    def covered(segs: np.ndarray, i: np.ndarray, j: np.ndarray, eps: np.ndarray) -> np.ndarray:
        """Of the segments ``segs``, given by pairs with edges, those covered at ``eps`` of each segment."""
        number = np.zeros(len(a), int)
        number[segs] = np.arange(len(segs))
        lo, hi = _tubes(a[i], b[i], ends[j, :2], ends[j, 2:], eps[number[i]])
        ok = ~np.isnan(lo)
        at, lo, hi = number[i][ok], lo[ok], hi[ok]
        base = 2.0 * np.arange(len(segs))
        order = np.lexsort((lo, at))
        at, lo, hi = at[order], lo[order] + base[at[order]], hi[order] + base[at[order]]
        # a segment's reach begins at its base, above all that came before
        reach = np.maximum.accumulate(hi) if len(hi) else hi
        before = np.maximum(np.concatenate([[0.0], reach[:-1]])[: len(reach)], base[at])
        bad = np.ones(len(segs), bool)
        if len(at):
            last = np.append(at[1:] != at[:-1], True)
            bad[at[last]] = reach[last] < base[at[last]] + 1 - 1e-9
            bad[at[lo > before + 1e-9]] = True
        return ~bad

    found: list[int | None] = [None] * len(lines)
    # pairs at a first reach are held; few lines go on beyond it
    first, held = min(most, 16), []
    for part in np.array_split(np.arange(len(a)), max(1, -(-len(a) * len(ends) // 4_000_000))):
        i, j = pairs_of(part, float(first))
        held.append((part, i - (part[0] if len(part) else 0), j))
    lo, hi = np.zeros(len(own), int), np.full(len(own), min(8, most))
    settled = np.zeros(len(own), bool)  # whether hi is known to do
    active = np.ones(len(own), bool)
    while active.any():
        eps = np.where(settled, (lo + hi) // 2, hi)
        good = np.ones(len(own), bool)
        segs = np.flatnonzero(active[line])
        far = eps[line] > first
        for part in np.array_split(segs[far[segs]], max(1, -(-len(segs) * len(ends) // 4_000_000))):
            if len(part):
                each = eps[line[part]].astype(float)
                good[line[part[~covered(part, *pairs_of(part, float(each.max())), each)]]] = False
        for part, i, j in held:
            use = active[line[part]] & ~far[part]
            if use.any():
                some = use[i]
                good[line[part[use][~covered(part[use], part[i[some]], j[some], eps[line[part[use]]].astype(float))]]] = False
        for_hi = active & good
        hi[for_hi], settled[for_hi] = eps[for_hi], True
        bad = active & ~good
        lo[bad] = eps[bad]
        up = bad & ~settled
        active[up & (hi >= most)] = False
        hi[up] = np.minimum(2 * hi[up], most)
        active &= ~settled | (hi - lo > 1)
    for k, n, ok in zip(own, hi.tolist(), settled.tolist(), strict=True):
        found[k] = n if ok else None
    return found


def _tubes(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray, eps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``tube_intervals`` of rows, each a segment a-b, a segment c-d and an ``eps``."""
    (ax, ay), (bx, by), (cx, cy), (dx, dy) = a.T, b.T, c.T, d.T
    wx, wy = dx - cx, dy - cy
    size = np.hypot(wx, wy)
    some = np.where(size > 0, size, 1)
    ux, uy = wx / some, wy / some
    lo, hi = np.zeros(len(a)), np.ones(len(a))
    with np.errstate(divide="ignore", invalid="ignore"):
        for px, py, least, most in ((ux, uy, 0.0, size), (-uy, ux, -eps, eps)):
            v0, v1 = (ax - cx) * px + (ay - cy) * py, (bx - cx) * px + (by - cy) * py
            step = v1 - v0
            x, y = (least - v0) / step, (most - v0) / step
            flat, inside = step == 0, (least <= v0) & (v0 <= most)
            lo = np.maximum(lo, np.where(flat, np.where(inside, 0.0, 2.0), np.minimum(x, y)))
            hi = np.minimum(hi, np.where(flat, np.where(inside, 1.0, -1.0), np.maximum(x, y)))
        strip = (lo <= hi) & (size > 0)
        parts = [(np.where(strip, lo, NONE), np.where(strip, hi, NONE))]
        ex, ey = bx - ax, by - ay
        qa = ex * ex + ey * ey
        for px, py in ((cx, cy), (dx, dy)):
            rx, ry = ax - px, ay - py
            qb, qc = 2 * (rx * ex + ry * ey), rx * rx + ry * ry - eps * eps
            root = np.sqrt(np.where(qb * qb - 4 * qa * qc >= 0, qb * qb - 4 * qa * qc, NONE))
            p, q = np.maximum(0.0, (-qb - root) / (2 * qa)), np.minimum(1.0, (-qb + root) / (2 * qa))
            p, q = np.where(qa == 0, np.where(qc <= 0, 0.0, NONE), p), np.where(qa == 0, np.where(qc <= 0, 1.0, NONE), q)
            ok = p <= q
            parts.append((np.where(ok, p, NONE), np.where(ok, q, NONE)))
    return np.fmin.reduce([p[0] for p in parts]), np.fmax.reduce([p[1] for p in parts])


def least_distances(lines: list[np.ndarray], edges: np.ndarray, kind: str, most: int, size: float = 600.0) -> list[int | None]:
    """``least_distance`` of many lines, by cells of their first points, each with the edges in reach of its lines."""
    cells: dict[tuple[int, int], list[int]] = {}
    found: list[int | None] = [None] * len(lines)
    for k, xy in enumerate(lines):
        if len(xy) > 1 and len(edges):
            cells.setdefault((math.floor(xy[0, 0] / size), math.floor(xy[0, 1] / size)), []).append(k)
    for own in cells.values():
        mine = [lines[k] for k in own]
        got = (least_walks if kind == "frechet" else least_cover)(mine, near(np.concatenate(mine), edges, float(most)), most)
        for k, d in zip(own, got, strict=True):
            found[k] = d
    return found
