"""Plane geometry as columns: points, angles, lines, edges, boxes, circles, polygons.

Points are structs of x and y, lines structs of a point and a direction (x, y, dx,
dy), edges of two places (x1, y1, x2, y2), boxes of bounds (x0, x1, y0, y1), circles
of a centre and a radius (x, y, r), polygons and polylines arrays of points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(x, y) -> Column:
    return F.struct(_n(x).alias("x"), _n(y).alias("y"))


def _n(v) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def _cross(ax, ay, bx, by) -> Column:
    return ax * by - ay * bx


# points


def distance(p: Column, q: Column) -> Column:
    return F.sqrt((p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"]))


def midpoint(p: Column, q: Column) -> Column:
    return point((p["x"] + q["x"]) / 2, (p["y"] + q["y"]) / 2)


def polar(centre: Column, radius, angle) -> Column:
    """The place at a distance and an angle (radians) from a centre."""
    return point(centre["x"] + _n(radius) * F.cos(_n(angle)), centre["y"] + _n(radius) * F.sin(_n(angle)))


def is_ccw(p: Column, q: Column, r: Column, tolerance: float = 0.0) -> Column:
    """1 if the turn p-q-r is to the left, -1 to the right, 0 if the three are in line."""
    c = _cross(q["x"] - p["x"], q["y"] - p["y"], r["x"] - p["x"], r["y"] - p["y"])
    return F.when(c > tolerance, 1).when(c < -tolerance, -1).otherwise(0)


def transformed(p: Column, m: tuple[float, float, float, float, float, float]) -> Column:
    """Affine image: (a b c; d e f) times (x, y, 1)."""
    a, b, c, d, e, f = m
    return point(a * p["x"] + b * p["y"] + c, d * p["x"] + e * p["y"] + f)


def rotation(angle: float, centre: tuple[float, float] = (0.0, 0.0)) -> tuple[float, float, float, float, float, float]:
    import math

    c, s = math.cos(angle), math.sin(angle)
    x, y = centre
    return c, -s, x - c * x + s * y, s, c, y - s * x - c * y


# angles, in radians


def normalised_angle(a, centre: float = 3.141592653589793) -> Column:
    """An angle within half a turn of ``centre``."""
    half, turn = 3.141592653589793, 6.283185307179586
    return F.pmod(_n(a) - centre + half, F.lit(turn)) + centre - half


def angle_of(p: Column, q: Column) -> Column:
    """Direction from p to q, 0 to a full turn."""
    return normalised_angle(F.atan2(q["y"] - p["y"], q["x"] - p["x"]))


def angle_between(p: Column, q: Column, r: Column) -> Column:
    """The turn from q-p to q-r."""
    return normalised_angle(angle_of(q, r) - angle_of(q, p))


def angle_difference(a, b) -> Column:
    """Signed turn from a to b, at most half a turn either way."""
    return normalised_angle(_n(b) - _n(a), 0.0)


# lines


def line(p: Column, q: Column) -> Column:
    return F.struct(p["x"].alias("x"), p["y"].alias("y"), (q["x"] - p["x"]).alias("dx"), (q["y"] - p["y"]).alias("dy"))


def line_position(p: Column, ln: Column) -> Column:
    """Where the foot of the perpendicular lies, in units of the line's direction."""
    return ((p["x"] - ln["x"]) * ln["dx"] + (p["y"] - ln["y"]) * ln["dy"]) / (ln["dx"] * ln["dx"] + ln["dy"] * ln["dy"])


def projected(p: Column, ln: Column) -> Column:
    t = line_position(p, ln)
    return point(ln["x"] + t * ln["dx"], ln["y"] + t * ln["dy"])


def line_distance(p: Column, ln: Column) -> Column:
    """Signed distance, positive to the right of the line."""
    return _cross(p["x"] - ln["x"], p["y"] - ln["y"], ln["dx"], ln["dy"]) / F.sqrt(ln["dx"] * ln["dx"] + ln["dy"] * ln["dy"])


def meeting(a: Column, b: Column) -> Column:
    """Where two lines meet; null for parallels."""
    det = _cross(a["dx"], a["dy"], b["dx"], b["dy"])
    t = _cross(b["x"] - a["x"], b["y"] - a["y"], b["dx"], b["dy"]) / det
    return F.when(det != 0, point(a["x"] + t * a["dx"], a["y"] + t * a["dy"]))


def parallel_line(ln: Column, by: float) -> Column:
    """A line moved to its right."""
    n = F.sqrt(ln["dx"] * ln["dx"] + ln["dy"] * ln["dy"])
    return F.struct((ln["x"] + ln["dy"] / n * by).alias("x"), (ln["y"] - ln["dx"] / n * by).alias("y"), ln["dx"].alias("dx"), ln["dy"].alias("dy"))


def perpendicular_line(ln: Column, p: Column) -> Column:
    return F.struct(p["x"].alias("x"), p["y"].alias("y"), (-ln["dy"]).alias("dx"), ln["dx"].alias("dy"))


def bisecting_line(p: Column, q: Column) -> Column:
    """The line of places equally far from p and q."""
    m = midpoint(p, q)
    return F.struct(m["x"].alias("x"), m["y"].alias("y"), (-(q["y"] - p["y"])).alias("dx"), (q["x"] - p["x"]).alias("dy"))


# edges


def edge(p: Column, q: Column) -> Column:
    return F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2"))


def edge_length(e: Column) -> Column:
    return F.sqrt((e["x2"] - e["x1"]) * (e["x2"] - e["x1"]) + (e["y2"] - e["y1"]) * (e["y2"] - e["y1"]))


def edge_distance(p: Column, e: Column) -> Column:
    size = (e["x2"] - e["x1"]) * (e["x2"] - e["x1"]) + (e["y2"] - e["y1"]) * (e["y2"] - e["y1"])
    t = F.when(size == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((p["x"] - e["x1"]) * (e["x2"] - e["x1"]) + (p["y"] - e["y1"]) * (e["y2"] - e["y1"])) / size)))
    return distance(p, point(e["x1"] + t * (e["x2"] - e["x1"]), e["y1"] + t * (e["y2"] - e["y1"])))


def clipped_edge(e: Column, box: tuple[float, float, float, float]) -> Column:
    """The part of an edge inside a box (x0, x1, y0, y1); null if there is none."""
    x0, x1, y0, y1 = box
    dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
    lo, hi, out = F.lit(0.0), F.lit(1.0), F.lit(False)
    for start, step, a, b in ((e["x1"], dx, x0, x1), (e["y1"], dy, y0, y1)):
        flat = step == 0
        lo = F.greatest(lo, F.when(flat, 0.0).otherwise(F.least((a - start) / step, (b - start) / step)))
        hi = F.least(hi, F.when(flat, 1.0).otherwise(F.greatest((a - start) / step, (b - start) / step)))
        out = out | (flat & ~start.between(a, b))
    return F.when(~out & (lo <= hi), F.struct((e["x1"] + lo * dx).alias("x1"), (e["y1"] + lo * dy).alias("y1"), (e["x1"] + hi * dx).alias("x2"), (e["y1"] + hi * dy).alias("y2")))


# circles


def circumcircle(p: Column, q: Column, r: Column) -> Column:
    """The circle through three points; null if they are in line."""
    bx, by, cx, cy = q["x"] - p["x"], q["y"] - p["y"], r["x"] - p["x"], r["y"] - p["y"]
    d = 2 * _cross(bx, by, cx, cy)
    ux, uy = (cy * (bx * bx + by * by) - by * (cx * cx + cy * cy)) / d, (bx * (cx * cx + cy * cy) - cx * (bx * bx + by * by)) / d
    return F.when(d != 0, F.struct((p["x"] + ux).alias("x"), (p["y"] + uy).alias("y"), F.sqrt(ux * ux + uy * uy).alias("r")))


def inside_circle(p: Column, c: Column) -> Column:
    return distance(p, c) <= c["r"]


def circle_crossings(a: Column, b: Column) -> Column:
    """The two places where circles meet (one twice if they touch); null if they don't."""
    d = distance(a, b)
    t = (a["r"] * a["r"] - b["r"] * b["r"] + d * d) / (2 * d)
    h2 = a["r"] * a["r"] - t * t
    ux, uy = (b["x"] - a["x"]) / d, (b["y"] - a["y"]) / d
    h = F.sqrt(h2)
    return F.when((d > 0) & (h2 >= 0), F.array(point(a["x"] + t * ux - h * uy, a["y"] + t * uy + h * ux), point(a["x"] + t * ux + h * uy, a["y"] + t * uy - h * ux)))


def circle_polygon(c: Column, n: int) -> Column:
    """``n`` points around a circle."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: point(c["x"] + c["r"] * F.cos(i * (2 * 3.141592653589793 / n)), c["y"] + c["r"] * F.sin(i * (2 * 3.141592653589793 / n))))


# polygons and polylines


def _next(poly: Column) -> Column:
    """Each point's successor, the first after the last."""
    return F.concat(F.slice(poly, 2, F.size(poly)), F.slice(poly, 1, 1))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def signed_area(poly: Column) -> Column:
    """Positive if the points go anticlockwise."""
    return _sum(F.zip_with(poly, _next(poly), lambda p, q: p["x"] * q["y"] - p["y"] * q["x"])) / 2


def perimeter(poly: Column) -> Column:
    return _sum(F.zip_with(poly, _next(poly), distance))


def polygon_centroid(poly: Column) -> Column:
    """Centre of mass; null without area."""
    a = signed_area(poly)
    cx, cy = (_sum(F.zip_with(poly, _next(poly), _moment(c))) for c in ("x", "y"))
    return F.when(a != 0, point(cx / (6 * a), cy / (6 * a)))


def _moment(c: str):
    def f(p: Column, q: Column) -> Column:
        return (p[c] + q[c]) * (p["x"] * q["y"] - p["y"] * q["x"])

    return f


def bounds(points: Column) -> Column:
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"), F.array_min(ys).alias("y0"), F.array_max(ys).alias("y1"))


def inside_polygon(p: Column, poly: Column) -> Column:
    """Whether a point is inside, by the parity of edges to its right."""
    crossed = F.zip_with(poly, _next(poly), lambda a, b: F.when((a["y"] > p["y"]) != (b["y"] > p["y"]), (p["x"] < (b["x"] - a["x"]) * (p["y"] - a["y"]) / (b["y"] - a["y"]) + a["x"]).cast("int")).otherwise(0))
    return F.aggregate(crossed, F.lit(0), lambda s, v: s + v) % 2 == 1


def reversed_polygon(poly: Column) -> Column:
    return F.reverse(poly)


def merged_boxes(a: Column, b: Column) -> Column:
    return F.struct(F.least(a["x0"], b["x0"]).alias("x0"), F.greatest(a["x1"], b["x1"]).alias("x1"), F.least(a["y0"], b["y0"]).alias("y0"), F.greatest(a["y1"], b["y1"]).alias("y1"))


def box_overlap(a: Column, b: Column) -> Column:
    """The common box; null if there is none."""
    x0, x1, y0, y1 = F.greatest(a["x0"], b["x0"]), F.least(a["x1"], b["x1"]), F.greatest(a["y0"], b["y0"]), F.least(a["y1"], b["y1"])
    return F.when((x0 <= x1) & (y0 <= y1), F.struct(x0.alias("x0"), x1.alias("x1"), y0.alias("y0"), y1.alias("y1")))
