"""Geographic and planar column expressions; everything stays inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS = 6_371_000.0


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x)) if isinstance(x, (int, float)) else F.col(x)


def _args(*xs) -> list[Column]:
    return [_c(x) for x in xs]


def haversine(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle metres, in the form that is stable for short distances."""
    lat1, lon1, lat2, lon2 = _args(lat1, lon1, lat2, lon2)
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.when((lat1 == lat2) & (lon1 == lon2), 0.0).otherwise(2 * EARTH_RADIUS * F.atan2(F.sqrt(a), F.sqrt(1 - a)))


def law_of_cosines(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle metres by the spherical law of cosines; the cosine is clamped."""
    lat1, lon1, lat2, lon2 = _args(lat1, lon1, lat2, lon2)
    c = F.sin(F.radians(lat1)) * F.sin(F.radians(lat2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(F.radians(lon2 - lon1))
    return EARTH_RADIUS * F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))


def flat_distance(lat1, lon1, lat2, lon2, per_lat: float, per_lon: float) -> Column:
    """Metres with fixed lengths of a degree of latitude and of longitude."""
    lat1, lon1, lat2, lon2 = _args(lat1, lon1, lat2, lon2)
    return F.sqrt(F.pow((lat2 - lat1) * per_lat, 2) + F.pow((lon2 - lon1) * per_lon, 2))


def bearing(lat1, lon1, lat2, lon2) -> Column:
    """Initial bearing in degrees, 0 to 360."""
    lat1, lon1, lat2, lon2 = _args(lat1, lon1, lat2, lon2)
    y = F.sin(F.radians(lon2 - lon1)) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(F.radians(lon2 - lon1))
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def bearing_difference(a, b) -> Column:
    """Smallest angle between two bearings."""
    d = F.abs(_c(a) - _c(b)) % 360
    return F.least(d, 360 - d)


def destination_lat(lat, degrees, metres) -> Column:
    lat, degrees, metres = _args(lat, degrees, metres)
    d = metres / EARTH_RADIUS
    return F.degrees(F.asin(F.sin(F.radians(lat)) * F.cos(d) + F.cos(F.radians(lat)) * F.sin(d) * F.cos(F.radians(degrees))))


def destination_lon(lat, lon, degrees, metres) -> Column:
    lat, lon, degrees, metres = _args(lat, lon, degrees, metres)
    d = metres / EARTH_RADIUS
    lat2 = F.radians(destination_lat(lat, degrees, metres))
    return lon + F.degrees(F.atan2(F.sin(F.radians(degrees)) * F.sin(d) * F.cos(F.radians(lat)), F.cos(d) - F.sin(F.radians(lat)) * F.sin(lat2)))


def great_circle_crossing(lat1, lon1, bearing1, lat2, lon2, bearing2) -> Column:
    """Where two great circles, each from a point along a bearing, meet: struct of lat and lon; null where there is no single answer."""
    p1, l1, t13, p2, l2, t23 = (F.radians(x) for x in _args(lat1, lon1, bearing1, lat2, lon2, bearing2))
    d12 = 2 * F.asin(F.sqrt(F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin((l2 - l1) / 2), 2)))

    def clamp(x: Column) -> Column:
        return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))

    some = lambda x: F.nullif(x, F.lit(0.0))
    ta = F.acos(clamp((F.sin(p2) - F.sin(p1) * F.cos(d12)) / some(F.sin(d12) * F.cos(p1))))
    tb = F.acos(clamp((F.sin(p1) - F.sin(p2) * F.cos(d12)) / some(F.sin(d12) * F.cos(p2))))
    east = F.sin(l2 - l1) > 0
    t12 = F.when(east, ta).otherwise(2 * F.pi() - ta)
    t21 = F.when(east, 2 * F.pi() - tb).otherwise(tb)
    a1 = F.pmod(t13 - t12 + F.pi(), 2 * F.pi()) - F.pi()
    a2 = F.pmod(t21 - t23 + F.pi(), 2 * F.pi()) - F.pi()
    a3 = F.acos(clamp(-F.cos(a1) * F.cos(a2) + F.sin(a1) * F.sin(a2) * F.cos(d12)))
    d13 = F.atan2(F.sin(d12) * F.sin(a1) * F.sin(a2), F.cos(a2) + F.cos(a1) * F.cos(a3))
    p3 = F.asin(clamp(F.sin(p1) * F.cos(d13) + F.cos(p1) * F.sin(d13) * F.cos(t13)))
    l3 = l1 + F.atan2(F.sin(t13) * F.sin(d13) * F.cos(p1), F.cos(d13) - F.sin(p1) * F.sin(p3))
    none = (d12 == 0) | ((F.sin(a1) == 0) & (F.sin(a2) == 0)) | (F.sin(a1) * F.sin(a2) < 0)
    return F.when(~none, F.struct(F.degrees(p3).alias("lat"), F.degrees(l3).alias("lon")))


def along(a, b, fraction) -> Column:
    """The value at a fraction of the way from ``a`` to ``b``."""
    a, b, fraction = _args(a, b, fraction)
    return a + (b - a) * fraction


def linspace(x1, y1, x2, y2, n: int) -> Column:
    """``n`` evenly spaced points from one end to the other: array of structs x, y."""
    x1, y1, x2, y2 = _args(x1, y1, x2, y2)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct((x1 + (x2 - x1) * i / (n - 1)).alias("x"), (y1 + (y2 - y1) * i / (n - 1)).alias("y")))


def segment_fraction(px, py, ax, ay, bx, by) -> Column:
    """Fraction along the infinite line a-b of the foot of the perpendicular from p; 0 for a single point."""
    px, py, ax, ay, bx, by = _args(px, py, ax, ay, bx, by)
    size = (bx - ax) * (bx - ax) + (by - ay) * (by - ay)
    return F.when(size == 0, 0.0).otherwise(((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / size)


def clamped(fraction: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), fraction))


def segment_distance(lat, lon, lat1, lon1, lat2, lon2) -> Column:
    """Great-circle metres from a point to its projection onto a finite segment in the degree plane."""
    lat, lon, lat1, lon1, lat2, lon2 = _args(lat, lon, lat1, lon1, lat2, lon2)
    f = clamped(segment_fraction(lon, lat, lon1, lat1, lon2, lat2))
    return haversine(lat, lon, along(lat1, lat2, f), along(lon1, lon2, f))


def line_projection(lat, lon, lat1, lon1, lat2, lon2) -> Column:
    """Projection onto the infinite line by bearings: struct of lat, lon, fraction of the segment's length, and distance in metres."""
    lat, lon, lat1, lon1, lat2, lon2 = _args(lat, lon, lat1, lon1, lat2, lon2)
    base = bearing(lat1, lon1, lat2, lon2)
    length = haversine(lat1, lon1, lat2, lon2)
    away = haversine(lat1, lon1, lat, lon)
    turn = F.radians(bearing(lat1, lon1, lat, lon) - base)
    run = away * F.cos(turn)
    return F.struct(
        destination_lat(lat1, base, run).alias("lat"),
        destination_lon(lat1, lon1, base, run).alias("lon"),
        F.when(length > 0, run / length).otherwise(0.0).alias("fraction"),
        F.abs(away * F.sin(turn)).alias("distance"),
    )


def cross(ax, ay, bx, by, cx, cy) -> Column:
    """Twice the signed area of a triangle; positive if it turns left."""
    ax, ay, bx, by, cx, cy = _args(ax, ay, bx, by, cx, cy)
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def ccw(ax, ay, bx, by, cx, cy) -> Column:
    return cross(ax, ay, bx, by, cx, cy) > 0


def segments_cross(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Whether two segments cross properly."""
    return (ccw(ax, ay, cx, cy, dx, dy) != ccw(bx, by, cx, cy, dx, dy)) & (ccw(ax, ay, bx, by, cx, cy) != ccw(ax, ay, bx, by, dx, dy))


def cosine(ux, uy, vx, vy) -> Column:
    """Cosine between two vectors; null if either has no length."""
    ux, uy, vx, vy = _args(ux, uy, vx, vy)
    size = F.sqrt(ux * ux + uy * uy) * F.sqrt(vx * vx + vy * vy)
    return F.when(size > 0, (ux * vx + uy * vy) / size)


def vector_angle(ux, uy, vx, vy) -> Column:
    """Angle between two vectors in degrees."""
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine(ux, uy, vx, vy)))))


def line_crossing(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Where two infinite lines meet, by Cramer's rule: struct x, y; null for parallels."""
    ax, ay, bx, by, cx, cy, dx, dy = _args(ax, ay, bx, by, cx, cy, dx, dy)
    a1, b1, c1 = ay - by, bx - ax, ax * by - bx * ay
    a2, b2, c2 = cy - dy, dx - cx, cx * dy - dx * cy
    det = a1 * b2 - b1 * a2
    return F.when(det != 0, F.struct(((b1 * c2 - c1 * b2) / det).alias("x"), ((c1 * a2 - a1 * c2) / det).alias("y")))


def line_angle(x1, y1, x2, y2) -> Column:
    """Direction of a line in degrees, 0 to 360, anticlockwise from the x axis."""
    x1, y1, x2, y2 = _args(x1, y1, x2, y2)
    return F.pmod(F.degrees(F.atan2(y2 - y1, x2 - x1)), F.lit(360.0))


def speed(metres, seconds) -> Column:
    """Metres a second, whole seconds of at least one."""
    return _c(metres) / F.greatest(F.floor(_c(seconds)), F.lit(1))


def utm(lat, lon, zone: int = 39) -> Column:
    """WGS84 to UTM north: struct of easting and northing, by Krueger's series to the third order."""
    lat, lon = _args(lat, lon)
    a, f = 6378137.0, 1 / 298.257223563
    n = f / (2 - f)
    big = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * n**0.5 / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    sin = F.sin(phi)
    atanh = lambda x: F.log((1 + x) / (1 - x)) / 2
    t = F.sinh(atanh(sin) - e * atanh(e * sin))
    xi = F.atan2(t, F.cos(lam))
    eta = atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, k in enumerate(alpha, 1):
        x = x + k * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + k * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.struct((500_000 + 0.9996 * big * x).alias("easting"), (0.9996 * big * y).alias("northing"))


def polyline_length(points: Column, x: str = "x", y: str = "y") -> Column:
    """Planar length of an array of points."""
    n = F.size(points)
    steps = F.when(n > 1, F.zip_with(F.slice(points, 1, n - 1), F.slice(points, 2, n - 1), lambda p, q: F.sqrt((q[x] - p[x]) * (q[x] - p[x]) + (q[y] - p[y]) * (q[y] - p[y]))))
    return F.coalesce(F.aggregate(steps, F.lit(0.0), lambda s, d: s + d), F.lit(0.0))
