"""Scalar functions and geometry over the bound tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions import codec, geo, stats
from trackloom.operators import geometry, trajectories
from trackloom.plans.catalog_basic import BOXES, SEGMENTS, metric_points, segments
from trackloom.plans.registry import query
from trackloom.plans.relations import edges, gps, hav, k, micro, points2d, sql, table, thousandths, u

LEAD = ", n AS (SELECT *, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2, lead(us) OVER w AS us2 FROM gps WINDOW w AS (PARTITION BY route_id ORDER BY us, event_id) QUALIFY lat2 IS NOT NULL)\n"
BEARING = "(((degrees(atan2(sin(radians(lon2 - lon1)) * cos(radians(lat2)), cos(radians(lat1)) * sin(radians(lat2)) - sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon2 - lon1)))) % 360e0) + 360e0) % 360e0)"


def steps(spark, d):
    w = trajectories.by_route()
    own = gps(spark, d).withColumns({f"{c}2": F.lead(c).over(w) for c in ("lat", "lon", "us")})
    return own.where("lat2 IS NOT NULL").withColumnsRenamed({"lat": "lat1", "lon": "lon1"})


def bearing_sql(lat1, lon1, lat2, lon2):
    return BEARING.replace("lat1", "@a").replace("lon1", "@b").replace("lat2", "@c").replace("lon2", "@d").replace("@a", lat1).replace("@b", lon1).replace("@c", lat2).replace("@d", lon2)


@query("SC-01", sql("gps", LEAD + f"SELECT event_id, {k(hav('lat', 'lon', 'lat2', 'lon2'))} AS dist FROM n"))
def haversine(spark, d):
    return steps(spark, d).select("event_id", thousandths(geo.haversine("lat1", "lon1", "lat2", "lon2")).alias("dist"))


@query("SC-02", sql("gps", LEAD + "SELECT event_id, CAST(round(6371000e0 * acos(greatest(-1e0, least(1e0, sin(radians(lat)) * sin(radians(lat2)) + cos(radians(lat)) * cos(radians(lat2)) * cos(radians(lon2 - lon)))))) AS BIGINT) AS dist FROM n"))
def law_of_cosines(spark, d):
    return steps(spark, d).select("event_id", F.round(geo.law_of_cosines("lat1", "lon1", "lat2", "lon2")).cast("long").alias("dist"))


@query("SC-03", sql("gps", LEAD + f"SELECT event_id, {k('sqrt(pow((lat2 - lat) * 111070.34306591158e0, 2) + pow((lon2 - lon) * 83044.98918812413e0, 2))')} AS dist FROM n"))
def flat_distance(spark, d):
    return steps(spark, d).select("event_id", thousandths(geo.flat_distance("lat1", "lon1", "lat2", "lon2", 111070.34306591158, 83044.98918812413)).alias("dist"))


@query("SC-04", sql("gps", LEAD + f"SELECT event_id, {k(bearing_sql('lat', 'lon', 'lat2', 'lon2'))} AS bearing FROM n"))
def bearing(spark, d):
    return steps(spark, d).select("event_id", thousandths(geo.bearing("lat1", "lon1", "lat2", "lon2")).alias("bearing"))


@query("SC-05", sql("gps", f"SELECT event_id, {k('least(abs(value - route_id) % 360, 360 - abs(value - route_id) % 360)')} AS difference FROM gps"))
def bearing_difference(spark, d):
    return gps(spark, d).select("event_id", thousandths(geo.bearing_difference("value", F.col("route_id"))).alias("difference"))


LAT2 = "degrees(asin(sin(radians(lat)) * cos(value / 6371000e0) + cos(radians(lat)) * sin(value / 6371000e0) * cos(radians(value % 360))))"


@query("SC-06", sql("gps", f"SELECT event_id, {u(LAT2)} AS lat2, {u(f'lon + degrees(atan2(sin(radians(value % 360)) * sin(value / 6371000e0) * cos(radians(lat)), cos(value / 6371000e0) - sin(radians(lat)) * sin(radians({LAT2}))))')} AS lon2 FROM gps"))
def destination(spark, d):
    turn = F.col("value") % 360
    return gps(spark, d).select("event_id", micro(geo.destination_lat("lat", turn, "value")).alias("lat2"), micro(geo.destination_lon("lat", "lon", turn, "value")).alias("lon2"))


CROSSING = LEAD + """, r AS (SELECT event_id, radians(lat) AS p1, radians(lon) AS l1, radians(value % 360) AS t13, radians(lat2) AS p2, radians(lon2) AS l2, radians((value * 7) % 360) AS t23 FROM n),
s AS (SELECT *, 2 * asin(sqrt(pow(sin((p2 - p1) / 2), 2) + cos(p1) * cos(p2) * pow(sin((l2 - l1) / 2), 2))) AS d FROM r),
t AS (SELECT *, acos(greatest(-1e0, least(1e0, (sin(p2) - sin(p1) * cos(d)) / nullif(sin(d) * cos(p1), 0)))) AS ta, acos(greatest(-1e0, least(1e0, (sin(p1) - sin(p2) * cos(d)) / nullif(sin(d) * cos(p2), 0)))) AS tb FROM s),
a AS (SELECT *, t13 - CASE WHEN sin(l2 - l1) > 0 THEN ta ELSE 2 * pi() - ta END AS a1, CASE WHEN sin(l2 - l1) > 0 THEN 2 * pi() - tb ELSE tb END - t23 AS a2 FROM t),
b AS (SELECT *, acos(greatest(-1e0, least(1e0, sin(a1) * sin(a2) * cos(d) - cos(a1) * cos(a2)))) AS a3 FROM a),
c AS (SELECT *, atan2(sin(d) * sin(a1) * sin(a2), cos(a2) + cos(a1) * cos(a3)) AS far, d = 0 OR sin(a1) = 0 AND sin(a2) = 0 OR sin(a1) * sin(a2) < 0 AS none FROM b),
e AS (SELECT *, asin(greatest(-1e0, least(1e0, sin(p1) * cos(far) + cos(p1) * sin(far) * cos(t13)))) AS p3 FROM c)
"""
LON3 = "degrees(l1 + atan2(sin(t13) * sin(far) * cos(p1), cos(far) - sin(p1) * sin(p3)))"


@query("SC-07", sql("gps", CROSSING + f"SELECT event_id, CASE WHEN NOT none THEN {k('degrees(p3)')} END AS lat, CASE WHEN NOT none THEN {k(LON3)} END AS lon FROM e"))
def great_circle_crossing(spark, d):
    """Held against a vector computation in the tests."""
    own = steps(spark, d).withColumn("m", geo.great_circle_crossing("lat1", "lon1", F.col("value") % 360, "lat2", "lon2", (F.col("value") * 7) % 360))
    return own.select("event_id", thousandths(F.col("m.lat")).alias("lat"), thousandths(F.col("m.lon")).alias("lon"))


@query("SC-08", sql("gps", LEAD + f"SELECT event_id, {u('lat + (lat2 - lat) * 0.25e0')} AS lat, {u('lon + (lon2 - lon) * 0.25e0')} AS lon FROM n"))
def along(spark, d):
    return steps(spark, d).select("event_id", micro(geo.along("lat1", "lat2", 0.25)).alias("lat"), micro(geo.along("lon1", "lon2", 0.25)).alias("lon"))


@query("SC-09", sql("edges", f"SELECT edge_id, i AS n, {u('lon1 + (lon2 - lon1) * i / 8')} AS lon, {u('lat1 + (lat2 - lat1) * i / 8')} AS lat FROM edges, range(9) r(i)"))
def linspace(spark, d):
    own = edges(spark, d).select("edge_id", F.posexplode(geo.linspace("lon1", "lat1", "lon2", "lat2", 9)).alias("n", "p"))
    return own.select("edge_id", F.col("n").cast("long").alias("n"), micro(F.col("p.x")).alias("lon"), micro(F.col("p.y")).alias("lat"))


@query("SC-10", sql("gps", LEAD + f"SELECT event_id, {k(hav('lat', 'lon', 'lat2', 'lon2') + ' / greatest(floor((us2 - us) / 1e6), 1)')} AS speed FROM n"))
def speed(spark, d):
    return steps(spark, d).select("event_id", thousandths(geo.speed(geo.haversine("lat1", "lon1", "lat2", "lon2"), (F.col("us2") - F.col("us")) / 1_000_000)).alias("speed"))


@query("SC-11", sql("gps", f", n AS (SELECT event_id, route_id, us, lead(us) OVER w AS us2, lat, lon, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM gps WINDOW w AS (PARTITION BY route_id ORDER BY us, event_id)), m AS (SELECT *, CASE WHEN us2 IS NOT NULL THEN round({bearing_sql('lat', 'lon', 'lat2', 'lon2')}) % 360 END AS a FROM n)\nSELECT event_id, CAST(coalesce(a, lag(a) OVER (PARTITION BY route_id ORDER BY us, event_id)) AS BIGINT) AS azimuth FROM m"))
def azimuth(spark, d):
    return trajectories.motion(gps(spark, d), "route_id").select("event_id", F.col("azimuth").cast("long").alias("azimuth"))


UTM = """, c AS (SELECT 1 / 298.257223563e0 / (2 - 1 / 298.257223563e0) AS n),
h AS (SELECT event_id, sin(radians(lat)) AS s, radians(lon - 51) AS lam, n, 2 * sqrt(n) / (1 + n) AS e, 6378137e0 / (1 + n) * (1 + pow(n, 2) / 4 + pow(n, 4) / 64) AS big FROM gps, c),
t AS (SELECT *, sinh(ln((1 + s) / (1 - s)) / 2 - e * ln((1 + e * s) / (1 - e * s)) / 2) AS t FROM h),
x AS (SELECT *, atan2(t, cos(lam)) AS xi, ln((1 + sin(lam) / sqrt(1 + t * t)) / (1 - sin(lam) / sqrt(1 + t * t))) / 2 AS eta FROM t),
y AS (SELECT *, n / 2 - 2 * pow(n, 2) / 3 + 5 * pow(n, 3) / 16 AS a, 13 * pow(n, 2) / 48 - 3 * pow(n, 3) / 5 AS b, 61 * pow(n, 3) / 240 AS c FROM x)
"""
EAST = "500000 + 0.9996e0 * big * (eta + a * cos(2 * xi) * sinh(2 * eta) + b * cos(4 * xi) * sinh(4 * eta) + c * cos(6 * xi) * sinh(6 * eta))"
NORTH = "0.9996e0 * big * (xi + a * sin(2 * xi) * cosh(2 * eta) + b * sin(4 * xi) * cosh(4 * eta) + c * sin(6 * xi) * cosh(6 * eta))"


@query("SC-12", sql("gps", UTM + f"SELECT event_id, CAST(round({EAST}) AS BIGINT) AS easting, CAST(round({NORTH}) AS BIGINT) AS northing FROM y"))
def utm(spark, d):
    """Held against known points in the tests."""
    own = gps(spark, d).withColumn("p", geo.utm("lat", "lon", 39))
    return own.select("event_id", F.round("p.easting").cast("long").alias("easting"), F.round("p.northing").cast("long").alias("northing"))


ERF = "(sign({x}) * (1 - (1 / (1 + 0.3275911e0 * abs({x}))) * (0.254829592e0 + (1 / (1 + 0.3275911e0 * abs({x}))) * (-0.284496736e0 + (1 / (1 + 0.3275911e0 * abs({x}))) * (1.421413741e0 + (1 / (1 + 0.3275911e0 * abs({x}))) * (-1.453152027e0 + (1 / (1 + 0.3275911e0 * abs({x}))) * 1.061405429e0)))) * exp(-{x} * {x})))"


@query("SC-13", sql("gps", ", x AS (SELECT event_id, (value - 100) / 50 AS z FROM gps)\nSELECT event_id, {e} AS erf, {p} AS pdf, {c} AS cdf, {q} AS ccdf FROM x".format(e=u(ERF.format(x="z")), p=u("exp(-pow(z, 2) / 2) / (50 * sqrt(2 * pi())) * 1000"), c=u("(1 + " + ERF.format(x="(z / sqrt(2))") + ") / 2"), q=u("1 - (1 + " + ERF.format(x="(z / sqrt(2))") + ") / 2"))))
def normal(spark, d):
    x = F.col("value")
    return gps(spark, d).select("event_id", micro(stats.erf((x - 100) / 50)).alias("erf"), micro(stats.normal_pdf(x, 100, 50) * 1000).alias("pdf"), micro(stats.normal_cdf(x, 100, 50)).alias("cdf"), micro(stats.normal_ccdf(x, 100, 50)).alias("ccdf"))


@query("SC-14", sql("gps", f"SELECT event_id, {u('-0.05e0 * value')} AS force FROM gps"))
def spring(spark, d):
    return gps(spark, d).select("event_id", micro(stats.spring_force(F.col("value"), 0.05)).alias("force"))


VECTORS = ", v AS (SELECT a.id, a.x AS ux, a.y AS uy, b.x AS vx, b.y AS vy FROM points2d a JOIN points2d b ON b.id = a.id + 1)\n"


def vectors(spark, d):
    p = points2d(spark, d)
    b = p.select((F.col("id") - 1).alias("id"), F.col("x").alias("vx"), F.col("y").alias("vy"))
    return p.select("id", F.col("x").alias("ux"), F.col("y").alias("uy")).join(b, "id")


@query("SC-15", sql("points2d", VECTORS + f"SELECT id, (ux - 0) * (vy - 0) - (uy - 0) * (vx - 0) > 0 AS left, {u('(ux * vx + uy * vy) / (sqrt(ux * ux + uy * uy) * sqrt(vx * vx + vy * vy))')} AS cosine, {k('degrees(acos(greatest(-1e0, least(1e0, (ux * vx + uy * vy) / (sqrt(ux * ux + uy * uy) * sqrt(vx * vx + vy * vy))))))')} AS angle, {u('-uy')} AS nx, {u('ux')} AS ny FROM v"))
def vector_functions(spark, d):
    return vectors(spark, d).select("id", geo.ccw(0, 0, "ux", "uy", "vx", "vy").alias("left"), micro(geo.cosine("ux", "uy", "vx", "vy")).alias("cosine"), thousandths(geo.vector_angle("ux", "uy", "vx", "vy")).alias("angle"), micro(-F.col("uy")).alias("nx"), micro(F.col("ux")).alias("ny"))


@query("SC-16", sql("points2d", SEGMENTS.rstrip() + ", q AS (SELECT p.id, p.ay - p.by AS a1, p.bx - p.ax AS b1, p.ax * p.by - p.bx * p.ay AS c1, r.ay - r.by AS a2, r.bx - r.ax AS b2, r.ax * r.by - r.bx * r.ay AS c2 FROM s p JOIN s r ON r.id = p.id + 1)\nSELECT id, {x} AS x, {y} AS y FROM q WHERE abs(a1 * b2 - b1 * a2) > 1e0".format(x=k("(b1 * c2 - c1 * b2) / (a1 * b2 - b1 * a2)"), y=k("(c1 * a2 - a1 * c2) / (a1 * b2 - b1 * a2)"))))
def crossing_lines(spark, d):
    s = segments(spark, d)
    t = s.select((F.col("id") - 1).alias("id"), F.col("ax").alias("cx"), F.col("ay").alias("cy"), F.col("bx").alias("dx"), F.col("by").alias("dy"))
    ends = ("ax", "ay", "bx", "by", "cx", "cy", "dx", "dy")
    det = (F.col("ay") - F.col("by")) * (F.col("dx") - F.col("cx")) - (F.col("bx") - F.col("ax")) * (F.col("cy") - F.col("dy"))
    own = s.join(t, "id").where(F.abs(det) > 1).withColumn("m", geo.line_crossing(*ends))
    return own.select("id", thousandths(F.col("m.x")).alias("x"), thousandths(F.col("m.y")).alias("y"))


@query("SC-17", sql("crossings", ", m AS (SELECT id, string_agg(edge_id, ',' ORDER BY n, edge_id) AS txt FROM crossings GROUP BY id)\nSELECT id, txt, CAST(len(string_split(txt, ',')) AS BIGINT) AS n, CAST(list_sum(list_transform(string_split(txt, ','), lambda x: CAST(x AS BIGINT))) AS BIGINT) AS total FROM m"))
def lists_in_text(spark, d):
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.struct(F.col("l_linenumber").alias("n"), (F.col("l_partkey") * 4 + F.when(F.col("l_linenumber") % 2 == 0, 0).otherwise(2)).alias("edge")).alias("x"))
    own = line.groupBy("id").agg(F.array_sort(F.collect_list("x")).alias("x")).select("id", codec.listed(F.col("x.edge")).alias("txt")).withColumn("back", codec.numbers(F.col("txt"), "long"))
    return own.select("id", "txt", F.size("back").cast("long").alias("n"), F.aggregate("back", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query("SC-18", "SELECT event_id, epoch_us(date_trunc('second', ts)) // 1000000 AS at FROM events")
def leading_time(spark, d):
    text = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(".123456+00"))
    at = codec.leading_time(text)
    return table(spark, d, "events").select("event_id", at.alias("t")).select("event_id", F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', t)").alias("at"))


@query("SC-19", sql("gps", LEAD + "SELECT event_id, CAST(((floor((us - us2) / 1e6) % 86400) + 86400) % 86400 AS BIGINT) AS seconds FROM n"))
def wrapped_seconds(spark, d):
    return steps(spark, d).select("event_id", codec.seconds_of_day(F.col("us") - F.col("us2")).alias("seconds"))


@query("SC-20", sql("gps", "SELECT route_id, CAST(floor(min(lat)) AS BIGINT) || '_' || CAST(floor(min(lon)) AS BIGINT) || '_' || CAST(floor(max(lat)) AS BIGINT) || '_' || CAST(floor(max(lon)) AS BIGINT) AS name FROM gps GROUP BY route_id"))
def box_names(spark, d):
    return gps(spark, d).groupBy("route_id").agg(codec.box_name(F.min("lat"), F.min("lon"), F.max("lat"), F.max("lon")).alias("name"))


@query("SC-21", sql("gps", "SELECT event_id, 2211 - CAST(floor((lat - 35.71e0) * 80000e0) AS BIGINT) AS \"row\", CAST(floor((lon - 51.32e0) * 90000e0) AS BIGINT) AS col FROM gps"))
def pixels(spark, d):
    from trackloom.operators.raster import Grid

    grid = Grid(35.71, 51.32, 80_000.0, 90_000.0, 2211)
    return gps(spark, d).select("event_id", grid.row("lat").alias("row"), grid.col("lon").alias("col"))


@query("SC-22", sql("points2d", VECTORS + f"SELECT id, {k('((degrees(atan2(vy - uy, vx - ux)) % 360e0) + 360e0) % 360e0')} AS angle FROM v"))
def line_angles(spark, d):
    return vectors(spark, d).select("id", thousandths(geo.line_angle("ux", "uy", "vx", "vy")).alias("angle"))


PROJ = ", q AS (SELECT p.id, p.ax, p.ay, p.bx, p.by, r.ax AS px, r.ay AS py FROM s p JOIN s r ON r.id = p.id + 1), f AS (SELECT *, greatest(0e0, least(1e0, ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / ((bx - ax) * (bx - ax) + (by - ay) * (by - ay)))) AS f FROM q)\n"


def point_and_segment(spark, d):
    s = segments(spark, d)
    return s.join(s.select((F.col("id") - 1).alias("id"), F.col("ax").alias("px"), F.col("ay").alias("py")), "id")


@query("GE-01", sql("points2d", SEGMENTS.rstrip() + PROJ.replace("(by -", "(q.by -").replace("p.by, r", "p.by, r") + f"SELECT id, {u('ax + (bx - ax) * f')} AS x, {u('ay + (f.by - ay) * f')} AS y FROM f"))
def project(spark, d):
    f = geo.clamped(geo.segment_fraction("px", "py", "ax", "ay", "bx", "by"))
    return point_and_segment(spark, d).select("id", micro(geo.along("ax", "bx", f)).alias("x"), micro(geo.along("ay", "by", f)).alias("y"))


EDGE_POINT = ", c AS (SELECT a.edge_id, a.lat1, a.lon1, a.lat2, a.lon2, b.lat1 + 2e-4 AS plat, b.lon1 + 3e-4 AS plon FROM edges a JOIN edges b ON b.edge_id = a.edge_id + 160), f AS (SELECT *, greatest(0e0, least(1e0, ((plon - lon1) * (lon2 - lon1) + (plat - lat1) * (lat2 - lat1)) / ((lon2 - lon1) * (lon2 - lon1) + (lat2 - lat1) * (lat2 - lat1)))) AS f FROM c)\n"


def edge_and_point(spark, d):
    e = edges(spark, d).select("edge_id", "lat1", "lon1", "lat2", "lon2")
    b = e.select((F.col("edge_id") - 160).alias("edge_id"), (F.col("lat1") + 0.0002).alias("plat"), (F.col("lon1") + 0.0003).alias("plon"))
    return e.join(b, "edge_id")


@query("GE-02", sql("edges", EDGE_POINT + f"SELECT edge_id, {k(hav('plat', 'plon', '(lat1 + (lat2 - lat1) * f)', '(lon1 + (lon2 - lon1) * f)'))} AS dist FROM f"))
def segment_distance(spark, d):
    return edge_and_point(spark, d).select("edge_id", thousandths(geo.segment_distance("plat", "plon", "lat1", "lon1", "lat2", "lon2")).alias("dist"))


@query("GE-03", sql("edges", EDGE_POINT + ", h AS (SELECT edge_id, {l} AS length, {a} AS away, radians({b1} - {b0}) AS turn FROM f)\nSELECT edge_id, CAST(round(away * cos(turn) / length * 100000) AS BIGINT) AS fraction, {d} AS distance FROM h".format(l=hav("lat1", "lon1", "lat2", "lon2"), a=hav("lat1", "lon1", "plat", "plon"), b1=bearing_sql("lat1", "lon1", "plat", "plon"), b0=bearing_sql("lat1", "lon1", "lat2", "lon2"), d=k("abs(away * sin(turn))"))))
def line_projection(spark, d):
    own = edge_and_point(spark, d).withColumn("p", geo.line_projection("plat", "plon", "lat1", "lon1", "lat2", "lon2"))
    return own.select("edge_id", F.round(F.col("p.fraction") * 100_000).cast("long").alias("fraction"), thousandths(F.col("p.distance")).alias("distance"))


def lines(spark, d):
    """Each route's positions as one line in metres."""
    own = gps(spark, d).select("route_id", "us", "event_id", (F.col("lon") * 83044.98918812413).alias("x"), (F.col("lat") * 111070.34306591158).alias("y"))
    return trajectories.polylines(own, "route_id", ["x", "y"])


def summary(df, key="route_id"):
    return df.select(key, F.size("points").cast("long").alias("n"), F.round(geo.polyline_length(F.col("points"))).cast("long").alias("length"))


@query("GE-04")
def simplify(spark, d):
    return summary(geometry.simplify(lines(spark, d), 10.0))


@query("GE-05")
def simplify_auto(spark, d):
    return summary(geometry.simplify(lines(spark, d), None, at_tolerance=False))


@query("GE-06")
def smooth(spark, d):
    return summary(geometry.smooth(lines(spark, d), 30.0))


SPLIT = (
    ", v AS (SELECT id, ax AS x1, ay AS y1, bx AS x2, s.by AS y2 FROM s), "
    "m AS (SELECT p.id AS a, q.id AS b, p.x1 AS px, p.y1 AS py, p.x2 AS qx, p.y2 AS qy, q.x1 AS rx, q.y1 AS ry, q.x2 AS tx, q.y2 AS ty FROM v p JOIN v q ON p.id < q.id AND greatest(p.x1, p.x2) >= least(q.x1, q.x2) AND greatest(q.x1, q.x2) >= least(p.x1, p.x2) AND greatest(p.y1, p.y2) >= least(q.y1, q.y2) AND greatest(q.y1, q.y2) >= least(p.y1, p.y2)), "
    "o AS (SELECT *, (px - qx) * (ry - ty) - (py - qy) * (rx - tx) AS den FROM m WHERE ((rx - px) * (ty - py) - (ry - py) * (tx - px) > 0) <> ((rx - qx) * (ty - qy) - (ry - qy) * (tx - qx) > 0) AND ((qx - px) * (ry - py) - (qy - py) * (rx - px) > 0) <> ((qx - px) * (ty - py) - (qy - py) * (tx - px) > 0)), "
    "c AS (SELECT a, b, ((px * qy - py * qx) * (rx - tx) - (px - qx) * (rx * ty - ry * tx)) / den AS x, ((px * qy - py * qx) * (ry - ty) - (py - qy) * (rx * ty - ry * tx)) / den AS y FROM o), "
    "cu AS (SELECT a AS id, x, y FROM c UNION ALL SELECT b, x, y FROM c), "
    "pt AS (SELECT id, x1 AS x, y1 AS y, -1e0 AS f FROM v UNION ALL SELECT id, x2, y2, 2e0 FROM v UNION ALL SELECT id, x, y, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) FROM cu JOIN v USING (id)), "
    "pc AS (SELECT *, row_number() OVER w - 1 AS piece, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM pt WINDOW w AS (PARTITION BY id ORDER BY f, x, y))\n"
)


@query("GE-07", sql("points2d", SEGMENTS.rstrip() + SPLIT + f"SELECT id, piece, {u('x')} AS ax, {u('y')} AS ay, {u('nx')} AS bx, {u('ny')} AS \"by\" FROM pc WHERE nx IS NOT NULL"))
def split_lines(spark, d):
    own = geometry.split_at_crossings(segments(spark, d), "id", 10.0)
    return own.select("id", "piece", *[micro(F.col(c)).alias(c) for c in ("ax", "ay", "bx", "by")])


@query("GE-08", sql("edges", ", e AS (SELECT edge_id, 0 AS \"end\", lon1 * 83044.98918812413e0 AS x, lat1 * 111070.34306591158e0 AS y FROM edges UNION ALL SELECT edge_id, 1, lon2 * 83044.98918812413e0, lat2 * 111070.34306591158e0 FROM edges), t AS (SELECT e.* FROM e JOIN links l USING (edge_id) WHERE l.source < l.target), b AS (SELECT *, CAST(floor(x) AS BIGINT) AS bx FROM t)\nSELECT edge_id, CAST(\"end\" AS BIGINT) AS \"end\" FROM b WHERE NOT EXISTS (SELECT 1 FROM b o WHERE o.bx BETWEEN b.bx - 1 AND b.bx + 1 AND abs(o.y - b.y) <= 1 AND (o.edge_id <> b.edge_id OR o.\"end\" <> b.\"end\") AND sqrt((o.x - b.x) * (o.x - b.x) + (o.y - b.y) * (o.y - b.y)) <= 1)"))
def hanging(spark, d):
    return geometry.hanging(road_lines(spark, d), "edge_id", 1.0).select("edge_id", "end")


def road_lines(spark, d):
    point = lambda n: F.struct((F.col(f"lon{n}") * 83044.98918812413).alias("x"), (F.col(f"lat{n}") * 111070.34306591158).alias("y"))
    return edges(spark, d).where("source < target").select("edge_id", F.array(point(1), point(2)).alias("points"))


@query("GE-09", sql("edges", f", e AS (SELECT edge_id, lon1 * 83044.98918812413e0 AS ax, lat1 * 111070.34306591158e0 AS ay, lon2 * 83044.98918812413e0 AS bx, lat2 * 111070.34306591158e0 AS b_y FROM edges WHERE source < target), l AS (SELECT *, sqrt((ax - bx) * (ax - bx) + (ay - b_y) * (ay - b_y)) AS d FROM e)\nSELECT edge_id, {k('ax + (ax - bx) * (15 / d)')} AS x, {k('b_y + (b_y - ay) * (15 / d)')} AS y FROM l"))
def stretch(spark, d):
    own = road_lines(spark, d).withColumn("p", geometry.stretched(F.col("points"), 15.0))
    return own.select("edge_id", thousandths(F.element_at("p", 1)["x"]).alias("x"), thousandths(F.element_at("p", -1)["y"]).alias("y"))


@query("GE-10", sql("edges", ", e AS (SELECT edge_id, 0 AS \"end\", lon1 * 83044.98918812413e0 AS x, lat1 * 111070.34306591158e0 AS y FROM edges UNION ALL SELECT edge_id, 1, lon2 * 83044.98918812413e0, lat2 * 111070.34306591158e0 FROM edges), t AS (SELECT e.* FROM e JOIN links l USING (edge_id) WHERE l.source < l.target), b AS (SELECT *, CAST(floor(x) AS BIGINT) AS bx FROM t), ha AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM b o WHERE o.bx BETWEEN b.bx - 1 AND b.bx + 1 AND abs(o.y - b.y) <= 1 AND (o.edge_id <> b.edge_id OR o.\"end\" <> b.\"end\") AND sqrt((o.x - b.x) * (o.x - b.x) + (o.y - b.y) * (o.y - b.y)) <= 1)), be AS (SELECT h.edge_id, h.\"end\", min(sqrt((o.x - h.x) * (o.x - h.x) + (o.y - h.y) * (o.y - h.y))) AS d FROM ha h JOIN b o ON o.bx BETWEEN h.bx - 121 AND h.bx + 121 AND o.y BETWEEN h.y - 120 AND h.y + 120 AND o.edge_id <> h.edge_id WHERE sqrt((o.x - h.x) * (o.x - h.x) + (o.y - h.y) * (o.y - h.y)) <= 120 GROUP BY ALL), le AS (SELECT edge_id, sqrt(pow((lon1 - lon2) * 83044.98918812413e0, 2) + pow((lat1 - lat2) * 111070.34306591158e0, 2)) AS far FROM edges WHERE source < target)\nSELECT edge_id, 2 + count(d) AS n, CAST(round(any_value(far) + coalesce(sum(d), 0)) AS BIGINT) AS length FROM le LEFT JOIN be USING (edge_id) GROUP BY edge_id"))
def snap(spark, d):
    return summary(geometry.snapped(road_lines(spark, d), "edge_id", 1.0, 120.0), "edge_id")


@query("GE-11", sql("edges", ", e AS (SELECT edge_id, 0 AS \"end\", lon1 * 83044.98918812413e0 AS x, lat1 * 111070.34306591158e0 AS y FROM edges UNION ALL SELECT edge_id, 1, lon2 * 83044.98918812413e0, lat2 * 111070.34306591158e0 FROM edges), t AS (SELECT e.* FROM e JOIN links l USING (edge_id) WHERE l.source < l.target), b AS (SELECT *, CAST(floor(x) AS BIGINT) AS bx FROM t), ha AS (SELECT DISTINCT edge_id FROM b WHERE NOT EXISTS (SELECT 1 FROM b o WHERE o.bx BETWEEN b.bx - 1 AND b.bx + 1 AND abs(o.y - b.y) <= 1 AND (o.edge_id <> b.edge_id OR o.\"end\" <> b.\"end\") AND sqrt((o.x - b.x) * (o.x - b.x) + (o.y - b.y) * (o.y - b.y)) <= 1)), le AS (SELECT edge_id, sqrt(pow((lon1 - lon2) * 83044.98918812413e0, 2) + pow((lat1 - lat2) * 111070.34306591158e0, 2)) AS far FROM edges WHERE edge_id IN (SELECT edge_id FROM ha))\nSELECT edge_id, CAST(2 AS BIGINT) AS n, CAST(round(far) AS BIGINT) AS length FROM le WHERE round(far) > 90"))
def hanging_by_length(spark, d):
    own = road_lines(spark, d)
    loose = geometry.hanging(own, "edge_id", 1.0).select("edge_id").distinct()
    return summary(own.join(loose, "edge_id", "left_semi"), "edge_id").where("length > 90")


@query("GE-12", sql("points2d", SEGMENTS + "SELECT p.id, {0} <> {1} AND {2} <> {3} AS crosses FROM s p JOIN s q ON q.id = p.id + 2".format(*[f"(({b}x - {a}x) * ({c}y - {a}y) - ({b}y - {a}y) * ({c}x - {a}x) > 0)" for a, b, c in (("p.a", "q.a", "q.b"), ("p.b", "q.a", "q.b"), ("p.a", "p.b", "q.a"), ("p.a", "p.b", "q.b"))])))
def proper_crossing(spark, d):
    s = segments(spark, d)
    t = s.select((F.col("id") - 2).alias("id"), F.col("ax").alias("cx"), F.col("ay").alias("cy"), F.col("bx").alias("dx"), F.col("by").alias("dy"))
    return s.join(t, "id").select("id", geo.segments_cross("ax", "ay", "bx", "by", "cx", "cy", "dx", "dy").alias("crosses"))


@query("GE-13")
def extend(spark, d):
    own = geometry.extended(segments(spark, d), "id", 1.5)
    return own.select("id", "end", "other", micro(F.col("x")).alias("x"), micro(F.col("y")).alias("y"))


@query("GE-14", sql("gps edges", BOXES.replace("edge_id, least", "edge_id, lon1 * 83044.98918812413e0 AS ax, lat1 * 111070.34306591158e0 AS ay, lon2 * 83044.98918812413e0 AS qx, lat2 * 111070.34306591158e0 AS qy, least") + ",\nf AS (SELECT event_id, x, y, ax, ay, qx, qy, greatest(0e0, least(1e0, ((x - ax) * (qx - ax) + (y - ay) * (qy - ay)) / ((qx - ax) * (qx - ax) + (qy - ay) * (qy - ay)))) AS f FROM p JOIN e ON x BETWEEN x0 - 20 AND x1 + 20 AND y BETWEEN y0 - 20 AND y1 + 20)\nSELECT DISTINCT event_id FROM f WHERE (x - ax - f * (qx - ax)) * (x - ax - f * (qx - ax)) + (y - ay - f * (qy - ay)) * (y - ay - f * (qy - ay)) <= 400"))
def in_buffer(spark, d):
    """Points in a buffer of 20 m around the roads, as a distance test rather than a polygon."""
    own = edges(spark, d).select("edge_id", *[(F.col(c) * m).alias(o) for c, m, o in (("lon1", 83044.98918812413, "ax"), ("lat1", 111070.34306591158, "ay"), ("lon2", 83044.98918812413, "bx"), ("lat2", 111070.34306591158, "by"))])
    return geometry.within_reach(metric_points(spark, d), own, 20.0).select("event_id").distinct()


#: Points every 500 m or less along the straight steps of each route: t (route_id, leg, step, x, y).
INTERP = "q AS (SELECT route_id, us, event_id, lon * 83044.98918812413e0 AS x, lat * 111070.34306591158e0 AS y FROM gps), n AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2, row_number() OVER w AS leg FROM q WINDOW w AS (PARTITION BY route_id ORDER BY us, event_id)), p AS (SELECT *, CASE WHEN x2 IS NULL THEN 1 ELSE greatest(CAST(ceil(sqrt(pow(x2 - x, 2) + pow(y2 - y, 2)) / 500) AS INTEGER), 1) END AS parts FROM n), t AS (SELECT route_id, leg, CAST(st AS BIGINT) AS step, CASE WHEN st = 0 THEN x ELSE x + (x2 - x) * (st / parts) END AS x, CASE WHEN st = 0 THEN y ELSE y + (y2 - y) * (st / parts) END AS y FROM (SELECT *, unnest(range(parts)) AS st FROM p))"


@query("GE-18", sql("gps", f", {INTERP}\nSELECT route_id, leg, step, {k('x')} AS x, {k('y')} AS y FROM t"))
def resample(spark, d):
    own = gps(spark, d).select("route_id", F.col("us").alias("n"), "event_id", (F.col("lon") * 83044.98918812413).alias("x"), (F.col("lat") * 111070.34306591158).alias("y"))
    return trajectories.interpolated(own, "route_id", 500.0, order=("n", "event_id")).select("route_id", "leg", "step", thousandths(F.col("x")).alias("x"), thousandths(F.col("y")).alias("y"))

