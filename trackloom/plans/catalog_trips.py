"""Trajectory preparation, map matching and evaluation over the bound tables."""

from __future__ import annotations

import re

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.functions import geo
from trackloom.operators import aggregates, evaluation, geometry, joins, matching, sets, tiles, trajectories, way_comparison
from trackloom.plans.catalog_basic import BOXES, LIMITS, MATCHES, SESSIONS, metric_points
from trackloom.plans.catalog_scalar import INTERP, bearing_sql, lines
from trackloom.plans.registry import query
from trackloom.plans.relations import BOX, crossings, edges, gps, hav, k, links, matches, micro, nodes, points2d, recursive, sql, thousandths

#: Metres a degree of longitude and of latitude in the study area.
MX, MY = 83044.98918812413, 111070.34306591158
S, WE, N, E = BOX
STRICT = f"lat > {S}e0 AND lat < {N}e0 AND lon > {WE}e0 AND lon < {E}e0"


@query("TR-01", sql("gps", f", b AS (SELECT *, ({STRICT}) AS ib FROM gps), c AS (SELECT *, CASE WHEN ib IS DISTINCT FROM lag(ib) OVER w OR lag(us) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM b WINDOW w AS (PARTITION BY route_id ORDER BY us, event_id)), r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY route_id ORDER BY us, event_id) AS BIGINT) AS run FROM c)\nSELECT event_id, route_id, run, count(*) OVER (PARTITION BY route_id, run) AS n_points FROM r WHERE ib QUALIFY n_points > 1"))
def in_bound_runs(spark, d):
    return trajectories.in_bound_runs(gps(spark, d), BOX).select("event_id", "route_id", "run", "n_points")


GAP = ", g AS (SELECT *, sum(CASE WHEN (us - us0) / 1e6 > 43200 THEN 1 ELSE 0 END) OVER (PARTITION BY route_id ORDER BY us, event_id) AS broken FROM (SELECT *, lag(us) OVER (PARTITION BY route_id ORDER BY us, event_id) AS us0 FROM gps))\n"


@query("TR-02", sql("gps", GAP + "SELECT event_id, route_id FROM g WHERE broken = 0"))
def cut_at_gap(spark, d):
    return trajectories.cut_at_gap(gps(spark, d), "route_id", 43_200).select("event_id", "route_id")


def thinning_sql(points: str, least: float, most: float) -> str:
    """CTE th (route_id, event_id, us): the points (route_id, event_id, us, lat, lon) that thinning keeps, of routes with more than one."""
    h = hav("w.klat", "w.klon", "o.lat", "o.lon")
    return (
        f"o AS (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY us, event_id) AS i FROM {points}), "
        "w AS (SELECT route_id, event_id, us, lat, lon, i, lat AS klat, lon AS klon, true AS kept FROM o WHERE i = 1 UNION ALL "
        "SELECT route_id, event_id, us, lat, lon, i, CASE WHEN far >= " + str(least) + " THEN lat ELSE klat END, CASE WHEN far >= " + str(least) + " THEN lon ELSE klon END, far >= " + str(least) + " FROM "
        "(SELECT o.*, w.klat, w.klon, " + h + f" AS far FROM w JOIN o ON o.route_id = w.route_id AND o.i = w.i + 1) WHERE far <= {most}), "
        "th AS (SELECT * FROM w WHERE kept QUALIFY count(*) OVER (PARTITION BY route_id) > 1)"
    )


@query("TR-03", recursive(sql("gps", ", " + thinning_sql("gps", 500, 1e7) + "\nSELECT event_id, route_id FROM th")))
def thin(spark, d):
    """Held against a plain loop in the tests, too."""
    return trajectories.thin(gps(spark, d), "route_id", 500, 1e7).select("event_id", "route_id")


SPEED = ", l AS (SELECT *, lag(us) OVER w AS us0, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0 FROM gps WINDOW w AS (PARTITION BY route_id ORDER BY us, event_id)), v AS (SELECT *, CASE WHEN us0 IS NOT NULL THEN {h} / greatest(floor((us - us0) / 1e6), 1) END AS v FROM l), g AS (SELECT *, sum(CASE WHEN v > 1 OR v < 0.001 THEN 1 ELSE 0 END) OVER (PARTITION BY route_id ORDER BY us, event_id) AS broken FROM v)\n".format(h=hav("lat0", "lon0", "lat", "lon"))


@query("TR-04", sql("gps", SPEED + "SELECT event_id, route_id FROM g WHERE broken = 0"))
def cut_at_speed(spark, d):
    return trajectories.cut_at_speed(gps(spark, d), "route_id", 0.001, 1).select("event_id", "route_id")


CLEAN = GAP.replace("43200", "172800").rstrip() + ", c AS (SELECT * FROM g WHERE broken = 0), " + thinning_sql("c", 100, 1e7) + SPEED.replace("FROM gps", "FROM th").replace("v > 1 OR v < 0.001", "v > 50 OR v < 0.0001").replace(", l AS", ", l AS").replace(", g AS (SELECT", ", z AS (SELECT")


@query("TR-05", recursive(sql("gps", CLEAN + "SELECT event_id, route_id FROM z WHERE broken = 0")))
def cleaned(spark, d):
    return trajectories.cleaned(gps(spark, d), "route_id", seconds=172_800, most=1e7, least=100, fastest=50, slowest=0.0001).select("event_id", "route_id")


@query("TR-06", sql("gps", SESSIONS + ", y AS (SELECT *, dense_rank() OVER (ORDER BY route_id, session) AS traj_id FROM t), z AS (SELECT *, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM y WINDOW w AS (PARTITION BY traj_id ORDER BY us, event_id))\nSELECT traj_id, route_id, count(*) AS n, CAST(round(sum(" + hav("lat", "lon", "lat2", "lon2") + ")) AS BIGINT) AS length FROM z GROUP BY traj_id, route_id"))
def directory_pipeline(spark, d):
    own = trajectories.numbered(trajectories.sessions(gps(spark, d), LIMITS), ["route_id", "session"])
    w = W.partitionBy("traj_id").orderBy("us", "event_id")
    step = F.when(F.lead("us").over(w).isNotNull(), geo.haversine(F.col("lat"), F.col("lon"), F.lead("lat").over(w), F.lead("lon").over(w)))
    return own.withColumn("step", step).groupBy("traj_id", "route_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("step")).cast("long").alias("length"))


@query("TR-07", sql("gps", f"SELECT route_id, count(*) AS n, {k('first(lon ORDER BY us, event_id)')} AS lon, {k('last(lat ORDER BY us, event_id)')} AS lat FROM gps GROUP BY route_id"))
def polylines(spark, d):
    own = trajectories.polylines(gps(spark, d), "route_id", ["lon", "lat"])
    return own.select("route_id", F.size("points").cast("long").alias("n"), thousandths(F.element_at("points", 1)["lon"]).alias("lon"), thousandths(F.element_at("points", -1)["lat"]).alias("lat"))


@query("TR-08", sql("edges", f", o AS (SELECT * FROM edges WHERE length > 100 QUALIFY row_number() OVER (PARTITION BY least(source, target), greatest(source, target) ORDER BY edge_id) = 1)\nSELECT edge_id, i AS n, CAST(round((lon1 + (lon2 - lon1) * i / 8) * 1000000) AS BIGINT) AS lon, CAST(round((lat1 + (lat2 - lat1) * i / 8) * 1000000) AS BIGINT) AS lat FROM o, range(9) r(i)"))
def pseudo_trajectories(spark, d):
    return trajectories.pseudo_trajectories(edges(spark, d), 100).select("edge_id", "n", micro(F.col("lon")).alias("lon"), micro(F.col("lat")).alias("lat"))


@query("TR-09", sql("gps crossings", ", m AS (SELECT id FROM crossings GROUP BY id HAVING sum(ep) > 0 AND sum(ep) < 4.5e0)\nSELECT event_id, route_id FROM gps WHERE route_id IN (SELECT id FROM m)"))
def unmatched_extract(spark, d):
    bad = aggregates.unmatched_ids(crossings(spark, d), "id", "ep", 9, 0.5).withColumnRenamed("id", "route_id")
    return gps(spark, d).join(bad, "route_id", "left_semi").select("event_id", "route_id")


TURN10 = f", {INTERP}, a AS (SELECT *, lead(x) OVER w AS x3, lead(y) OVER w AS y3 FROM t WINDOW w AS (PARTITION BY route_id ORDER BY leg, step))\n"


@query("TR-10", sql("gps", TURN10 + "SELECT route_id, leg, step, CAST(round(((90 - ((degrees(atan2(y3 - y, x3 - x)) % 360e0) + 360e0) % 360e0) % 360e0 + 360e0) % 360e0) AS BIGINT) AS azimuth FROM a"))
def resampled_motion(spark, d):
    own = gps(spark, d).select("route_id", F.col("us").alias("n"), "event_id", (F.col("lon") * MX).alias("x"), (F.col("lat") * MY).alias("y"))
    dense = trajectories.interpolated(own, "route_id", 500.0, order=("n", "event_id"))
    w = W.partitionBy("route_id").orderBy("leg", "step")
    angle = F.pmod(90 - geo.line_angle(F.col("x"), F.col("y"), F.lead("x").over(w), F.lead("y").over(w)), F.lit(360.0))
    return dense.select("route_id", "leg", "step", F.round(angle).cast("long").alias("azimuth"))


@query("TR-11", sql("gps", ", l AS (SELECT *, lag(us) OVER w AS us0, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0 FROM gps WINDOW w AS (PARTITION BY route_id ORDER BY us, event_id)), s AS (SELECT (us - us0) / 1e6 AS dt, {h} AS dist FROM l WHERE us0 IS NOT NULL)\nSELECT 'dt' AS what, CAST(floor(dt / 3600) AS BIGINT) AS bin, count(*) AS n FROM s GROUP BY ALL UNION ALL SELECT 'dist', CAST(floor(dist / 250) AS BIGINT), count(*) FROM s GROUP BY ALL".format(h=hav("lat0", "lon0", "lat", "lon"))))
def distributions(spark, d):
    own = trajectories.steps(gps(spark, d)).where("dt IS NOT NULL")
    each = own.select(F.explode(F.array(F.struct(F.lit("dt").alias("what"), F.floor(F.col("dt") / 3600).alias("bin")), F.struct(F.lit("dist").alias("what"), F.floor(F.col("dist") / 250).alias("bin")))).alias("x"))
    return each.groupBy("x.what", "x.bin").agg(F.count(F.lit(1)).alias("n"))


def metric_edges(spark, d):
    return edges(spark, d).select("edge_id", "source", "target", F.col("weight").cast("double").alias("weight"), "length", (F.col("lon1") * MX).alias("ax"), (F.col("lat1") * MY).alias("ay"), (F.col("lon2") * MX).alias("bx"), (F.col("lat2") * MY).alias("by"))


METRIC = "m AS (SELECT edge_id, source, target, CAST(weight AS DOUBLE) AS weight, length, lon1 * 83044.98918812413e0 AS ax, lat1 * 111070.34306591158e0 AS ay, lon2 * 83044.98918812413e0 AS bx, lat2 * 111070.34306591158e0 AS b_y FROM edges)"


def metric_trips(spark, d):
    own = gps(spark, d).select(F.col("route_id").alias("trip"), F.col("event_id").alias("point_id"), "us", (F.col("lon") * MX).alias("x"), (F.col("lat") * MY).alias("y"))
    return own.withColumn("n", F.row_number().over(W.partitionBy("trip").orderBy("us", "point_id")).cast("long"))


@query("MM-01")
def st_match(spark, d):
    e = metric_edges(spark, d)
    own = matching.st_match(metric_trips(spark, d), e, matching.bounded_paths(e, 400.0), 4, 60.0, 20.0)
    return own.select("id", "opath", F.transform("ep", lambda x: F.round(x, 6)).alias("ep"), F.transform("tp", lambda x: F.round(x, 6)).alias("tp"))


@query("MM-02", sql("edges", f", w AS (SELECT source AS a, target AS b, min(length) AS dist FROM edges GROUP BY ALL), s AS (SELECT DISTINCT source AS a, source AS b, 0e0 AS dist FROM edges), w2 AS (SELECT p.a, q.b, min(p.dist + q.dist) AS dist FROM w p JOIN w q ON p.b = q.a GROUP BY ALL)\nSELECT a, b, {k('min(dist)')} AS dist FROM (SELECT * FROM s UNION ALL SELECT * FROM w UNION ALL SELECT * FROM w2) WHERE dist <= 250 GROUP BY a, b"))
def bounded_table(spark, d):
    e = metric_edges(spark, d)
    return matching.bounded_paths(e, 250.0).select("a", "b", thousandths(F.col("dist")).alias("dist"))


@query("MM-03", sql("gps crossings", MATCHES.rstrip() + ", r AS (SELECT DISTINCT route_id AS id FROM gps)\nSELECT r.id, CASE WHEN m.id IS NULL THEN true ELSE list_sum(ep) > 0 AND list_sum(ep) < 4.5e0 END AS unmatch FROM r LEFT JOIN m USING (id)"))
def classified(spark, d):
    trips = gps(spark, d).select(F.col("route_id").alias("id"))
    return matching.classified(trips, matches(spark, d), 9, 0.5).select("id", "unmatch")


TRANS = ", t AS (SELECT source AS node, sum(weight) AS w, count(*) AS n FROM links GROUP BY source), p AS (SELECT a.edge_id, b.edge_id AS next_id, CASE WHEN b.target = a.source THEN CASE WHEN t.n <> 2 THEN 1e-5 END ELSE b.weight / t.w * (1 - 0.5e0 - 1e-5) END AS p FROM links a JOIN links b ON b.source = a.target JOIN t ON t.node = a.target WHERE a.edge_id <> b.edge_id UNION ALL SELECT edge_id, edge_id, 0.5e0 FROM links UNION ALL SELECT edge_id, -1, 1e-5 FROM links)\n"


@query("MM-04", sql("links", TRANS + "SELECT edge_id, next_id, CAST(round(p * 1000000000) AS BIGINT) AS p FROM p WHERE p IS NOT NULL"))
def hmm_transitions(spark, d):
    own = links(spark, d).withColumn("weight", F.col("weight").cast("double"))
    return matching.onward_links(own).select("edge_id", "next_id", F.round(F.col("p") * 1e9).cast("long").alias("p"))


ERF0 = "(1 - (1 / (1 + 0.3275911e0 * {x})) * (0.254829592e0 + (1 / (1 + 0.3275911e0 * {x})) * (-0.284496736e0 + (1 / (1 + 0.3275911e0 * {x})) * (1.421413741e0 + (1 / (1 + 0.3275911e0 * {x})) * (-1.453152027e0 + (1 / (1 + 0.3275911e0 * {x})) * 1.061405429e0)))) * exp(-{x} * {x}))"


@query("MM-05", sql("gps", "SELECT event_id, CAST(round(CASE WHEN floor(value) >= 150 THEN 0 ELSE 1 - (1 + " + ERF0.format(x="(floor(value) / (50 * sqrt(2)))") + ") / 2 END * 1000000) AS BIGINT) AS e FROM gps"))
def emissions(spark, d):
    return gps(spark, d).select("event_id", micro(matching.emission(F.col("value"))).alias("e"))


@query("MM-06", sql("edges", f", {METRIC}, l AS (SELECT *, sqrt((ax - bx) * (ax - bx) + (ay - b_y) * (ay - b_y)) AS far FROM m), n AS (SELECT *, CASE WHEN far <= 20 THEN 1 ELSE CAST(pow(2, ceil(round(log2(far / 20), 9))) AS BIGINT) END AS parts FROM l)\nSELECT edge_id, i AS n, {k('ax + (bx - ax) * (i / parts)')} AS x, {k('ay + (b_y - ay) * (i / parts)')} AS y FROM (SELECT *, unnest(range(parts + 1)) AS i FROM n)"))
def subdivided_map(spark, d):
    from trackloom.operators.cluster import subdivided

    return subdivided(metric_edges(spark, d), "edge_id", 20.0).select("edge_id", "n", thousandths(F.col("x")).alias("x"), thousandths(F.col("y")).alias("y"))


@query("MM-07")
def viterbi(spark, d):
    """Held against enumeration of all state sequences in the tests."""
    return matching.match_trips(metric_trips(spark, d), metric_edges(spark, d))


@query("MM-08", sql("gps edges", BOXES + "\nSELECT event_id, edge_id FROM p JOIN e ON x BETWEEN x0 - 30 AND x1 + 30 AND y BETWEEN y0 - 30 AND y1 + 30"))
def candidates(spark, d):
    own = metric_edges(spark, d).select("edge_id", F.least("ax", "bx").alias("x0"), F.least("ay", "by").alias("y0"), F.greatest("ax", "bx").alias("x1"), F.greatest("ay", "by").alias("y1"))
    return joins.within_box(metric_points(spark, d), own, 30.0).select("event_id", "edge_id")


@query("MM-09")
def trip_driver(spark, d):
    """Interpolated observations, matched."""
    dense = matching.observations(metric_trips(spark, d), 1000.0).withColumn("point_id", F.col("trip") * 100_000_000 + F.col("leg") * 1000 + F.col("step"))
    own = dense.withColumn("n", F.row_number().over(W.partitionBy("trip").orderBy("leg", "step")).cast("long"))
    return matching.match_trips(own, metric_edges(spark, d), 100.0)


def street_trips(spark, d):
    """Trips along the rows of the street grid, a position at each node every 12 s and up to 8 m off; one in 13 far away from any street."""
    own = nodes(spark, d).select(F.col("row").alias("trip"), (F.col("col") + 1).alias("n"), "node_id", (F.col("lon") * MX).alias("x"), (F.col("lat") * MY).alias("y"))
    lost = F.when(F.col("n") % 13 == 8, 100_000.0).otherwise(0.0)
    return own.select("trip", "n", F.col("node_id").alias("point_id"), (F.col("n") * 12_000_000).alias("us"), (F.col("x") + (F.col("node_id") * 29) % 17 - 8 + lost).alias("x"), (F.col("y") + (F.col("node_id") * 13) % 17 - 8).alias("y"))


@query("MM-10")
def segment_traces(spark, d):
    """Trips along the streets, matched; runs on one segment, without what is within 30 s of a position that matches nothing."""
    own = street_trips(spark, d)
    got = matching.match_trips(own, metric_edges(spark, d)).join(own.select("trip", "n", "us"), ["trip", "n"])
    segs = links(spark, d).select("edge_id", F.floor(F.least("source", "target") / 3).alias("segment_id"))
    return matching.traces_of(got, segs, 30_000_000)


MOTION = ", ld AS (SELECT *, lead(us) OVER w AS us2, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM gps WINDOW w AS (PARTITION BY route_id ORDER BY us, event_id)), mo0 AS (SELECT *, (us2 - us) / 1e6 AS dt0, CASE WHEN us2 IS NOT NULL THEN {h} END AS far0, CASE WHEN us2 IS NOT NULL THEN round({b}) % 360 END AS az0 FROM ld), mo1 AS (SELECT *, coalesce(dt0, lag(dt0) OVER w) AS dt, coalesce(far0, lag(far0) OVER w) AS far, coalesce(az0, lag(az0) OVER w) AS azimuth FROM mo0 WINDOW w AS (PARTITION BY route_id ORDER BY us, event_id)), mo AS (SELECT *, CASE WHEN dt > 0 THEN far / dt * 3.6e0 END AS kmh FROM mo1)".format(h=hav("lat", "lon", "lat2", "lon2"), b=bearing_sql("lat", "lon", "lat2", "lon2"))
NEAR40 = f", {METRIC}, pt AS (SELECT event_id, azimuth, lon * 83044.98918812413e0 AS x, lat * 111070.34306591158e0 AS y FROM mo), jn AS (SELECT *, greatest(0e0, least(1e0, ((x - ax) * (bx - ax) + (y - ay) * (b_y - ay)) / ((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay)))) AS f FROM pt JOIN m ON x BETWEEN least(ax, bx) - 40 AND greatest(ax, bx) + 40 AND y BETWEEN least(ay, b_y) - 40 AND greatest(ay, b_y) + 40), ds AS (SELECT *, sqrt((x - ax - f * (bx - ax)) * (x - ax - f * (bx - ax)) + (y - ay - f * (b_y - ay)) * (y - ay - f * (b_y - ay))) AS far, abs(azimuth - (((90 - degrees(atan2(b_y - ay, bx - ax))) % 360e0 + 360e0) % 360e0)) % 360 AS tu FROM jn), best AS (SELECT event_id AS point_id, edge_id, far FROM ds WHERE far <= 40 AND least(tu, 360 - tu) <= 30 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY far, edge_id) = 1)\n"


@query("MM-11", sql("gps edges", MOTION + NEAR40 + f"SELECT point_id, edge_id, {k('far')} AS dist FROM best QUALIFY count(*) OVER (PARTITION BY edge_id) >= 2"))
def snapped(spark, d):
    azimuth = trajectories.motion(gps(spark, d), "route_id").select(F.col("event_id").alias("point_id"), "azimuth")
    return matching.snapped(metric_trips(spark, d).join(azimuth, "point_id"), metric_edges(spark, d)).select("point_id", "edge_id", thousandths(F.col("dist")).alias("dist"))


DROPPED = "dr AS (SELECT * FROM edges WHERE (edge_id + 3) * 2654435761 % 4294967296 < 858993459)"
DIRECTED = ", q AS (SELECT id, edge_id, cos(radians(id * 37 % 360)) AS vx, sin(radians(id * 37 % 360)) AS vy FROM crossings), " + DROPPED + ", ux AS (SELECT edge_id, length, (lon2 - lon1) * 83044.98918812413e0 AS ux, (lat2 - lat1) * 111070.34306591158e0 AS uy FROM dr), f AS (SELECT DISTINCT q.id, edge_id FROM q JOIN ux USING (edge_id) WHERE abs((vx * ux + vy * uy) / (sqrt(vx * vx + vy * vy) * sqrt(ux * ux + uy * uy))) >= cos(radians(20e0)))"


def detection_parts(spark, d):
    own = matches(spark, d).select("id", "opath", F.cos(F.radians(F.col("id") * 37 % 360)).alias("vx"), F.sin(F.radians(F.col("id") * 37 % 360)).alias("vy"))
    drop = sets.share_of(edges(spark, d), "edge_id", 0.2, 3).select("edge_id", "length", ((F.col("lon2") - F.col("lon1")) * MX).alias("ux"), ((F.col("lat2") - F.col("lat1")) * MY).alias("uy"))
    return own, drop


@query("EV-01", sql("edges crossings", DIRECTED + "\nSELECT id, edge_id FROM f"))
def detections(spark, d):
    return evaluation.detections(*detection_parts(spark, d))


@query("EV-02", sql("edges crossings", DIRECTED + ", c AS (SELECT edge_id, count(*) AS n FROM crossings GROUP BY edge_id), v AS (SELECT (SELECT count(DISTINCT id) FROM f)::DOUBLE / (SELECT count(DISTINCT id) FROM crossings) AS p, (SELECT count(DISTINCT edge_id) FROM f)::DOUBLE / (SELECT count(*) FROM ux JOIN c USING (edge_id) WHERE length >= 95 AND n >= 10) AS r)\nSELECT CAST(round(p * 1000000) AS BIGINT) AS precision, CAST(round(r * 1000000) AS BIGINT) AS recall, CAST(round(2 * p * r / (p + r) * 1000000) AS BIGINT) AS f1 FROM v"))
def precision_recall(spark, d):
    own, drop = detection_parts(spark, d)
    counted = drop.join(aggregates.trips_by_edge(crossings(spark, d)), "edge_id", "left")
    got = evaluation.precision_recall(evaluation.detections(own, drop), own, counted, 95, 10)
    return got.select(*[micro(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


@query("AG-08", sql("edges crossings", DIRECTED + ", v AS (SELECT (SELECT count(DISTINCT id) FROM f)::DOUBLE / (SELECT count(DISTINCT id) FROM crossings) AS p, (SELECT count(DISTINCT edge_id) FROM f)::DOUBLE / (SELECT count(*) FROM ux WHERE length >= 95) AS r)\nSELECT CAST(round(p * 1000000) AS BIGINT) AS precision, CAST(round(r * 1000000) AS BIGINT) AS recall, CAST(round(2 * p * r / (p + r) * 1000000) AS BIGINT) AS f1 FROM v"))
def rates(spark, d):
    own, drop = detection_parts(spark, d)
    got = evaluation.precision_recall(evaluation.detections(own, drop), own, drop, 95)
    return got.select(*[micro(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


MARBLES = ", a AS (SELECT id AS marble, x, y FROM points2d WHERE grp < 5), b AS (SELECT id AS hole, x AS hx, y AS hy FROM points2d WHERE grp >= 5), p AS (SELECT marble, hole, sqrt((x - hx) * (x - hx) + (y - hy) * (y - hy)) AS dist FROM a, b WHERE sqrt((x - hx) * (x - hx) + (y - hy) * (y - hy)) <= 2)"


def marbles_holes(spark, d):
    p = points2d(spark, d)
    return p.where("grp < 5").select(F.col("id").alias("marble"), "x", "y"), p.where("grp >= 5").select(F.col("id").alias("hole"), F.col("x").alias("hx"), F.col("y").alias("hy"))


@query("EV-03", sql("points2d", MARBLES + ", m AS (SELECT count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY marble ORDER BY dist, hole) AS ra, row_number() OVER (PARTITION BY hole ORDER BY dist, marble) AS rb FROM p) WHERE ra = 1 AND rb = 1), v AS (SELECT n::DOUBLE / (SELECT count(*) FROM a) AS p, n::DOUBLE / (SELECT count(*) FROM b) AS r FROM m)\nSELECT CAST(round(p * 1000000) AS BIGINT) AS precision, CAST(round(r * 1000000) AS BIGINT) AS recall, CAST(round(2 * p * r / (p + r) * 1000000) AS BIGINT) AS f FROM v"))
def marble_scores(spark, d):
    return evaluation.marble_scores(*marbles_holes(spark, d), 2.0).select(*[micro(F.col(c)).alias(c) for c in ("precision", "recall", "f")])


@query("EV-04", sql("points2d", MARBLES + ", v AS (SELECT 1 - (SELECT count(DISTINCT marble) FROM p)::DOUBLE / (SELECT count(*) FROM a) AS s, 1 - (SELECT count(DISTINCT hole) FROM p)::DOUBLE / (SELECT count(*) FROM b) AS m)\nSELECT CAST(round(s * 1000000) AS BIGINT) AS spurious, CAST(round(m * 1000000) AS BIGINT) AS missing, CAST(round(2 * (1 - s) * (1 - m) / (2 - s - m) * 1000000) AS BIGINT) AS f FROM v"))
def spurious_missing(spark, d):
    return evaluation.spurious_missing(*marbles_holes(spark, d), 2.0).select(*[micro(F.col(c)).alias(c) for c in ("spurious", "missing", "f")])


def two_maps(spark, d):
    e = metric_edges(spark, d).where("source < target")
    moved = sets.share_of(e, "edge_id", 0.7, 1).select("edge_id", *[(F.col(c) + 6.0).alias(c) for c in ("ax", "ay", "bx", "by")])
    return e, moved


#: Ways of a segment a-b within a reach of a segment c-d, as in ``evaluation.covered``.
TUBE = (
    "tu AS (SELECT *, sqrt((dx - cx) * (dx - cx) + (dy - cy) * (dy - cy)) AS size FROM pr), "
    "tv AS (SELECT *, ((ax - cx) * (dx - cx) + (ay - cy) * (dy - cy)) / size AS u0, ((bx - cx) * (dx - cx) + (b_y - cy) * (dy - cy)) / size AS u1, ((ay - cy) * (dx - cx) - (ax - cx) * (dy - cy)) / size AS v0, ((b_y - cy) * (dx - cx) - (bx - cx) * (dy - cy)) / size AS v1, "
    "(bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay) AS qa, 2 * ((ax - cx) * (bx - ax) + (ay - cy) * (b_y - ay)) AS qb1, (ax - cx) * (ax - cx) + (ay - cy) * (ay - cy) - reach * reach AS qc1, 2 * ((ax - dx) * (bx - ax) + (ay - dy) * (b_y - ay)) AS qb2, (ax - dx) * (ax - dx) + (ay - dy) * (ay - dy) - reach * reach AS qc2 FROM tu), "
    "tw AS (SELECT *, greatest(0e0, CASE WHEN u1 <> u0 THEN least(-u0 / (u1 - u0), (size - u0) / (u1 - u0)) END, CASE WHEN v1 <> v0 THEN least((-reach - v0) / (v1 - v0), (reach - v0) / (v1 - v0)) END) AS lo0, least(1e0, CASE WHEN u1 <> u0 THEN greatest(-u0 / (u1 - u0), (size - u0) / (u1 - u0)) END, CASE WHEN v1 <> v0 THEN greatest((-reach - v0) / (v1 - v0), (reach - v0) / (v1 - v0)) END) AS hi0, "
    "(u1 <> u0 OR u0 BETWEEN 0 AND size) AND (v1 <> v0 OR v0 BETWEEN -reach AND reach) AS fits, CASE WHEN qb1 * qb1 - 4 * qa * qc1 >= 0 THEN sqrt(qb1 * qb1 - 4 * qa * qc1) END AS r1, CASE WHEN qb2 * qb2 - 4 * qa * qc2 >= 0 THEN sqrt(qb2 * qb2 - 4 * qa * qc2) END AS r2 FROM tv), "
    "tx AS (SELECT *, greatest(0e0, (-qb1 - r1) / (2 * qa)) AS lo1, least(1e0, (-qb1 + r1) / (2 * qa)) AS hi1, greatest(0e0, (-qb2 - r2) / (2 * qa)) AS lo2, least(1e0, (-qb2 + r2) / (2 * qa)) AS hi2 FROM tw), "
    "ty AS (SELECT edge_id, reach, least(CASE WHEN fits AND lo0 <= hi0 THEN lo0 END, CASE WHEN r1 IS NOT NULL AND lo1 <= hi1 THEN lo1 END, CASE WHEN r2 IS NOT NULL AND lo2 <= hi2 THEN lo2 END) AS a, greatest(CASE WHEN fits AND lo0 <= hi0 THEN hi0 END, CASE WHEN r1 IS NOT NULL AND lo1 <= hi1 THEN hi1 END, CASE WHEN r2 IS NOT NULL AND lo2 <= hi2 THEN hi2 END) AS b FROM tx), "
    "tz AS (SELECT *, max(b) OVER (PARTITION BY edge_id, reach ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM ty WHERE a < b), "
    "sh AS (SELECT edge_id, reach, sum(greatest(0e0, b - greatest(a, coalesce(seen, a)))) AS share FROM tz GROUP BY edge_id, reach)"
)
MAPS = f", {METRIC}, g AS (SELECT * FROM m WHERE source < target), o AS (SELECT edge_id, ax + 6 AS ax, ay + 6 AS ay, bx + 6 AS bx, b_y + 6 AS b_y FROM g WHERE (edge_id + 1) * 2654435761 % 4294967296 < 3006477107)"


def inside_sql(own: str, other: str, reaches: list[int], tag: str = "") -> str:
    """CTE in{tag} (edge_id, reach, length, inside) of the map ``own`` within reaches of the map ``other``."""
    far, listed = max(reaches), ", ".join(f"{r}e0" for r in reaches)
    pairs = f"pr AS (SELECT p.edge_id, p.ax, p.ay, p.bx, p.b_y, q.ax AS cx, q.ay AS cy, q.bx AS dx, q.b_y AS dy, unnest([{listed}]) AS reach FROM {own} p JOIN {other} q ON least(q.ax, q.bx) <= greatest(p.ax, p.bx) + {far} AND greatest(q.ax, q.bx) >= least(p.ax, p.bx) - {far} AND least(q.ay, q.b_y) <= greatest(p.ay, p.b_y) + {far} AND greatest(q.ay, q.b_y) >= least(p.ay, p.b_y) - {far})"
    text = f"{pairs}, {TUBE}, le AS (SELECT edge_id, sqrt((ax - bx) * (ax - bx) + (ay - b_y) * (ay - b_y)) AS length, unnest([{listed}]) AS reach FROM {own}), in AS (SELECT le.*, length * coalesce(share, 0) AS inside FROM le LEFT JOIN sh USING (edge_id, reach))"
    for name in ("pr", "tu", "tv", "tw", "tx", "ty", "tz", "sh", "le", "in"):
        text = re.sub(rf"\b{name}( AS \(SELECT)", rf"{name}{tag}_\1", text)
        text = re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 {name}{tag}_", text)
    return text.replace("SELECT le.*", f"SELECT le{tag}_.*")


REACHES = list(range(5, 55, 5))


@query("EV-05", sql("edges", MAPS + ", " + inside_sql("g", "o", REACHES, "a") + ", " + inside_sql("o", "g", REACHES, "b") + ", v AS (SELECT reach, sum(inside) / sum(length) AS c FROM ina_ GROUP BY reach), w AS (SELECT reach, sum(inside) / sum(length) AS r FROM inb_ GROUP BY reach)\nSELECT reach, CAST(round(c * 10000) AS BIGINT) AS completeness, CAST(round(r * 10000) AS BIGINT) AS correctness, CAST(round(2 * c * r / (c + r) * 10000) AS BIGINT) AS f FROM v JOIN w USING (reach)"))
def buffer_scores(spark, d):
    got = evaluation.buffer_scores(*two_maps(spark, d), [float(r) for r in REACHES])
    return got.select("reach", *[F.round(F.col(c) * 10_000).cast("long").alias(c) for c in ("completeness", "correctness", "f")])


@query("AG-20", sql("edges", MAPS + ", " + inside_sql("g", "o", [10]) + f"\nSELECT edge_id, {k('length')} AS length, round(inside, 1) AS inside FROM in_"))
def overlap(spark, d):
    ground, other = two_maps(spark, d)
    own = evaluation.covered(ground, other, 10.0)
    return own.select("edge_id", thousandths(F.col("length")).alias("length"), F.round("inside", 1).alias("inside"))


@query("GE-15", sql("edges", MAPS + ", " + inside_sql("o", "g", [10]) + "\nSELECT edge_id, round(inside, 1) AS inside FROM in_"))
def clip_lengths(spark, d):
    ground, other = two_maps(spark, d)
    return evaluation.covered(other, ground, 10.0).select("edge_id", F.round("inside", 1).alias("inside"))


def two_link_paths(spark, d):
    """A path along every two links that meet, a little off the roads, and the roads."""
    e = metric_edges(spark, d)
    nxt = e.select(F.col("source").alias("target"), F.col("target").alias("_t2"), F.col("bx").alias("cx"), F.col("by").alias("cy"))
    two = e.join(nxt, "target").where("source < _t2")
    point = lambda x, y, o: F.struct((F.col(x) + o).alias("x"), (F.col(y) - o).alias("y"))
    return two.select((F.col("edge_id") * 1_000_000 + F.col("_t2")).alias("path"), F.array(point("ax", "ay", 4.0), point("bx", "by", 7.0), point("cx", "cy", 5.0)).alias("points")), e


@query("EV-06")
def frechet_paths(spark, d):
    """Held against a search over the whole graph in the tests."""
    return evaluation.path_distances(*two_link_paths(spark, d), "frechet")


@query("EV-07")
def hausdorff_paths(spark, d):
    return evaluation.path_distances(*two_link_paths(spark, d), "hausdorff")


@query("EV-08")
def path_experiment(spark, d):
    """Both distances to a map that lacks a tenth of the links: how many paths are at each, as the experiment plots them."""
    paths, e = two_link_paths(spark, d)
    kept = sets.share_of(e, "edge_id", 0.9, 4)
    both = [evaluation.path_distances(paths, kept, kind).groupBy("distance").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(kind)) for kind in ("frechet", "hausdorff")]
    return both[0].unionByName(both[1])


#: How many pairs of a comparison, how far apart at most, and how long a way may be.
PAIRS, APART, LONGEST = 500, 5000.0, 15_000.0


def random_pairs(e):
    """The first ``PAIRS`` of origins and destinations drawn by two seeded orders that are at most ``APART``: a, b."""
    n = e.groupBy(F.col("source").alias("id")).agg(F.min("ax").alias("x"), F.min("ay").alias("y"))
    # what is drawn is bounded: eight times the pairs asked for
    drawn = [sets.sample(n, "id", 8 * PAIRS, seed).withColumn("i", F.row_number().over(W.orderBy(sets.scattered("id", seed), "id"))) for seed in (5, 6)]
    b = drawn[1].select("i", F.col("id").alias("b"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    far = F.sqrt((F.col("x") - F.col("_x")) * (F.col("x") - F.col("_x")) + (F.col("y") - F.col("_y")) * (F.col("y") - F.col("_y")))
    return drawn[0].withColumnRenamed("id", "a").join(b, "i").where((F.col("a") != F.col("b")) & (far <= APART)).orderBy("i").limit(PAIRS).select("i", "a", "b")


def redrawn(e):
    """Another map of the same streets: nodes under other ids and some metres off, a tenth of the links left out."""
    new = lambda c: F.col(c) * 7 + 1_000_003
    off = lambda c, k: (F.col(c) * k) % 21 - 10
    own = sets.share_of(e, "edge_id", 0.9, 4)
    places = {"ax": F.col("ax") + off("source", 31), "ay": F.col("ay") + off("source", 17), "bx": F.col("bx") + off("target", 31), "by": F.col("by") + off("target", 17)}
    moved = own.withColumns(places).withColumns({"source": new("source"), "target": new("target")})
    return moved.withColumn("length", F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")))


@query("EV-09")
def shortest_path_comparison(spark, d):
    """From seeded starts to the farthest nodes around them, on the map and on one redrawn with other ids; four distances between the two ways, infinite where there is no counterpart or no way."""
    e = metric_edges(spark, d)
    drawn = sets.sample(e.select(F.col("source").alias("a")).distinct(), "a", PAIRS, 5)
    starts = drawn.withColumn("i", F.row_number().over(W.orderBy(sets.scattered("a", 5), "a")).cast("long"))  # PAIRS rows
    got = way_comparison.compared(starts, e, redrawn(e), LONGEST, APART)
    return got.select("i", F.col("a").alias("origin"), F.col("b").alias("destination"), F.col("oa").alias("origin_there"), F.col("ob").alias("destination_there"), *[F.round(c, 3).alias(c) for c in way_comparison.MEASURES])


@query("EV-10", sql("edges crossings", DIRECTED + ", c AS (SELECT edge_id, count(*) AS n FROM crossings GROUP BY edge_id), dd AS (SELECT DISTINCT edge_id FROM f)\nSELECT e.edge_id, CASE WHEN dd.edge_id IS NOT NULL THEN 'detected' WHEN e.weight = 7 THEN 'false' WHEN e.length < 95 THEN 'short' WHEN coalesce(c.n, 0) < 10 THEN 'rare' ELSE 'missed' END AS kind FROM edges e LEFT JOIN dd USING (edge_id) LEFT JOIN c USING (edge_id)"))
def classes(spark, d):
    own, drop = detection_parts(spark, d)
    found = evaluation.detections(own, drop).select("edge_id").distinct()
    all_ = edges(spark, d).join(aggregates.trips_by_edge(crossings(spark, d)), "edge_id", "left")
    return evaluation.classes(all_, found, links(spark, d).where("weight = 7").select("edge_id"), 95, 10)


@query("GE-20", sql("points2d", MARBLES.split(", p AS")[0] + ", n AS (SELECT a.marble, b.hole, sqrt((x - hx) * (x - hx) + (y - hy) * (y - hy)) AS dist FROM a, b)\nSELECT " + k("greatest((SELECT max(m) FROM (SELECT min(dist) AS m FROM n GROUP BY marble)), (SELECT max(m) FROM (SELECT min(dist) AS m FROM n GROUP BY hole)))") + " AS hausdorff"))
def hausdorff(spark, d):
    a, b = marbles_holes(spark, d)
    return geometry.point_set_distances(a, b, ("x", "y"), ("hx", "hy"), 2.0).select(thousandths(F.col("hausdorff")).alias("hausdorff"))


@query("GE-21", sql("points2d", MARBLES.split(", p AS")[0] + ", n AS (SELECT a.marble, b.hole, sqrt((x - hx) * (x - hx) + (y - hy) * (y - hy)) AS dist FROM a, b)\nSELECT " + k("greatest((SELECT avg(m) FROM (SELECT min(dist) AS m FROM n GROUP BY marble)), (SELECT avg(m) FROM (SELECT min(dist) AS m FROM n GROUP BY hole)))") + " AS modified"))
def modified_hausdorff(spark, d):
    a, b = marbles_holes(spark, d)
    return geometry.point_set_distances(a, b, ("x", "y"), ("hx", "hy"), 2.0).select(thousandths(F.col("modified")).alias("modified"))


def line_pairs(spark, d):
    own = lines(spark, d)
    nxt = own.select((F.col("route_id") - 1).alias("route_id"), F.col("points").alias("b"))
    return own.select("route_id", F.col("points").alias("a")).join(nxt, "route_id")


@query("GE-19")
def discrete_frechet(spark, d):
    got = geometry.line_pair_distances(line_pairs(spark, d), "route_id")
    return got.select("route_id", F.round("frechet", 3).alias("frechet"))


@query("GE-22")
def average_vertical(spark, d):
    got = geometry.line_pair_distances(line_pairs(spark, d), "route_id")
    return got.select("route_id", F.round("vertical", 3).alias("vertical"))


@query("GE-16")
def smallest_boxes(spark, d):
    from trackloom.kernels import curves

    got = geometry.grouped_points(geometry.hull_members(points2d(spark, d), "grp"), "grp", curves.smallest_box, "id")
    return got.select("grp", "n", thousandths(F.col("x")).alias("x"), thousandths(F.col("y")).alias("y"))


@query("GE-17", sql("edges", MAPS + ", " + inside_sql("g", "o", [15]) + "\nSELECT edge_id, round(inside / length, 4) AS share FROM in_"))
def zone_intervals(spark, d):
    from trackloom.operators.evaluation import covered

    ground, other = two_maps(spark, d)
    return covered(ground, other, 15.0).select("edge_id", F.round(F.col("inside") / F.col("length"), 4).alias("share"))


@query("OR-01", f"SELECT r * 4 + c AS tile, CAST(round(({S}e0 + r * (({N}e0 - {S}e0) / 3)) * 1000000) AS BIGINT) AS south, CAST(round(({WE}e0 + c * (({E}e0 - {WE}e0) / 4)) * 1000000) AS BIGINT) AS west FROM range(3) a(r), range(4) b(c)")
def tile_grid(spark, d):
    return tiles.tile_boxes(spark, BOX, 3, 4).select("tile", micro(F.col("south")).alias("south"), micro(F.col("west")).alias("west"))


@query("OR-02", sql("gps", f"SELECT CAST(least(2, floor((lat - {S}e0) / (({N}e0 - {S}e0) / 3))) * 4 + least(3, floor((lon - {WE}e0) / (({E}e0 - {WE}e0) / 4))) AS BIGINT) AS tile, count(*) AS n, count(DISTINCT route_id) AS routes FROM gps WHERE lat BETWEEN {S}e0 AND {N}e0 AND lon BETWEEN {WE}e0 AND {E}e0 GROUP BY 1"))
def pipeline_by_tile(spark, d):
    return tiles.by_tile(gps(spark, d), BOX, 3, 4, [lambda t: t.groupBy("tile").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("route_id").alias("routes"))])


@query("UX-01", sql("gps", f"SELECT event_id, ({STRICT}) AS in_bound, CASE WHEN value > 250 THEN 'high' ELSE 'low' END AS level FROM gps"))
def row_functions(spark, d):
    from trackloom.operators.filters import strictly_inside

    return gps(spark, d).select("event_id", strictly_inside("lat", "lon", BOX).alias("in_bound"), F.when(F.col("value") > 250, "high").otherwise("low").alias("level"))


@query("UX-02")
def callbacks(spark, d):
    """Matching with an emission function of one's own."""
    return matching.match_trips(metric_trips(spark, d), metric_edges(spark, d), 80.0, emit=lambda m: max(0.0, 1 - m / 80))




@query("UX-03", sql("gps edges", BOXES.replace("83044.98918812413e0 AS x,", "83044.98918812413e0 + 5 AS x,").replace("111070.34306591158e0 AS y FROM gps", "111070.34306591158e0 - 5 AS y FROM gps") + "\nSELECT event_id, edge_id FROM p JOIN e ON x BETWEEN x0 - 30 AND x1 + 30 AND y BETWEEN y0 - 30 AND y1 + 30"))
def geometry_hooks(spark, d):
    """Candidates with geometries of observations and of states of one's own: the first moved by five metres, the second a road's box."""
    boxed = lambda e: e.select("edge_id", F.least("ax", "bx").alias("x0"), F.least("ay", "by").alias("y0"), F.greatest("ax", "bx").alias("x1"), F.greatest("ay", "by").alias("y1"))
    moved = lambda p: p.withColumns({"x": F.col("x") + 5.0, "y": F.col("y") - 5.0})
    return matching.boxed_candidates(metric_points(spark, d), metric_edges(spark, d), 30.0, moved, boxed).select("event_id", "edge_id")


@query("UX-04", sql("edges", f"SELECT edge_id, {k(hav('lat1', 'lon1', 'lat2', 'lon2'))} AS dist FROM edges"))
def native_kernel(spark, d):
    """A numpy kernel over Arrow batches."""
    from trackloom.operators.matching import with_kernel_distance

    return with_kernel_distance(edges(spark, d), ("lat1", "lon1", "lat2", "lon2"), "dist").select("edge_id", thousandths(F.col("dist")).alias("dist"))


@query("OR-03", f"SELECT * FROM (VALUES ('south', {S}e0), ('west', {WE}e0), ('north', {N}e0), ('east', {E}e0)) v(name, value)")
def area_parameters(spark, d):
    """What an application asks its user for: the parameters of an area, as a table."""
    return spark.createDataFrame(list(zip(("south", "west", "north", "east"), BOX, strict=True)), "name string, value double")


@query("OR-04", "SELECT * FROM (VALUES ('sessions', 'seconds', '10.0'), ('sessions', 'metres', '100.0'), ('sessions', 'speed', '25.0'), ('sessions', 'least_metres', '5.0'), ('clean', 'seconds', '20.0'), ('clean', 'most', '170.0'), ('clean', 'least', '5.0'), ('clean', 'fastest', '26.0'), ('clean', 'slowest', '2.0'), ('match', 'reach', '150.0'), ('match', 'keep', '300'), ('score', 'degrees', '20.0'), ('score', 'length', '50.0')) v(stage, argument, given)")
def stage_arguments(spark, d):
    """The stages of the command line with their typed arguments and defaults."""
    from trackloom.stages import STAGES

    rows = [(name, a, str(v)) for name, stage in STAGES.items() for a, v in stage.arguments.items()]
    return spark.createDataFrame(rows, "stage string, argument string, given string")
