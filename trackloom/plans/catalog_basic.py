"""Filters, joins, aggregates, windows and sets over the bound tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.functions import geo, stats
from trackloom.operators import aggregates, filters, joins, sets, trajectories
from trackloom.plans.registry import query
from trackloom.plans.relations import BOX, crossings, edges, gps, hav, k, links, matches, micro, nodes, points2d, sql, table, thousandths, u

S, WE, N, E = BOX
INSIDE = f"lat BETWEEN {S}e0 AND {N}e0 AND lon BETWEEN {WE}e0 AND {E}e0"
STRICT = f"lat > {S}e0 AND lat < {N}e0 AND lon > {WE}e0 AND lon < {E}e0"
ENDS = f"lat1 BETWEEN {S}e0 AND {N}e0 AND lon1 BETWEEN {WE}e0 AND {E}e0 AND lat2 BETWEEN {S}e0 AND {N}e0 AND lon2 BETWEEN {WE}e0 AND {E}e0"
#: 10 and 20 January 2024, in microseconds.
START, END = 1704844800000000, 1705708800000000
MATCHES = ", m AS (SELECT id, list(edge_id ORDER BY n, edge_id, ep, tp, error) AS opath, list(ep ORDER BY n, edge_id, ep, tp, error) AS ep, list(tp ORDER BY n, edge_id, ep, tp, error) AS tp, list(error ORDER BY n, edge_id, ep, tp, error) AS error FROM crossings GROUP BY id)\n"


@query("PF-01", sql("gps", f"SELECT event_id, route_id, {u('lon')} AS lon, {u('lat')} AS lat FROM gps"))
def projection(spark, d):
    return gps(spark, d).select("event_id", "route_id", micro(F.col("lon")).alias("lon"), micro(F.col("lat")).alias("lat"))


@query("PF-02", sql("gps", "SELECT event_id, strftime(make_timestamp((us // 1000) * 1000), '%Y-%m-%d %H:%M:%S') AS at FROM gps"))
def epoch_millis(spark, d):
    return gps(spark, d).select("event_id", F.date_format(F.timestamp_millis(F.floor(F.col("us") / 1000)), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("PF-03", sql("gps", f"SELECT event_id, ({STRICT}) AS in_bound FROM gps"))
def strict_box(spark, d):
    return gps(spark, d).select("event_id", filters.strictly_inside("lat", "lon", BOX).alias("in_bound"))


@query("PF-04", sql("gps", f"SELECT event_id FROM gps WHERE {INSIDE}"))
def inclusive_box(spark, d):
    return gps(spark, d).where(filters.inside("lat", "lon", BOX)).select("event_id")


@query("PF-05", sql("gps", f"SELECT event_id, us FROM gps WHERE us BETWEEN {START} AND {END}"))
def time_range(spark, d):
    return filters.in_time(gps(spark, d), "us", START, END).select("event_id", "us")


@query("PF-06", sql("edges", f"SELECT edge_id FROM edges WHERE {ENDS}"))
def ends_in_box(spark, d):
    return edges(spark, d).where(filters.both_ends_inside(BOX)).select("edge_id")


@query("PF-07", sql("edges crossings", ", c AS (SELECT edge_id, count(*) AS n FROM crossings GROUP BY edge_id)\nSELECT edge_id, n FROM edges JOIN c USING (edge_id) WHERE length > 100 AND n >= 2"))
def thresholds(spark, d):
    n = aggregates.trips_by_edge(crossings(spark, d)).withColumnRenamed("num_trips", "n").where("n >= 2")
    return edges(spark, d).where("length > 100").join(n, "edge_id").select("edge_id", "n")


@query("PF-08", sql("links", "SELECT edge_id, highway FROM links WHERE highway IN ('residential', 'service')"))
def by_category(spark, d):
    return links(spark, d).where(F.col("highway").isin("residential", "service")).select("edge_id", "highway")


@query("PF-09", sql("links crossings", "SELECT c.id, c.n, l.edge_id IS NULL AS missing FROM crossings c LEFT JOIN links l USING (edge_id)"))
def nulls(spark, d):
    own = links(spark, d).select("edge_id", F.lit(1).alias("there"))
    return crossings(spark, d).join(own, "edge_id", "left").select("id", "n", F.col("there").isNull().alias("missing"))


@query("PF-10", sql("edges crossings", f", c AS (SELECT edge_id, count(*) AS n FROM crossings GROUP BY edge_id)\nSELECT edge_id, length > 110 AS long, coalesce(n, 0) > 30 AS common, ({ENDS}) AS in_bound FROM edges LEFT JOIN c USING (edge_id)"))
def flags(spark, d):
    n = aggregates.trips_by_edge(crossings(spark, d))
    return edges(spark, d).join(n, "edge_id", "left").select("edge_id", (F.col("length") > 110).alias("long"), (F.coalesce("num_trips", F.lit(0)) > 30).alias("common"), filters.both_ends_inside(BOX).alias("in_bound"))


@query("PF-11", sql("crossings", MATCHES + "SELECT id, CAST(len(opath) AS BIGINT) AS n FROM m WHERE len(opath) = len(ep) AND len(ep) = len(error)"))
def consistent_arrays(spark, d):
    return matches(spark, d).where(filters.same_length("opath", "ep", "error")).select("id", F.size("opath").cast("long").alias("n"))


@query("PF-12", sql("gps", ", b AS (SELECT * FROM gps WHERE value BETWEEN 5 AND 100)\nSELECT min(event_id) AS event_id, {x} AS lon, {y} AS lat FROM b GROUP BY lon, lat".format(x=u("lon"), y=u("lat")).replace("GROUP BY lon, lat", "GROUP BY b.lon, b.lat")))
def speed_band(spark, d):
    own = filters.speed_band(gps(spark, d), "value", 5, 100, ("lon", "lat"), "event_id")
    return own.select("event_id", micro(F.col("lon")).alias("lon"), micro(F.col("lat")).alias("lat"))


@query("PF-13", sql("nodes", f"SELECT node_id FROM nodes WHERE {INSIDE}"))
def node_window(spark, d):
    return nodes(spark, d).where(filters.inside("lat", "lon", BOX)).select("node_id")


@query("JN-01", sql("edges", f"SELECT edge_id, source, target, {u('lat1')} AS lat1, {u('lon1')} AS lon1, {u('lat2')} AS lat2, {u('lon2')} AS lon2, {k('length')} AS length FROM edges"))
def ends(spark, d):
    return edges(spark, d).select("edge_id", "source", "target", *[micro(F.col(c)).alias(c) for c in ("lat1", "lon1", "lat2", "lon2")], thousandths(F.col("length")).alias("length"))


@query("JN-02", sql("links", "SELECT a.edge_id FROM links a WHERE EXISTS (SELECT 1 FROM links b WHERE b.highway = 'residential' AND b.source = a.source AND b.target = a.target)"))
def both_ends(spark, d):
    own = links(spark, d)
    return joins.on_both_ends(own, own.where("highway = 'residential'")).select("edge_id")


@query("JN-03", sql("links crossings", "SELECT DISTINCT id FROM crossings WHERE edge_id IN (SELECT edge_id FROM links)"))
def semi(spark, d):
    return joins.known(crossings(spark, d), links(spark, d), "edge_id").select("id").distinct()


@query("JN-04", sql("links crossings", "SELECT edge_id FROM links WHERE edge_id NOT IN (SELECT edge_id FROM crossings)"))
def anti(spark, d):
    return joins.unknown(links(spark, d), crossings(spark, d), "edge_id").select("edge_id")


@query("JN-05", sql("edges crossings", f"SELECT c.id, c.n - 1 AS pos, edge_id, {k('length')} AS length FROM (SELECT id, edge_id, row_number() OVER (PARTITION BY id ORDER BY n, edge_id, ep, tp, error) AS n FROM crossings) c JOIN edges USING (edge_id)"))
def exploded(spark, d):
    return joins.exploded_path(matches(spark, d), edges(spark, d)).select("id", F.col("pos").cast("long").alias("pos"), "edge_id", thousandths(F.col("length")).alias("length"))


#: The two factors are fixed values: metres a degree of longitude and of latitude.
BOXES = ", p AS (SELECT event_id, lon * 83044.98918812413e0 AS x, lat * 111070.34306591158e0 AS y FROM gps),\ne AS (SELECT edge_id, least(lon1, lon2) * 83044.98918812413e0 AS x0, least(lat1, lat2) * 111070.34306591158e0 AS y0, greatest(lon1, lon2) * 83044.98918812413e0 AS x1, greatest(lat1, lat2) * 111070.34306591158e0 AS y1 FROM edges)"


def metric_points(spark, d):
    return gps(spark, d).select("event_id", (F.col("lon") * 83044.98918812413).alias("x"), (F.col("lat") * 111070.34306591158).alias("y"))


def metric_boxes(spark, d):
    lo, hi = (lambda c: F.least(f"{c}1", f"{c}2")), (lambda c: F.greatest(f"{c}1", f"{c}2"))
    return edges(spark, d).select("edge_id", *[(f(c) * m).alias(o) for f, c, m, o in ((lo, "lon", 83044.98918812413, "x0"), (lo, "lat", 111070.34306591158, "y0"), (hi, "lon", 83044.98918812413, "x1"), (hi, "lat", 111070.34306591158, "y1"))])


@query("JN-06", sql("gps edges", BOXES + "\nSELECT event_id, edge_id FROM p JOIN e ON x BETWEEN x0 - 15 AND x1 + 15 AND y BETWEEN y0 - 15 AND y1 + 15"))
def box_candidates(spark, d):
    return joins.within_box(metric_points(spark, d), metric_boxes(spark, d), 15.0).select("event_id", "edge_id")


@query("JN-07", sql("points2d", ", a AS (SELECT * FROM points2d WHERE grp < 5), b AS (SELECT * FROM points2d WHERE grp >= 5)\nSELECT id, other, {d} AS dist FROM (SELECT a.id, b.id AS other, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS dist FROM a, b) QUALIFY row_number() OVER (PARTITION BY id ORDER BY dist, other) = 1".format(d=k("dist"))))
def nearest_one(spark, d):
    p = points2d(spark, d)
    b = p.where("grp >= 5").select(F.col("id").alias("other"), F.col("x").alias("bx"), F.col("y").alias("by"))
    near = joins.nearest(p.where("grp < 5"), b, "id", "other", ("x", "y"), ("bx", "by"), 2.0)
    return near.select("id", "other", thousandths(F.col("dist")).alias("dist"))


@query("JN-08", sql("points2d", ", a AS (SELECT * FROM points2d WHERE grp < 5), b AS (SELECT * FROM points2d WHERE grp >= 5)\nSELECT id, other, rank FROM (SELECT a.id, b.id AS other, row_number() OVER (PARTITION BY a.id ORDER BY sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), b.id) AS rank FROM a, b) WHERE rank <= 3"))
def nearest_three(spark, d):
    p = points2d(spark, d)
    b = p.where("grp >= 5").select(F.col("id").alias("other"), F.col("x").alias("bx"), F.col("y").alias("by"))
    return joins.nearest(p.where("grp < 5"), b, "id", "other", ("x", "y"), ("bx", "by"), 2.0, k=3).select("id", "other", F.col("rank").cast("long").alias("rank"))


@query("JN-09", sql("points2d", "SELECT a.id, b.id AS other, {d} AS dist FROM points2d a, points2d b WHERE {e} <= 1.5e0".format(d=k("sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"), e="sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))")))
def all_distances(spark, d):
    """All distances up to a cutoff, so that no cross join is needed."""
    p = points2d(spark, d).select("id", "x", "y")
    b = p.select(F.col("id").alias("other"), F.col("x").alias("bx"), F.col("y").alias("by"))
    return joins.within_distance(p, b, 1.5, ("x", "y"), ("bx", "by")).select("id", "other", thousandths(F.col("dist")).alias("dist"))


@query("JN-10", sql("gps", "SELECT event_id FROM gps a WHERE kind <> 'error' AND NOT EXISTS (SELECT 1 FROM gps b WHERE b.kind = 'error' AND b.route_id = a.route_id AND b.us BETWEEN a.us - 7200000000 AND a.us + 7200000000)"))
def blackout(spark, d):
    return joins.clear_of(gps(spark, d), "route_id", "us", F.col("kind") == "error", 7_200_000_000).select("event_id")


@query("JN-11", sql("edges crossings", "SELECT c.id, c.n, e.source, e.target FROM crossings c JOIN edges e USING (edge_id)"))
def by_edge_id(spark, d):
    return crossings(spark, d).join(links(spark, d), "edge_id").select("id", "n", "source", "target")


@query("JN-12", sql("links", "SELECT a.edge_id, b.edge_id AS next_id, a.source = b.target AS returns FROM links a JOIN links b ON b.source = a.target"))
def adjacent(spark, d):
    return joins.onward(links(spark, d))


def ccw_sql(a, b, c):
    return f"(({b}x - {a}x) * ({c}y - {a}y) - ({b}y - {a}y) * ({c}x - {a}x) > 0)"


SEGMENTS = ", s AS (SELECT a.id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by FROM points2d a JOIN points2d b ON b.id = a.id + 1 WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) < 10)\n"


def segments(spark, d):
    p = points2d(spark, d)
    b = p.select((F.col("id") - 1).alias("id"), F.col("x").alias("bx"), F.col("y").alias("by"))
    own = p.select("id", F.col("x").alias("ax"), F.col("y").alias("ay")).join(b, "id")
    return own.where(F.sqrt((F.col("ax") - F.col("bx")) * (F.col("ax") - F.col("bx")) + (F.col("ay") - F.col("by")) * (F.col("ay") - F.col("by"))) < 10)


@query("JN-13", sql("points2d", SEGMENTS + "SELECT p.id AS a, q.id AS b FROM s p JOIN s q ON p.id < q.id AND {0} <> {1} AND {2} <> {3}".format(ccw_sql("p.a", "q.a", "q.b"), ccw_sql("p.b", "q.a", "q.b"), ccw_sql("p.a", "p.b", "q.a"), ccw_sql("p.a", "p.b", "q.b"))))
def crossing_segments(spark, d):
    from trackloom.operators.geometry import crossing_pairs

    return crossing_pairs(segments(spark, d), "id", 10.0).select("a", "b")


@query("JN-14", sql("gps edges", BOXES.replace("edge_id, least", "edge_id, lon1 * 83044.98918812413e0 AS ax, lat1 * 111070.34306591158e0 AS ay, lon2 * 83044.98918812413e0 AS qx, lat2 * 111070.34306591158e0 AS qy, least") + ",\nf AS (SELECT event_id, edge_id, x, y, ax, ay, qx, qy, greatest(0e0, least(1e0, ((x - ax) * (qx - ax) + (y - ay) * (qy - ay)) / ((qx - ax) * (qx - ax) + (qy - ay) * (qy - ay)))) AS f FROM p JOIN e ON x BETWEEN x0 - 50 AND x1 + 50 AND y BETWEEN y0 - 50 AND y1 + 50)\nSELECT event_id, edge_id FROM f WHERE (x - ax - f * (qx - ax)) * (x - ax - f * (qx - ax)) + (y - ay - f * (qy - ay)) * (y - ay - f * (qy - ay)) <= 2500"))
def in_edge_zone(spark, d):
    from trackloom.operators.geometry import within_reach

    own = edges(spark, d).select("edge_id", *[(F.col(c) * m).alias(o) for c, m, o in (("lon1", 83044.98918812413, "ax"), ("lat1", 111070.34306591158, "ay"), ("lon2", 83044.98918812413, "bx"), ("lat2", 111070.34306591158, "by"))])
    return within_reach(metric_points(spark, d), own, 50.0).select("event_id", "edge_id")


@query("AG-01", sql("crossings", "SELECT edge_id, count(*) AS num_trips FROM crossings GROUP BY edge_id"))
def trips_by_edge(spark, d):
    return aggregates.trips_by_edge(crossings(spark, d))


@query("AG-02", sql("gps", f"SELECT {u('min(lat)')} AS south, {u('max(lat)')} AS north, {u('min(lon)')} AS west, {u('max(lon)')} AS east, count(*) AS n FROM gps"))
def extent(spark, d):
    return aggregates.extent(gps(spark, d)).select(*[micro(F.col(c)).alias(c) for c in ("south", "north", "west", "east")], "n")


@query("AG-03", sql("gps", "SELECT min(us) AS first, max(us) AS last FROM gps"))
def time_extent(spark, d):
    return gps(spark, d).agg(F.min("us").alias("first"), F.max("us").alias("last"))


@query("AG-04", sql("crossings", MATCHES + "SELECT id, list_sum(ep) > 0 AND list_sum(ep) < 4.5e0 AS unmatched FROM m"))
def unmatched(spark, d):
    return matches(spark, d).select("id", aggregates.is_unmatched("ep", 9, 0.5).alias("unmatched"))


@query("AG-05", sql("crossings", f", r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n, edge_id, ep, tp, error) AS r FROM crossings)\nSELECT id, {u('avg(ep * CASE WHEN r = 1 THEN 1 ELSE tp END)')} AS score FROM r GROUP BY id"))
def scores(spark, d):
    return matches(spark, d).select("id", micro(aggregates.mean_score("ep", "tp")).alias("score"))


@query("AG-06", sql("crossings", "SELECT id, bool_or(ep > exp(-1.25e0) AND ep < exp(-0.25e0)) AS flagged FROM crossings GROUP BY id"))
def in_band(spark, d):
    return matches(spark, d).select("id", aggregates.any_in_band("ep", 40.0, 20.0, 100.0).alias("flagged"))


@query("AG-07", sql("links crossings", "SELECT count(DISTINCT edge_id) AS detected FROM crossings JOIN links USING (edge_id)"))
def detected(spark, d):
    return crossings(spark, d).join(links(spark, d), "edge_id").agg(F.countDistinct("edge_id").alias("detected"))


@query("AG-09", sql("gps", ", b AS (SELECT least(49, floor((value - lo) / ((hi - lo) / 50))) AS bin FROM gps, (SELECT min(value) AS lo, max(value) AS hi FROM gps)), c AS (SELECT u.bin, count(b.bin) AS n FROM range(50) u(bin) LEFT JOIN b ON b.bin = u.bin GROUP BY u.bin), s AS (SELECT bin, abs(sum(n) OVER (ORDER BY bin) / sum(n) OVER () - 0.95e0) AS gap FROM c)\nSELECT CAST(trunc(lo + (hi - lo) * (bin + 1) / 50) AS BIGINT) AS threshold FROM s, (SELECT min(value) AS lo, max(value) AS hi FROM gps) ORDER BY round(gap, 12), bin LIMIT 1"))
def threshold(spark, d):
    return stats.share_threshold(gps(spark, d), "value", 0.95, 50)


TRACES = ", t AS (SELECT route_id, event_id % 97 AS segment_id, route_id AS trace_id, {h} AS dist FROM gps)\n".format(h=hav("lat", "lon", "35.72e0", "51.35e0"))


def traces(spark, d):
    return gps(spark, d).select((F.col("event_id") % 97).alias("segment_id"), F.col("route_id").alias("trace_id"), geo.haversine("lat", "lon", 35.72, 51.35).alias("dist"))


@query("AG-10", sql("gps", TRACES + f"SELECT segment_id, trace_id, {k('round(sqrt(avg(dist * dist)), 6)')} AS rmse, count(*) AS n FROM t GROUP BY segment_id, trace_id"))
def rmse(spark, d):
    return aggregates.rmse(traces(spark, d), ["segment_id", "trace_id"], "dist").select("segment_id", "trace_id", thousandths(F.round("rmse", 6)).alias("rmse"), "n")


@query("AG-11", sql("gps", TRACES + "SELECT segment_id, count(DISTINCT trace_id) AS weight FROM t GROUP BY segment_id HAVING count(DISTINCT trace_id) >= 60"))
def support(spark, d):
    return aggregates.supported(traces(spark, d), "segment_id", "trace_id", 60)


@query("AG-12", sql("links", "SELECT source % 50 AS segment_id, min(weight) AS weight FROM links GROUP BY 1"))
def least_weight(spark, d):
    return links(spark, d).groupBy((F.col("source") % 50).alias("segment_id")).agg(F.min("weight").alias("weight"))


@query("AG-13", sql("nodes", f", r AS (SELECT col AS seg, \"row\" AS pos, weight, min(\"row\") OVER (PARTITION BY col) AS lo, max(\"row\") OVER (PARTITION BY col) AS hi FROM nodes)\nSELECT seg, {k('coalesce(avg(weight) FILTER (pos > lo AND pos < hi), avg(weight))')} AS mean FROM r GROUP BY seg"))
def interior(spark, d):
    own = nodes(spark, d).select(F.col("col").alias("seg"), F.col("row").alias("pos"), "weight")
    return aggregates.interior_mean(own, "seg", "pos", "weight").select("seg", thousandths(F.col("mean")).alias("mean"))


@query("AG-14", sql("points2d", f"SELECT grp, {k('round(avg(x), 6)')} AS x, {k('round(avg(y), 6)')} AS y FROM points2d GROUP BY grp"))
def centroids(spark, d):
    return points2d(spark, d).groupBy("grp").agg(thousandths(F.round(F.avg("x"), 6)).alias("x"), thousandths(F.round(F.avg("y"), 6)).alias("y"))


@query("AG-15", sql("gps", f", s AS (SELECT route_id, lat, lon, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM gps WINDOW w AS (PARTITION BY route_id ORDER BY us, event_id))\nSELECT route_id, CAST(round(coalesce(sum({hav('lat', 'lon', 'lat2', 'lon2')}), 0)) AS BIGINT) AS length, count(*) AS n FROM s GROUP BY route_id"))
def lengths(spark, d):
    w = trajectories.by_route()
    own = gps(spark, d).withColumn("step", F.when(F.lead("us").over(w).isNotNull(), geo.haversine(F.col("lat"), F.col("lon"), F.lead("lat").over(w), F.lead("lon").over(w))))
    return aggregates.line_lengths(own, "route_id", ["us"], F.col("step")).select("route_id", F.round("length").cast("long").alias("length"), "n")


@query("AG-16", sql("links", "SELECT node_id, count(DISTINCT n) AS degree FROM (SELECT source AS node_id, target AS n FROM links UNION ALL SELECT target, source FROM links) GROUP BY node_id"))
def degree(spark, d):
    return aggregates.degrees(links(spark, d))


@query("AG-17", sql("gps", TRACES + f"SELECT trace_id, {k('max(dist)')} AS distance FROM t GROUP BY trace_id"))
def farthest(spark, d):
    return traces(spark, d).groupBy("trace_id").agg(thousandths(F.max("dist")).alias("distance"))


LIMITS = trajectories.Limits(seconds=43_200, metres=3_000, speed=None, least_metres=5)
STEPS = ", l AS (SELECT *, lag(us) OVER w AS us0, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0 FROM gps WINDOW w AS (PARTITION BY route_id ORDER BY us, event_id)),\ns AS (SELECT *, (us - us0) / 1e6 AS dt, CASE WHEN us0 IS NOT NULL THEN {h} END AS dist FROM l)".format(h=hav("lat0", "lon0", "lat", "lon"))
SESSIONS = STEPS + ",\nf AS (SELECT * FROM s WHERE dist IS NULL OR dist > 5),\nb AS (SELECT *, sum(CASE WHEN dt IS NULL OR dt > 43200 OR dist > 3000 THEN 1 ELSE 0 END) OVER (PARTITION BY route_id ORDER BY us, event_id) AS session FROM f),\nt AS (SELECT *, count(*) OVER (PARTITION BY route_id, session) AS n_points FROM b QUALIFY n_points > 1)\n"


@query("AG-18", sql("gps", SESSIONS + "SELECT route_id, CAST(session AS BIGINT) AS session, count(*) AS n FROM t GROUP BY route_id, session"))
def session_sizes(spark, d):
    return trajectories.sessions(gps(spark, d), LIMITS).groupBy("route_id", "session").agg(F.count(F.lit(1)).alias("n"))


@query("AG-19", sql("links", f"SELECT edge_id, CAST(round(weight * 1000000000e0 / sum(weight) OVER (PARTITION BY source)) AS BIGINT) AS share FROM links"))
def normalised(spark, d):
    return links(spark, d).select("edge_id", F.round(F.col("weight") * 1e9 / F.sum("weight").over(W.partitionBy("source"))).cast("long").alias("share"))


@query("WN-01", sql("gps", STEPS + "\nSELECT event_id, us0, {a} AS lat0, {b} AS lon0 FROM s".format(a=u("lat0"), b=u("lon0"))))
def lagged(spark, d):
    w = trajectories.by_route()
    return gps(spark, d).select("event_id", F.lag("us").over(w).alias("us0"), micro(F.lag("lat").over(w)).alias("lat0"), micro(F.lag("lon").over(w)).alias("lon0"))


@query("WN-02", sql("gps", "SELECT event_id, kind IS DISTINCT FROM lead(kind) OVER (PARTITION BY route_id ORDER BY us, event_id) AS last FROM gps"))
def boundary(spark, d):
    return trajectories.boundaries(gps(spark, d), "kind", "route_id").select("event_id", "last")


RUNS = ", c AS (SELECT *, CASE WHEN kind IS DISTINCT FROM lag(kind) OVER w OR lag(us) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM gps WINDOW w AS (PARTITION BY route_id ORDER BY us, event_id)), r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY route_id ORDER BY us, event_id) AS BIGINT) AS run FROM c)\n"


@query("WN-03", sql("gps", RUNS + "SELECT event_id, run FROM r"))
def run_ids(spark, d):
    return trajectories.runs(gps(spark, d), ["kind"]).select("event_id", "run")


@query("WN-04", sql("gps", SESSIONS + "SELECT event_id, route_id, CAST(session AS BIGINT) AS session, n_points FROM t"))
def session_ids(spark, d):
    return trajectories.sessions(gps(spark, d), LIMITS).select("event_id", "route_id", "session", "n_points")


@query("WN-05", sql("gps", "SELECT event_id AS a, lead(event_id) OVER (PARTITION BY route_id ORDER BY us, event_id) AS b FROM gps QUALIFY b IS NOT NULL"))
def pairs(spark, d):
    return gps(spark, d).select(F.col("event_id").alias("a"), F.lead("event_id").over(trajectories.by_route()).alias("b")).where("b IS NOT NULL")


@query("WN-06", sql("gps", "SELECT route_id, bin, CAST(sum(count(*)) OVER (PARTITION BY route_id ORDER BY bin) AS BIGINT) AS cum FROM (SELECT route_id, CAST(floor(value / 50) AS BIGINT) AS bin FROM gps) GROUP BY route_id, bin"))
def cumulative(spark, d):
    own = gps(spark, d).groupBy("route_id", F.floor(F.col("value") / 50).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return own.select("route_id", "bin", F.sum("n").over(W.partitionBy("route_id").orderBy("bin")).alias("cum"))


@query("WN-07", sql("gps", RUNS + "SELECT route_id, run, min(us) AS first, max(us) AS last, count(*) AS n FROM r GROUP BY route_id, run"))
def traces_by_run(spark, d):
    return trajectories.runs(gps(spark, d), ["kind"]).groupBy("route_id", "run").agg(F.min("us").alias("first"), F.max("us").alias("last"), F.count(F.lit(1)).alias("n"))


@query("WN-08", sql("links", "SELECT edge_id, row_number() OVER (ORDER BY edge_id) AS pos FROM links"))
def positions(spark, d):
    return trajectories.numbered(links(spark, d).select("edge_id"), ["edge_id"], "pos")


@query("WN-09", sql("gps", f", n AS (SELECT event_id, route_id, us, lead(us) OVER w AS us1, lat, lon, lead(lat) OVER w AS lat1, lead(lon) OVER w AS lon1 FROM gps WINDOW w AS (PARTITION BY route_id ORDER BY us, event_id)), m AS (SELECT *, (us1 - us) / 1e6 AS dt, CASE WHEN us1 IS NOT NULL THEN {hav('lat', 'lon', 'lat1', 'lon1')} END AS dist FROM n)\nSELECT event_id, CAST(round(coalesce(dt, lag(dt) OVER w) * 1000) AS BIGINT) AS dt, {k('coalesce(dist, lag(dist) OVER w)')} AS dist FROM m WINDOW w AS (PARTITION BY route_id ORDER BY us, event_id)"))
def motion(spark, d):
    return trajectories.motion(gps(spark, d), "route_id").select("event_id", thousandths(F.col("dt")).alias("dt"), thousandths(F.col("dist")).alias("dist"))


@query("WN-10", sql("gps", STEPS + "\nSELECT event_id, CAST(sum(CASE WHEN dist >= 1000 OR dt >= 45 AND dist >= 1000 OR dt IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY route_id ORDER BY us, event_id) AS BIGINT) AS sub FROM s"))
def sub_trips(spark, d):
    own = trajectories.steps(gps(spark, d))
    jump = (F.col("dist") >= 1000) | ((F.col("dt") >= 45) & (F.col("dist") >= 1000)) | F.col("dt").isNull()
    return own.select("event_id", F.sum(F.when(jump, 1).otherwise(0).cast("long")).over(trajectories.by_route().rowsBetween(W.unboundedPreceding, 0)).alias("sub"))


@query("SO-01", sql("gps", "SELECT event_id, route_id, row_number() OVER (PARTITION BY route_id ORDER BY us, event_id) AS pos FROM gps"))
def ordered(spark, d):
    return gps(spark, d).select("event_id", "route_id", F.row_number().over(trajectories.by_route()).cast("long").alias("pos"))


@query("SO-02", "SELECT 'events.parquet' AS file, count(*) AS n FROM events")
def by_file(spark, d):
    own = table(spark, d, "events").groupBy(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file")).agg(F.count(F.lit(1)).alias("n"))
    return own.orderBy("file").select(F.when(F.col("file").startswith("part-"), "events.parquet").otherwise(F.col("file")).alias("file"), "n")


@query("SO-03", sql("crossings", "SELECT id, edge_id AS best FROM crossings QUALIFY row_number() OVER (PARTITION BY id ORDER BY ep DESC, n, edge_id) = 1"))
def best_state(spark, d):
    return crossings(spark, d).groupBy("id").agg(F.min_by("edge_id", F.struct(-F.col("ep"), "n", "edge_id")).alias("best"))


@query("SO-04", sql("edges", "SELECT source % 50 AS segment_id, min_by(edge_id, CAST(round(length * 1000000) AS BIGINT) * 1000000 + edge_id) AS shortest FROM edges GROUP BY 1"))
def shortest_first(spark, d):
    return edges(spark, d).groupBy((F.col("source") % 50).alias("segment_id")).agg(F.min_by("edge_id", F.round(F.col("length") * 1_000_000).cast("long") * 1_000_000 + F.col("edge_id")).alias("shortest"))


@query("SO-05", sql("points2d", f"SELECT grp, {k('max(x) - min(x)')} AS extent, row_number() OVER (ORDER BY max(x) - min(x) DESC, grp) AS place FROM points2d GROUP BY grp"))
def widest_first(spark, d):
    own = points2d(spark, d).groupBy("grp").agg((F.max("x") - F.min("x")).alias("e"))  # a row for each group
    return own.select("grp", thousandths(F.col("e")).alias("extent"), F.row_number().over(W.orderBy(F.desc("e"), "grp")).cast("long").alias("place"))


SWEPT = """, iv AS (SELECT route_id, event_id, us AS l, us + CAST(floor(value * 1e9) AS BIGINT) AS r FROM gps)
SELECT route_id, event_id, row_number() OVER (PARTITION BY route_id ORDER BY l, r, event_id) AS place,
  (SELECT count(*) FROM iv b WHERE b.route_id = a.route_id AND b.r >= a.l AND (b.l < a.l OR b.l = a.l AND (b.r < a.r OR b.r = a.r AND b.event_id < a.event_id))) AS open FROM iv a"""


@query("SO-06", sql("gps", SWEPT))
def sweep(spark, d):
    own = gps(spark, d).withColumn("until", F.col("us") + F.floor(F.col("value") * 1e9))
    return aggregates.interval_sweep(own, ["route_id"], "us", "until", "event_id")


@query("SE-01", sql("gps", "SELECT event_id, 1 AS part FROM gps WHERE value < 50 UNION ALL SELECT event_id, 2 FROM gps WHERE value > 40").replace("1 AS part", "CAST(1 AS BIGINT) AS part"))
def union_all(spark, d):
    g = gps(spark, d)
    return g.where("value < 50").select("event_id", F.lit(1).cast("long").alias("part")).unionByName(g.where("value > 40").select("event_id", F.lit(2).cast("long").alias("part")))


@query("SE-02", sql("links crossings", "SELECT 'except' AS how, count(*) AS n FROM (SELECT edge_id FROM links EXCEPT SELECT edge_id FROM crossings) UNION ALL SELECT 'intersect', count(*) FROM (SELECT edge_id FROM links INTERSECT SELECT edge_id FROM crossings) UNION ALL SELECT 'union', count(*) FROM (SELECT edge_id FROM links UNION SELECT edge_id FROM crossings)"))
def set_ops(spark, d):
    a, b = links(spark, d).select("edge_id"), crossings(spark, d).select("edge_id")
    parts = [x.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("how"), "n") for n, x in (("except", a.subtract(b)), ("intersect", a.intersect(b)), ("union", a.union(b).distinct()))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SE-03", sql("crossings", "SELECT DISTINCT edge_id, n FROM crossings"))
def distinct(spark, d):
    return crossings(spark, d).select("edge_id", "n").distinct()


@query("SE-04", sql("links", "SELECT edge_id, source, target FROM links QUALIFY row_number() OVER (PARTITION BY least(source, target), greatest(source, target) ORDER BY edge_id) = 1"))
def one_direction(spark, d):
    return sets.one_direction(links(spark, d)).select("edge_id", "source", "target")


@query("SE-05", sql("links", "SELECT edge_id FROM links WHERE highway = 'residential' ORDER BY (edge_id + 11) * 2654435761 % 4294967296, edge_id LIMIT (SELECT CAST(floor(count(*) * 0.1e0) AS BIGINT) FROM links)"))
def dropped(spark, d):
    """A tenth of all edges, drawn from the residential ones: the number is the feature."""
    own = links(spark, d)
    return sets.sample(own.where("highway = 'residential'"), "edge_id", int(own.count() * 0.1), 11).select("edge_id")


@query("SE-06", sql("nodes", "SELECT node_id, (node_id + 5) * 2654435761 % 4294967296 AS h FROM nodes ORDER BY h, node_id LIMIT 25"))
def random_nodes(spark, d):
    """25 random nodes: the number is the feature."""
    own = nodes(spark, d).select("node_id")
    return sets.sample(own, "node_id", 25, 5).select("node_id", sets.scattered("node_id", 5).alias("h"))


@query("SE-07", sql("gps", "SELECT event_id, ntile(4) OVER (PARTITION BY route_id ORDER BY us, event_id) - 1 AS chunk FROM gps"))
def chunks(spark, d):
    return sets.split_evenly(gps(spark, d), ["us", "event_id"], 4, "route_id").select("event_id", F.col("chunk").cast("long").alias("chunk"))

