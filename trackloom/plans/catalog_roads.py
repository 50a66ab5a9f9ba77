"""Rasters, graphs, clusters and files over the bound tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions import codec, geo
from trackloom.operators import cluster, common_map, graph, matching, raster, road_trees, sets, short_edges, trajectories, way_comparison
from trackloom.operators.raster import Grid
from trackloom.plans.catalog_basic import TRACES, segments
from trackloom.plans.catalog_scalar import BEARING
from trackloom.plans.catalog_trips import LONGEST, METRIC, MOTION, metric_edges, metric_trips, random_pairs
from trackloom.plans.registry import query
from trackloom.plans.relations import BOX, edges, gps, k, links, matches, micro, nodes, points2d, recursive, roots, sql, thousandths, u
from trackloom.session import shared_path
from trackloom.sources import database as database_io
from trackloom.sources import maps, png, points, shapefile

#: Pixels for the bound tables: about 30 m.
PIXELS = Grid(35.7185, 51.32, 3700.0, 3000.0, 74)
PIX = "px AS (SELECT route_id, event_id, us, 74 - CAST(floor((lat - 35.7185e0) * 3700e0) AS BIGINT) AS r, CAST(floor((lon - 51.32e0) * 3000e0) AS BIGINT) AS c FROM gps)"
STEP = PIX + ", st AS (SELECT route_id, r AS r1, c AS c1, lead(r) OVER w AS r2, lead(c) OVER w AS c2 FROM px WINDOW w AS (PARTITION BY route_id ORDER BY us, event_id) QUALIFY r2 IS NOT NULL)"
DRAWN = STEP + ", dr AS (SELECT DISTINCT route_id, r1 + CASE WHEN n = 0 THEN 0 ELSE CAST(floor((2 * i * (r2 - r1) + n) / (2e0 * n)) AS BIGINT) END AS \"row\", c1 + CASE WHEN n = 0 THEN 0 ELSE CAST(floor((2 * i * (c2 - c1) + n) / (2e0 * n)) AS BIGINT) END AS col FROM (SELECT *, unnest(range(n + 1)) AS i FROM (SELECT *, greatest(abs(r2 - r1), abs(c2 - c1)) AS n FROM st)))"
DENSE = DRAWN + ", de AS (SELECT \"row\", col, least(count(*) * 32, 65535) AS v FROM dr GROUP BY \"row\", col)"


def steps(spark, d):
    w = trajectories.by_route()
    own = gps(spark, d).select("route_id", "us", "event_id", PIXELS.row("lat").alias("r1"), PIXELS.col("lon").alias("c1"))
    return own.withColumns({"r2": F.lead("r1").over(w), "c2": F.lead("c1").over(w)}).where("r2 IS NOT NULL").select("route_id", "r1", "c1", "r2", "c2")


def dense(spark, d):
    return raster.density(raster.drawn(steps(spark, d), "route_id"))


def busy(spark, d):
    """Pixels of more than the usual density: above the value that half of the set pixels don't exceed. They have holes to thin around."""
    own = dense(spark, d)
    half = own.agg(F.percentile("v", 0.5).alias("half"))
    return own.crossJoin(F.broadcast(half)).where("v > half").select("row", "col", "v")  # one row


@query("RA-01", "SELECT CAST(trunc(" + "12742000e0 * atan2(sqrt(pow(cos(radians(35.7384e0)) * sin(radians(51.3822e0 - 51.32e0) / 2), 2)), sqrt(1 - pow(cos(radians(35.7384e0)) * sin(radians(51.3822e0 - 51.32e0) / 2), 2)))" + ") AS BIGINT) AS width, CAST(trunc(12742000e0 * radians(35.7384e0 - 35.7185e0) / 2) AS BIGINT) AS height")
def grid_size(spark, d):
    width, height = raster.grid_size(BOX, 1.0)
    return spark.createDataFrame([(width, height)], "width long, height long")


@query("RA-02", sql("gps", ", " + DRAWN + "\nSELECT route_id, \"row\", col FROM dr"))
def drawn(spark, d):
    return raster.drawn(steps(spark, d), "route_id")


@query("RA-03", sql("gps", ", " + DENSE + "\nSELECT \"row\", col, CAST(v AS BIGINT) AS v FROM de"))
def density(spark, d):
    return dense(spark, d)


@query("RA-04", sql("gps", ", " + DRAWN + "\nSELECT DISTINCT \"row\", col FROM dr"))
def any_trip(spark, d):
    return raster.drawn(steps(spark, d), "route_id").select("row", "col").distinct()


TAPS = ", ".join(f"({i - 8}, {w!r}::DOUBLE)" for i, w in enumerate(raster.kernel()))


@query("RA-05", sql("gps", ", " + DENSE + f", kn(o, w) AS (VALUES {TAPS}), b1 AS (SELECT \"row\" + o AS \"row\", col, sum(v * w) AS v FROM de, kn GROUP BY 1, 2), b2 AS (SELECT \"row\", col + o AS col, sum(v * w) AS v FROM b1, kn GROUP BY 1, 2)\nSELECT \"row\", col, CAST(round(v * 100) AS BIGINT) AS v FROM b2"))
def blur(spark, d):
    return raster.blurred(dense(spark, d)).select("row", "col", F.round(F.col("v") * 100).cast("long").alias("v"))


DISC1 = "(VALUES (0, 0), (-1, 0), (1, 0), (0, -1), (0, 1))"


@query("RA-06", sql("gps", ", " + DENSE + f", o(i, j) AS {DISC1}, di AS (SELECT \"row\" + i AS \"row\", col + j AS col, max(v) AS v FROM de, o GROUP BY 1, 2), er AS (SELECT \"row\" - i AS \"row\", col - j AS col, min(v) AS v, count(*) AS n FROM di, o GROUP BY 1, 2)\nSELECT \"row\", col, CAST(v AS BIGINT) AS v FROM er WHERE n = 5"))
def closing(spark, d):
    return raster.closed(dense(spark, d), 1).select("row", "col", "v")


@query("RA-07", sql("gps", ", " + DENSE + "\nSELECT \"row\" + 2 AS \"row\", col + 2 AS col, CAST(v AS BIGINT) AS v FROM de"))
def padded(spark, d):
    """Padding is a shift of a sparse raster."""
    return dense(spark, d).select((F.col("row") + 2).alias("row"), (F.col("col") + 2).alias("col"), "v")


@query("RA-08")
def ladder(spark, d):
    """The whole ladder on the density of all trips."""
    return raster.skeleton(dense(spark, d))


@query("RA-09")
def thinning(spark, d):
    """Held against an untiled pixel loop in the tests."""
    return raster.thinned(busy(spark, d), 64, 16)


@query("RA-10", sql("gps", ", " + DENSE + ", nb AS (SELECT a.\"row\", a.col, count(*) AS n FROM de a JOIN de b ON abs(a.\"row\" - b.\"row\") <= 1 AND abs(a.col - b.col) <= 1 AND (a.\"row\" <> b.\"row\" OR a.col <> b.col) GROUP BY 1, 2)\nSELECT \"row\", col FROM de WHERE NOT EXISTS (SELECT 1 FROM nb WHERE nb.\"row\" = de.\"row\" AND nb.col = de.col AND n > 6)"))
def pools(spark, d):
    return raster.without_pools(dense(spark, d)).select("row", "col")


@query("RA-11", sql("gps", ", " + DENSE + "\nSELECT a.\"row\", a.col, count(b.v) AS n FROM de a LEFT JOIN de b ON b.\"row\" BETWEEN a.\"row\" - 1 AND a.\"row\" + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 AND (a.\"row\" <> b.\"row\" OR a.col <> b.col) GROUP BY 1, 2"))
def neighbours(spark, d):
    return raster.neighbour_counts(dense(spark, d))


@query("RA-12")
def crossings(spark, d):
    return raster.crossings(thinning(spark, d))


@query("RA-13", recursive(sql("nodes", ", n AS (SELECT \"row\", col, \"row\" * 2147483648 + col AS id FROM nodes WHERE weight > 30), pr AS (SELECT x.id AS a, y.id AS b FROM n x JOIN n y ON y.\"row\" BETWEEN x.\"row\" AND x.\"row\" + 1 AND y.col BETWEEN x.col - 1 AND x.col + 1 AND y.id > x.id), " + roots("pr", 250) + f"\nSELECT blob, {k('avg(\"row\")')} AS \"row\", {k('avg(col)')} AS col, count(*) AS n FROM (SELECT n.*, coalesce(root, id) AS blob FROM n LEFT JOIN roots ON node = id) GROUP BY blob")))
def blobs(spark, d):
    own = nodes(spark, d).where("weight > 30").select("row", "col")
    return raster.centres(raster.blobs(own)).select("blob", thousandths(F.col("row")).alias("row"), thousandths(F.col("col")).alias("col"), "n")


@query("RA-14")
def traced(spark, d):
    got = raster.traced(crossings(spark, d))
    return got.select("path", F.size("ends").cast("long").alias("ends"), F.size("pixels").cast("long").alias("pixels"))


@query("RA-15")
def vectorised(spark, d):
    _, segs = raster.vectorised(crossings(spark, d), tolerance=2.0)
    return segs.select("segment", "source", "target", F.size("points").cast("long").alias("n"))


@query("RA-16")
def buffered_skeleton(spark, d):
    """Thick lines, closed with two discs, thinned."""
    thick = raster.dilated(busy(spark, d), 2)
    return raster.thinned(raster.closed(raster.closed(thick, 2), 4), 64, 16)


@query("RA-17")
def chained(spark, d):
    kinds = crossings(spark, d)
    many = raster.neighbour_counts(kinds).where("n > 2").select("row", "col")
    split = kinds.select("row", "col").join(many.withColumn("j", F.lit(True)), ["row", "col"], "left").select("row", "col", F.when(F.col("j"), "crossing").otherwise("path").alias("kind"))
    got = raster.traced(split)
    return got.select("path", F.size("ends").cast("long").alias("ends"), F.size("pixels").cast("long").alias("pixels"))


@query("RA-18")
def skeleton_lines(spark, d):
    own = raster.blobs(thinning(spark, d)).withColumn("id", F.col("row") * 100_000 + F.col("col")).select("blob", "id", F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"))
    return cluster.fitted(own, "blob").select("blob", "n", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query("GR-01", sql("nodes links", "SELECT node_id FROM nodes WHERE node_id IN (SELECT source FROM links) OR node_id IN (SELECT target FROM links)"))
def without_isolated(spark, d):
    return graph.without_isolated(nodes(spark, d), links(spark, d)).select("node_id")


@query("GR-02", recursive(sql("nodes links", ", nb AS (SELECT source AS n, target AS o FROM links UNION SELECT target, source FROM links), bu AS (SELECT node_id, lon * 83044.98918812413e0 AS x, lat * 111070.34306591158e0 AS y FROM nodes WHERE node_id IN (SELECT n FROM nb GROUP BY n HAVING count(*) > 2)), pr AS (SELECT p.node_id AS a, q.node_id AS b FROM bu p JOIN bu q ON q.x BETWEEN p.x - 50 AND p.x + 50 AND q.y BETWEEN p.y - 50 AND p.y + 50 AND p.node_id < q.node_id WHERE sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) <= 50), " + roots("pr", 60) + f"\nSELECT intersection, {k('avg(x)')} AS x, {k('avg(y)')} AS y, count(*) AS n FROM (SELECT bu.*, coalesce(root, node_id) AS intersection FROM bu LEFT JOIN roots ON node = node_id) GROUP BY intersection")))
def intersections(spark, d):
    own = nodes(spark, d).select("node_id", (F.col("lon") * 83044.98918812413).alias("x"), (F.col("lat") * 111070.34306591158).alias("y"))
    return graph.intersections(own, links(spark, d), 50.0).select("intersection", thousandths(F.col("x")).alias("x"), thousandths(F.col("y")).alias("y"), "n")


@query("GR-03", sql("gps", TRACES.rstrip() + ", r AS (SELECT segment_id, trace_id FROM t GROUP BY ALL HAVING sqrt(avg(dist * dist)) <= 3000)\nSELECT segment_id, count(DISTINCT trace_id) AS weight FROM r GROUP BY segment_id HAVING count(DISTINCT trace_id) >= 2"))
def pruned(spark, d):
    from trackloom.plans.catalog_basic import traces

    return graph.pruned(traces(spark, d), 3000.0, 2)


CHAINS = recursive(sql("links", ", ow AS (SELECT DISTINCT least(source, target) AS s, greatest(source, target) AS t FROM links WHERE source < target), oe AS (SELECT s * 2147483648 + t AS e, s, t FROM ow), en AS (SELECT e, s AS n FROM oe UNION ALL SELECT e, t FROM oe), dg AS (SELECT n, count(*) AS deg FROM en GROUP BY n), pr AS (SELECT min(e) AS a, max(e) AS b FROM en WHERE n IN (SELECT n FROM dg WHERE deg = 2) GROUP BY n HAVING min(e) < max(e)), " + roots("pr", 60) + ", nm AS (SELECT oe.*, coalesce(root, e) AS chain FROM oe LEFT JOIN roots ON node = e), tp AS (SELECT chain, unnest([s, t]) AS n FROM nm), ed AS (SELECT chain, min(n) AS source, max(n) AS target FROM tp WHERE n IN (SELECT n FROM dg WHERE deg <> 2) GROUP BY chain)\n"))


@query("GR-04", CHAINS + "SELECT chain, count(*) AS edges, any_value(source) AS source, any_value(target) AS target FROM nm LEFT JOIN ed USING (chain) GROUP BY chain")
def coalesced(spark, d):
    return graph.chains(links(spark, d).where("source < target")).withColumn("chain", F.col("chain.s") * (1 << 31) + F.col("chain.t"))


@query("GR-05")
def refined(spark, d):
    """The whole map with links up to 96 m collapsed where the positions snapped to the links around allow it: a trace is what a route leaves on a link."""
    e = metric_edges(spark, d).where("source < target")
    azimuth = trajectories.motion(gps(spark, d), "route_id").select(F.col("event_id").alias("point_id"), "azimuth")
    own = metric_trips(spark, d)
    seen = matching.snapped(own.join(azimuth, "point_id"), e).join(own, "point_id").select("edge_id", F.col("trip").alias("trace"), "x", "y")
    nodes_ = way_comparison.nodes_of(e)
    got, _ = short_edges.collapse(nodes_, e.select("edge_id", F.col("source").alias("a"), F.col("target").alias("b")), seen, 96.0, 40.0)
    return got.select("edge_id", "a", "b", *[F.round(c, 2).alias(c) for c in ("ax", "ay", "bx", "by")])


@query("GR-06")
def dijkstra(spark, d):
    """Shortest paths, whatever their course, of random pairs. Held against Dijkstra on the whole graph in the tests."""
    e = metric_edges(spark, d)
    got = graph.paths_within(random_pairs(e), e, LONGEST)
    return got.select("a", "b", thousandths(F.col("dist")).alias("dist"), F.size("nodes").cast("long").alias("nodes"))


WAYS = "".join(f", w{n} AS (SELECT p.a, q.b, min(p.dist + q.dist) AS dist FROM w{n - 1} p JOIN w1 q ON p.b = q.a GROUP BY ALL HAVING min(p.dist + q.dist) <= 500)" for n in range(2, 7))


@query("GR-07", sql("edges", ", w1 AS (SELECT source AS a, target AS b, min(length) AS dist FROM edges GROUP BY ALL), w0 AS (SELECT DISTINCT source AS a, source AS b, 0e0 AS dist FROM edges)" + WAYS + f"\nSELECT a AS source_id, b AS node, {k('min(dist)')} AS dist FROM (" + " UNION ALL ".join(f"SELECT * FROM w{n}" for n in range(7)) + ") WHERE dist <= 500 GROUP BY a, b"))
def bounded(spark, d):
    """All ways of up to 500 m; links are 89 m or more, so five or fewer each."""
    e = edges(spark, d)
    starts = e.select(F.col("source").alias("node_id")).distinct()
    return graph.shortest_within(e, starts, 500.0).select("source_id", "node", thousandths(F.col("dist")).alias("dist"))


@query("GR-08", CHAINS + "SELECT source, target, count(*) AS edges FROM (SELECT nm.chain, ed.source, ed.target FROM nm LEFT JOIN ed USING (chain)) GROUP BY chain, source, target")
def contracted(spark, d):
    return graph.chains(links(spark, d).where("source < target")).select("source", "target", "edges")


WALKS = ", k1 AS (SELECT [source, target] AS n FROM links WHERE source <> target)" + "".join(f", k{i} AS (SELECT list_append(n, target) AS n FROM k{i - 1} JOIN links ON source = n[-1] WHERE NOT list_contains(n, target))" for i in range(2, 5))


@query("GR-09", sql("links", WALKS + "\n" + " UNION ALL ".join(f"SELECT array_to_string(n, '-') AS path FROM k{i}" for i in range(1, 5))))
def walks(spark, d):
    """Paths of one to four links; the operator takes any number."""
    from functools import reduce

    return reduce(lambda a, b: a.unionByName(b), [graph.walks(links(spark, d), n) for n in range(1, 5)]).select(F.concat_ws("-", F.transform("nodes", lambda x: x.cast("string"))).alias("path"))


@query("GR-10", sql("edges", f"SELECT DISTINCT least(source, target) AS a, greatest(source, target) AS b, {k('length')} AS length FROM edges"))
def line_paths(spark, d):
    return edges(spark, d).select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), thousandths(F.col("length")).alias("length")).distinct()


INCIDENT = f", b AS (SELECT source, target, length, {BEARING} AS bearing FROM edges), t AS (SELECT *, bearing - lag(bearing) OVER (PARTITION BY source ORDER BY bearing, target) AS turn FROM b)\n"
ANGLE = "CASE WHEN count(*) > 1 THEN least(coalesce(min(turn), 360e0), min(bearing) + 360 - max(bearing)) END"


@query("GR-11", sql("edges", INCIDENT + f"SELECT source AS node_id, {k('min(length)')} AS nearest, {k(ANGLE)} AS angle, count(*) AS edges FROM t GROUP BY source"))
def incident(spark, d):
    own = edges(spark, d).withColumn("bearing", geo.bearing("lat1", "lon1", "lat2", "lon2"))
    got = graph.nearest_incident(own)
    return got.select("node_id", thousandths(F.col("nearest")).alias("nearest"), thousandths(F.col("angle")).alias("angle"), "edges")


@query("GR-12", recursive(sql("crossings", ", fi AS (SELECT edge_id, min(id) AS a FROM crossings GROUP BY edge_id), pr AS (SELECT DISTINCT a, id AS b FROM crossings JOIN fi USING (edge_id) WHERE a <> id), " + roots("pr", 25) + "\nSELECT stick, coalesce(root, stick) AS \"group\" FROM (SELECT DISTINCT id AS stick FROM crossings) LEFT JOIN roots ON node = stick")))
def sticks(spark, d):
    own = matches(spark, d).select(F.col("id").alias("stick"), F.explode("opath").alias("edge"))
    return graph.shared_edge_groups(own, "stick", "edge")


@query("GR-13", sql("points2d", ", s AS (SELECT a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y FROM points2d a JOIN points2d b ON b.id = a.id + 1 WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) < 10), p AS (SELECT ax AS x, ay AS y FROM s UNION SELECT bx, b_y FROM s)\n" + f"SELECT {u('x')} AS x, {u('y')} AS y, row_number() OVER (ORDER BY p.x, p.y) AS node FROM p"))
def node_numbers(spark, d):
    got = graph.node_numbers(segments(spark, d), ("ax", "ay", "bx", "by"))
    return got.select(micro(F.col("x")).alias("x"), micro(F.col("y")).alias("y"), "node")


@query("GR-14")
def walk_points(spark, d):
    e = metric_edges(spark, d)
    starts = sets.sample(e.select(F.col("source").alias("node_id")).distinct(), "node_id", 20, 7)
    own = e.select("source", "target", "length", F.col("ax").alias("x1"), F.col("ay").alias("y1"), F.col("bx").alias("x2"), F.col("by").alias("y2"))
    return graph.walk_points(own, starts, 1000.0, 100.0).select("start", "n", thousandths(F.col("x")).alias("x"), thousandths(F.col("y")).alias("y"))


@query("GR-15")
def incremental_map(spark, d):
    """One map of all trips, laid one after another."""
    got = common_map.edges(*common_map.laid(metric_trips(spark, d), 150.0))
    return got.select("trip", "seq", *[F.round(c, 2).alias(c) for c in ("ax", "ay", "bx", "by")])


@query("GR-16")
def edge_splits(spark, d):
    """Laid segments that later trips met, with the number of edges that this cut them into."""
    got = common_map.edges(*common_map.laid(metric_trips(spark, d), 300.0))
    return got.groupBy("trip", "seq").agg(F.count(F.lit(1)).alias("edges")).where("edges > 1")


def bearing_points(spark, d):
    own = gps(spark, d).select(F.col("event_id").alias("id"), (F.col("lon") * 83044.98918812413).alias("x"), (F.col("lat") * 111070.34306591158).alias("y"), (F.col("value") % 360).alias("bearing"))
    return own.withColumn("tile", F.floor(F.col("x") / 700) * 100_000 + F.floor(F.col("y") / 400)).select("tile", "id", "x", "y", "bearing")


@query("CL-01")
def thinned_points(spark, d):
    """Held against the sequential choice over all points in the tests."""
    return cluster.thinned(bearing_points(spark, d), 60.0, 40.0).select("id")


@query("CL-02", sql("gps", ", p AS (SELECT event_id AS id, lon * 83044.98918812413e0 AS x, lat * 111070.34306591158e0 AS y, value % 360 AS b FROM gps), t AS (SELECT *, CAST(floor(x / 700) * 100000 + floor(y / 400) AS BIGINT) AS tile, CAST(floor(x / 10) AS BIGINT) AS cx FROM p)\nSELECT a.tile, a.id AS a, c.id AS b FROM t a JOIN t c ON a.cx BETWEEN c.cx - 1 AND c.cx + 1 AND a.id < c.id WHERE sqrt((a.x - c.x) * (a.x - c.x) + (a.y - c.y) * (a.y - c.y)) < 10 AND abs(a.b - c.b) < 20"))
def adjacency(spark, d):
    return cluster.adjacent(bearing_points(spark, d), 10.0, 20.0)


@query("CL-03")
def road_tree(spark, d):
    """The tree of all points; tests hold its rounds against the plain rule over the same order of seeds."""
    own = cluster.thinned(bearing_points(spark, d), 60.0, 40.0)
    got, _ = road_trees.contracted(own, cluster.adjacent(own, 150.0, 60.0), 150.0, 6)
    return got.select("a", "b", *[F.round(c, 2).alias(c) for c in ("ax", "ay", "bx", "by")])


def turns(spark, d):
    own = trajectories.motion(gps(spark, d), "route_id")
    return cluster.turns(own)


TURNS = MOTION + ", tl AS (SELECT *, lag(azimuth) OVER w AS hin, lag(kmh) OVER w AS v0, azimuth AS hout FROM mo WINDOW w AS (PARTITION BY route_id ORDER BY us, event_id)), tn AS (SELECT * FROM tl WHERE (abs(hout - hin) BETWEEN 12.5e0 AND 167.5e0 OR abs(hout - hin) BETWEEN 192.5e0 AND 347.5e0) AND (kmh <= v0 OR kmh BETWEEN 1 AND 40))"


@query("CL-04", sql("gps", TURNS + "\nSELECT event_id, CAST(hin AS BIGINT) AS heading_in, CAST(hout AS BIGINT) AS heading_out FROM tn"))
def turn_points(spark, d):
    return turns(spark, d).select("event_id", F.col("heading_in").cast("long").alias("heading_in"), F.col("heading_out").cast("long").alias("heading_out"))


@query("CL-05", sql("edges", f", {METRIC}, l AS (SELECT *, sqrt((ax - bx) * (ax - bx) + (ay - b_y) * (ay - b_y)) AS far FROM m)\nSELECT edge_id, CASE WHEN far <= 10 THEN 2 ELSE CAST(pow(2, ceil(round(log2(far / 10), 9))) AS BIGINT) + 1 END AS n FROM l"))
def halved_links(spark, d):
    return cluster.subdivided(metric_edges(spark, d), "edge_id", 10.0).groupBy("edge_id").agg(F.count(F.lit(1)).alias("n"))


@query("CL-06", sql("gps", TURNS + ", ty AS (SELECT *, (hout - hin + 540) % 360 - 180 AS angle FROM tn)\nSELECT event_id, CASE WHEN abs(angle) >= 150 THEN 'u-turn' WHEN abs(angle) >= 60 THEN CASE WHEN angle > 0 THEN 'right' ELSE 'left' END WHEN angle > 0 THEN 'slight right' ELSE 'slight left' END AS kind, round(abs(angle) / 180 / (1 + coalesce(kmh, 0) / 40), 6) AS weight FROM ty"))
def turn_types(spark, d):
    return cluster.turn_types(turns(spark, d)).select("event_id", "kind", F.round("weight", 6).alias("weight"))


@query("CL-07")
def turn_clusters(spark, d):
    """Held against the sequential choice over all turns in the tests."""
    own = turns(spark, d).select(F.col("event_id").alias("id"), (F.col("lon") * 83044.98918812413).alias("x"), (F.col("lat") * 111070.34306591158).alias("y"), "heading_in", "heading_out", (20 + F.col("value") % 60).alias("extent"))
    return cluster.intersections(own).select("cluster", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), "n", "crossings")


NEAR60 = ", p AS (SELECT event_id AS id, lon * 83044.98918812413e0 AS x, lat * 111070.34306591158e0 AS y, value % 360 AS bearing FROM gps), nr AS (SELECT p.id AS a, q.id AS b FROM p JOIN p q ON q.x BETWEEN p.x - 30 AND p.x + 30 AND q.y BETWEEN p.y - 30 AND p.y + 30 WHERE sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) <= 30 AND least(abs(p.bearing - q.bearing) % 360, 360 - abs(p.bearing - q.bearing) % 360) <= 20), co AS (SELECT a AS id FROM nr GROUP BY a HAVING count(*) >= 3), pr AS (SELECT a, b FROM nr WHERE a < b AND a IN (SELECT id FROM co) AND b IN (SELECT id FROM co)), "


@query("CL-08", recursive(sql("gps", NEAR60 + roots("pr", 120) + ", nu AS (SELECT id, coalesce(root, id) AS cluster FROM co LEFT JOIN roots ON node = id), fo AS (SELECT b AS id, min(cluster) AS cluster FROM nr JOIN nu ON nu.id = nr.a GROUP BY b)\nSELECT p.id, coalesce(cluster, -1) AS cluster FROM p LEFT JOIN fo USING (id)")))
def density_clusters(spark, d):
    return cluster.density_clusters(bearing_points(spark, d), 30.0, 20.0, 3)


@query("CV-01")
def piecewise_fit(spark, d):
    return cluster.fitted(points2d(spark, d), "grp").select("grp", "n", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


# files: each query writes its relation, reads it again and returns what it read


def recorded(spark, d):
    """The positions as recorded rows with places in hexadecimal binary, little end first."""
    def part(c):
        # the 64 bits of a double by arithmetic: exponent, then 52 bits of fraction
        e = F.floor(F.log2(c))
        m = (c / F.pow(F.lit(2.0), e) - 1) * float(2**52)
        high = (e + 1023) * 2**20 + F.floor(m / float(2**32))
        low = m - F.floor(m / float(2**32)) * float(2**32)
        text = F.concat(F.lpad(F.hex(high.cast("long")), 8, "0"), F.lpad(F.hex(low.cast("long")), 8, "0"))
        return F.concat(*[F.substring(text, n, 2) for n in range(15, 0, -2)])

    g = gps(spark, d)
    return g.select(F.col("event_id").cast("string").alias("device_id"), F.col("route_id").cast("string").alias("route_slug"), F.concat(F.lit("0101000000"), part(F.col("lon")), part(F.col("lat"))).alias("location"), F.lit(0.0).alias("altitude"), F.floor(F.col("us") / 1000).cast("long").alias("timestamp"), F.lit(0.0).alias("bearing"), F.col("value").alias("speed"))


@query("IO-01", sql("gps", f"SELECT event_id, {u('lon')} AS lon, {u('lat')} AS lat FROM gps WHERE us // 1000 BETWEEN 1704844800000 AND 1705708800000 AND lat BETWEEN 35.7185e0 AND 35.7384e0 AND lon BETWEEN 51.32e0 AND 51.3822e0"))
def scan(spark, d):
    recorded(spark, d).write.parquet(path := shared_path(spark, "positions"))
    got = points.read_positions(spark, path, BOX, 1704844800000, 1705708800000)
    return got.select(F.col("device_id").cast("long").alias("event_id"), micro(F.col("lon")).alias("lon"), micro(F.col("lat")).alias("lat"))


@query("IO-02", sql("gps", "SELECT event_id, lon AS x, lat AS y FROM gps"))
def wkb(spark, d):
    own = recorded(spark, d).withColumn("p", codec.wkb_point(F.col("location")))
    return own.select(F.col("device_id").cast("long").alias("event_id"), "p.x", "p.y")


@query("IO-03", "SELECT 35.7185e0 AS south, 51.32e0 AS west, 35.7384e0 AS north, 51.3822e0 AS east")
def box_file(spark, d):
    points.write_box(spark, BOX, path := shared_path(spark, "box"))
    return points.read_box(spark, path)


TRAJ = "route_id long, event_id long, us long, lon double, lat double"


@query("IO-04", sql("gps", "SELECT route_id, count(*) AS n, CAST(1 AS BIGINT) AS files FROM gps GROUP BY route_id"))
def trajectory_sink(spark, d):
    points.write_trajectories(gps(spark, d).select("route_id", "event_id", "us", "lon", "lat"), path := shared_path(spark, "trajectories"), 2000)
    got = points.read_trajectories(spark, path, TRAJ)
    return got.groupBy("route_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file").alias("files"))


@query("IO-05", sql("gps", "SELECT route_id, event_id, us, lon, lat FROM gps"))
def trajectory_source(spark, d):
    points.write_trajectories(gps(spark, d).select("route_id", "event_id", "us", "lon", "lat"), path := shared_path(spark, "trajectories"), 5000)
    return points.read_trajectories(spark, path, TRAJ).drop("file")


def polyline_rows(spark, d):
    own = gps(spark, d).select("route_id", "us", "event_id", F.col("lon").alias("x"), F.col("lat").alias("y"))
    return trajectories.polylines(own, "route_id", ["x", "y"])


@query("IO-06", sql("gps", f"SELECT n, {u('x')} AS x, {u('y')} AS y FROM (SELECT count(*) AS n, first(lon ORDER BY us, event_id) AS x, last(lat ORDER BY us, event_id) AS y FROM gps GROUP BY route_id)"))
def shape_sink(spark, d):
    shapefile.write(polyline_rows(spark, d), path := shared_path(spark, "shapes"), "route_id")
    got = shapefile.read(spark, path)
    return got.select(F.size("points").cast("long").alias("n"), micro(F.element_at("points", 1)["x"]).alias("x"), micro(F.element_at("points", -1)["y"]).alias("y"))


@query("IO-07", sql("gps", "SELECT count(DISTINCT route_id) AS records, count(*) AS points FROM gps"))
def shape_source(spark, d):
    shapefile.write(polyline_rows(spark, d).repartition(3), path := shared_path(spark, "shapes"), "route_id")
    return shapefile.read(spark, path).agg(F.count(F.lit(1)).alias("records"), F.sum(F.size("points")).alias("points"))


@query("IO-08", sql("nodes links", "SELECT 'nodes' AS name, count(*) AS n FROM nodes UNION ALL SELECT 'edges', count(*) FROM links UNION ALL SELECT 'segments', count(DISTINCT source) FROM links UNION ALL SELECT 'intersections', count(*) FROM (SELECT source FROM links GROUP BY source HAVING count(*) > 2)"))
def graph_tables(spark, d):
    n = nodes(spark, d).select(F.col("node_id").alias("id"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), "weight")
    e = links(spark, d).select(F.col("edge_id").alias("id"), F.col("source").alias("in_node"), F.col("target").alias("out_node"), "weight")
    s = e.groupBy(F.col("in_node").alias("id")).agg(F.sort_array(F.collect_list("id")).alias("edge_ids"))
    i = e.groupBy(F.col("in_node").alias("node_id")).count().where("count > 2").select("node_id")
    maps.write_graph(path := shared_path(spark, "graph"), n, e, s, i)
    got = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, t in maps.read_graph(spark, path).items()]
    return got[0].unionByName(got[1]).unionByName(got[2]).unionByName(got[3])


@query("IO-09", sql("crossings", "SELECT id, count(*) AS n, CAST(sum(edge_id) AS BIGINT) AS total FROM crossings GROUP BY id"))
def match_files(spark, d):
    maps.write_matches(matches(spark, d), path := shared_path(spark, "matches"))
    got = maps.read_matches(spark, path)
    return got.select("id", F.size("opath").cast("long").alias("n"), F.aggregate("opath", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query("IO-10", sql("gps", "SELECT route_id, count(*) AS n, count(*) FILTER (value > 100) AS unknown FROM gps GROUP BY route_id"))
def ragged_files(spark, d):
    g = gps(spark, d)
    side = lambda c: F.when(F.col("value") <= 100, F.col(c))
    maps.write_ragged(g.select("route_id", "lat", "lon", F.col("us").alias("time"), side("lat").alias("in_lat"), side("lon").alias("in_lon"), side("lat").alias("out_lat"), side("lon").alias("out_lon")), path := shared_path(spark, "ragged"))
    return maps.read_ragged(spark, path).groupBy("route_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("in_lat").isNull()).alias("unknown"))


@query("IO-11", sql("gps", "SELECT count(*) AS n, CAST(sum(event_id) AS BIGINT) AS total FROM gps GROUP BY route_id"))
def trace_files(spark, d):
    own = gps(spark, d).select(F.col("route_id").alias("trace_id"), F.col("us").alias("seq"), F.col("route_id").alias("segment_id"), F.col("event_id").alias("edge_id"), "lat", "lon", F.col("us").alias("time"))
    maps.write_traces(own, path := shared_path(spark, "traces"))
    return maps.read_traces(spark, path).groupBy("trace").agg(F.count(F.lit(1)).alias("n"), F.sum("edge_id").alias("total")).select("n", "total")


@query("IO-12", sql("gps", ", " + DENSE + "\nSELECT \"row\", col, CAST(v AS BIGINT) AS v FROM de WHERE \"row\" BETWEEN 0 AND 199 AND col BETWEEN 0 AND 299"))
def image_files(spark, d):
    png.write(dense(spark, d), (path := shared_path(spark, "images")) + "/tile.png", 200, 300)
    return png.read(spark, path).select("row", "col", "v")


@query("IO-13", sql("edges", "SELECT edge_id FROM edges WHERE lat1 BETWEEN 35.7185e0 AND 35.7384e0 AND lat2 BETWEEN 35.7185e0 AND 35.7384e0 AND lon1 BETWEEN 51.32e0 AND 51.3822e0 AND lon2 BETWEEN 51.32e0 AND 51.3822e0"))
def streets(spark, d):
    return maps.streets_in_box(edges(spark, d), BOX).select("edge_id")


@query("IO-14", sql("gps", "SELECT route_id, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS total FROM gps GROUP BY route_id"))
def database(spark, d):
    """Positions appended in two goes, made unique by a key, and read again.

    The database is the one that spark.trackloom.jdbc.url names; without it, an
    embedded one in the memory of this JVM, which serves a local master only.
    """
    import uuid

    named = spark.sparkContext.getConf().get("spark.trackloom.jdbc.url")
    if named is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.trackloom.jdbc.url to a database that all executors reach")
    url, name = named or "jdbc:derby:memory:trackloom;create=true", "gps_" + uuid.uuid4().hex
    own = gps(spark, d).select("route_id", "event_id", "lat", "lon")
    early = F.col("event_id") % 2 == 0
    database_io.append(own.where(early), url, name)
    database_io.append(own.where(~early), url, name)
    database_io.add_primary_key(spark, url, name)
    return database_io.read(spark, url, name, 4).groupBy("route_id").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("total"))


@query("IO-15", sql("edges", f"SELECT {u('lat1')} AS lat1, {u('lon1')} AS lon1, {u('lat2')} AS lat2, {u('lon2')} AS lon2 FROM edges"))
def edge_text(spark, d):
    maps.write_edge_text(edges(spark, d), path := shared_path(spark, "edge-text"))
    return maps.read_edge_text(spark, path).select(*[micro(F.col(c)).alias(c) for c in ("lat1", "lon1", "lat2", "lon2")])


@query("IO-16", sql("gps", "SELECT count(*) AS n FROM gps"))
def tolerant_scan(spark, d):
    path = shared_path(spark, "some-bad")
    recorded(spark, d).write.parquet(path)
    spark.createDataFrame([("not a table",)], "value string").coalesce(1).write.mode("append").text(path + "/")
    return points.read_positions(spark, path, skip_corrupt=True).agg(F.count(F.lit(1)).alias("n"))


@query("IO-17", sql("nodes links", "SELECT 'vertices' AS name, (SELECT count(*) FROM nodes WHERE node_id IN (SELECT source FROM links UNION SELECT target FROM links)) AS n UNION ALL SELECT 'edges', (SELECT count(*) FROM links)"))
def graph_text(spark, d):
    v = nodes(spark, d).select(F.col("node_id").alias("id"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    maps.write_graph_text(v, links(spark, d).withColumnRenamed("edge_id", "id"), path := shared_path(spark, "graph-text"))
    a, b = maps.read_graph_text(spark, path)
    return a.agg(F.count(F.lit(1)).alias("n")).select(F.lit("vertices").alias("name"), "n").unionByName(b.agg(F.count(F.lit(1)).alias("n")).select(F.lit("edges").alias("name"), "n"))


@query("IO-18", sql("gps", "SELECT route_id AS id, count(*) AS n, CAST(sum(us // 1000000) AS BIGINT) AS seconds FROM gps GROUP BY route_id"))
def metric_trip_files(spark, d):
    own = gps(spark, d).select(F.col("route_id").alias("id"), F.col("lon").alias("x"), F.col("lat").alias("y"), F.lit(0.0).alias("altitude"), (F.floor(F.col("us") / 1_000_000) * 1000).cast("double").alias("time_ms"))
    own.write.option("header", True).csv(path := shared_path(spark, "metric-trips"))
    got = points.read_metric_trips(spark, path)
    return got.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("time").cast("long")).alias("seconds"))


@query("IO-19", sql("nodes", "SELECT count(*) AS n FROM nodes"))
def snapshot(spark, d):
    nodes(spark, d).write.parquet(path := shared_path(spark, "snapshot"))
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"))


@query("IO-20", sql("gps", f"SELECT route_id, {k('max(value)')} AS worst FROM gps GROUP BY route_id"))
def metric_sink(spark, d):
    gps(spark, d).groupBy("route_id").agg(thousandths(F.max("value")).alias("worst")).write.option("header", True).csv(path := shared_path(spark, "metrics"))
    return spark.read.schema("route_id long, worst long").option("header", True).csv(path)


@query("IO-21", sql("edges", f"SELECT edge_id, {u('lat1')} AS lat1, {u('lon1')} AS lon1, highway AS colour FROM edges"))
def plotted(spark, d):
    """The relation that a figure shows."""
    return edges(spark, d).select("edge_id", micro(F.col("lat1")).alias("lat1"), micro(F.col("lon1")).alias("lon1"), F.col("highway").alias("colour"))


@query("IO-22", sql("gps", "SELECT route_id, count(*) AS n, CAST(1 AS BIGINT) AS parts FROM gps WHERE lat BETWEEN 35.7185e0 AND 35.7384e0 AND lon BETWEEN 51.32e0 AND 51.3822e0 GROUP BY route_id"))
def range_parts(spark, d):
    from trackloom.operators.filters import inside

    own = gps(spark, d).where(inside("lat", "lon", BOX))
    dealt = sets.chunked(own, ["route_id"], 8)
    return dealt.groupBy("route_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("chunk").alias("parts"))

