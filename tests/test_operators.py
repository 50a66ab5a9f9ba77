"""Operators on small frames against plain versions; plans; streaming."""

import math
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from trackloom.kernels import matching as kernels
from trackloom.operators import aggregates, cluster, evaluation, filters, geometry, graph, joins, matching, raster, sets, tiles, trajectories
from trackloom.session import shared_path
from trackloom.sources import maps, points


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_grid_join_is_the_cross_join(spark):
    rnd = random.Random(1)
    pts = frame(spark, [(i, rnd.uniform(0, 1000), rnd.uniform(0, 1000)) for i in range(400)], "i long, x double, y double")
    boxes = frame(spark, [(i, x, y, x + rnd.uniform(0, 60), y + rnd.uniform(0, 60)) for i in range(400) for x, y in [(rnd.uniform(0, 1000), rnd.uniform(0, 1000))]], "j long, x0 double, y0 double, x1 double, y1 double")
    got = joins.within_box(pts, boxes, 10.0)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    want = pts.crossJoin(boxes).where("x >= x0 - 10 AND x <= x1 + 10 AND y >= y0 - 10 AND y <= y1 + 10")
    pairs = lambda df: sorted((r.i, r.j) for r in df.select("i", "j").collect())
    assert pairs(got) == pairs(want)


def test_nearest(spark):
    rnd = random.Random(2)
    a, b = ([(i, rnd.uniform(0, 100), rnd.uniform(0, 100)) for i in range(n)] for n in (60, 40))
    got = joins.nearest(frame(spark, a, "i long, x double, y double"), frame(spark, b, "j long, u double, v double"), "i", "j", ("x", "y"), ("u", "v"), 1.0, k=2).collect()
    for i, x, y in a:
        want = [j for _, j in sorted((math.dist((x, y), (u, v)), j) for j, u, v in b)[:2]]
        assert [r.j for r in sorted((r for r in got if r.i == i), key=lambda r: r["rank"])] == want


def test_spans_and_prefixes(spark):
    rows = [(1, k, k * 10_000_000 if k < 4 else 100_000_000 + k * 10_000_000, 35.0 + k * 1e-4, 51.0) for k in range(8)]
    df = frame(spark, rows, "route_id long, event_id long, us long, lat double, lon double")
    assert sorted(r.event_id for r in trajectories.cut_at_gap(df, "route_id", 20).collect()) == [0, 1, 2, 3]
    got = trajectories.sessions(df, trajectories.Limits(seconds=20, metres=100, speed=None, least_metres=5))
    assert {(r.event_id, r.session) for r in got.collect()} == {(k, 1 if k < 4 else 2) for k in range(8)}
    w = joins.clear_of(df, "route_id", "us", F.col("event_id") == 2, 10_000_000)
    assert sorted(r.event_id for r in w.collect()) == [0, 4, 5, 6, 7]


def test_thinning_of_trips(spark):
    rnd = random.Random(3)
    rows = [(t, k, k, 35 + rnd.uniform(0, 0.002), 51 + rnd.uniform(0, 0.002)) for t in range(4) for k in range(30)]
    df = frame(spark, rows, "route_id long, event_id long, us long, lat double, lon double")
    got = {(r.route_id, r.event_id) for r in trajectories.thin(df, "route_id", 60, 190).collect()}
    want = set()
    for t in range(4):
        own = [r for r in rows if r[0] == t]
        kept = [own[0]]
        for r in own[1:]:
            d = raster.metres(kept[-1][3], kept[-1][4], r[3], r[4])
            if d > 190:
                break
            if d >= 60:
                kept.append(r)
        if len(kept) > 1:
            want |= {(t, r[1]) for r in kept}
    assert got == want


def test_numbers_follow_the_order(spark):
    rnd = random.Random(4)
    ids = rnd.sample(range(10_000), 700)
    got = trajectories.numbered(frame(spark, [(i,) for i in ids], "k long"), ["k"]).collect()
    assert {r.k: r.traj_id for r in got} == {k: n for n, k in enumerate(sorted(ids), 1)}


def test_scores(spark):
    df = frame(spark, [(1, [0.9, 0.8, 0.7], [0.0, 0.5, 0.25]), (2, [], []), (3, None, None)], "id long, ep array<double>, tp array<double>")
    got = {r.id: r.s for r in df.select("id", aggregates.mean_score("ep", "tp").alias("s")).collect()}
    assert got[1] == pytest.approx(0.491667, abs=1e-6) and got[2] is None and got[3] is None
    sums = frame(spark, [(1, [0.0]), (2, [4.4]), (3, [4.5]), (4, None)], "id long, ep array<double>")
    assert [r.u for r in sums.orderBy("id").select(aggregates.is_unmatched("ep", 9, 0.5).alias("u")).collect()] == [False, True, False, False]
    trips = frame(spark, [(k,) for k in (1, 2, 3, 4, 5)], "id long")
    assert {r.id: r.unmatch for r in matching.classified(trips, sums, 9, 0.5).collect()} == {1: False, 2: True, 3: False, 4: False, 5: True}


def test_one_direction(spark):
    df = frame(spark, [(1, 1, 2), (2, 2, 1), (3, 2, 3)], "edge_id long, source long, target long")
    assert sorted((r.source, r.target) for r in sets.one_direction(df).collect()) == [(1, 2), (2, 3)]
    assert {r.edge_id for r in sets.sample(df, "edge_id", 2, 1).collect()} == {r.edge_id for r in sets.sample(df.repartition(3), "edge_id", 2, 1).collect()}


def test_speed_band_keeps_one_a_place(spark):
    df = frame(spark, [(3, 1.0, 1.0, 50.0), (2, 1.0, 1.0, 60.0), (1, 1.0, 1.0, 500.0), (4, 2.0, 1.0, 50.0)], "id long, x double, y double, v double")
    assert sorted(r.id for r in filters.speed_band(df, "v", 5, 100, ("x", "y"), "id").collect()) == [2, 4]


def grid_edges(spark, n=5, size=100.0):
    rows = []
    for r in range(n):
        for c in range(n):
            for a, b in ((r, c + 1), (r + 1, c), (r, c - 1), (r - 1, c)):
                if 0 <= a < n and 0 <= b < n:
                    rows.append((len(rows) + 1, r * n + c, a * n + b, 1.0, size, c * size, r * size, b * size, a * size))
    return frame(spark, rows, "edge_id long, source long, target long, weight double, length double, ax double, ay double, bx double, by double"), rows


def test_bounded_paths_are_dijkstra(spark):
    edges, rows = grid_edges(spark, 4)
    heads = {}
    for r in rows:
        heads.setdefault(r[1], []).append((r[2], r[4] + r[0] % 7))
    weighed = edges.withColumn("length", F.col("length") + F.col("edge_id") % 7)
    got = {(r.a, r.b): r.dist for r in matching.bounded_paths(weighed, 320.0).collect()}
    want = {(s, t): d for s in heads for t, d in graph.dijkstra(heads, s, 320.0)[0].items()}
    assert got == pytest.approx(want)


def test_matching_follows_the_road(spark):
    edges, rows = grid_edges(spark)
    by_ends = {(r[1], r[2]): r[0] for r in rows}
    pts = frame(spark, [(1, k, k, 20.0 + 40 * k, 3.0 * (-1) ** k) for k in range(9)], "trip long, n long, point_id long, x double, y double")
    got = [r.edge_id for r in matching.match_trips(pts, edges, 60.0).orderBy("n").collect()]
    assert len(got) == 9 and set(got) <= {by_ends[(k, k + 1)] for k in range(4)} | {by_ends[(k + 1, k)] for k in range(4)}
    st = matching.st_match(pts, edges, matching.bounded_paths(edges, 400.0), 4, 60.0, 20.0).first()
    assert st.opath == [by_ends[(k * 40 + 20) // 100, (k * 40 + 20) // 100 + 1] for k in range(9)] or len(set(st.opath)) <= 6
    far = frame(spark, [(2, 0, 100, 9000.0, 9000.0)], "trip long, n long, point_id long, x double, y double")
    assert matching.match_trips(far, edges, 60.0).first().edge_id is None


def test_transition_table_is_the_kernel(spark):
    edges, rows = grid_edges(spark, 3)
    model = kernels.transitions({r[0]: (r[1], r[2], r[3]) for r in rows})
    got = {(r.edge_id, r.next_id): r.p for r in matching.onward_links(edges).collect()}
    want = {(e, f): p for e, own in model.items() if e != kernels.UNKNOWN for f, p in own}
    assert got == pytest.approx(want)


def test_crossings_and_splits(spark):
    rnd = random.Random(6)
    rows = [(k, *[rnd.uniform(0, 100) for _ in range(2)]) for k in range(60)]
    rows = [(k, x, y, x + rnd.uniform(-25, 25), y + rnd.uniform(-25, 25)) for k, x, y in rows]
    df = frame(spark, rows, "id long, ax double, ay double, bx double, by double")

    def ccw(a, b, c):
        return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]) > 0

    want = {(p[0], q[0]) for p in rows for q in rows if p[0] < q[0] and ccw(p[1:3], q[1:3], q[3:]) != ccw(p[3:], q[1:3], q[3:]) and ccw(p[1:3], p[3:], q[1:3]) != ccw(p[1:3], p[3:], q[3:])}
    got = [(r.a, r.b) for r in geometry.crossing_pairs(df, "id", 10.0).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    pieces = geometry.split_at_crossings(df, "id", 10.0).collect()
    assert len(pieces) == 60 + 2 * len(want)
    for k, ax, ay, bx, by in rows:
        own = [r for r in pieces if r.id == k]
        assert sum(math.dist((r.ax, r.ay), (r.bx, r.by)) for r in own) == pytest.approx(math.dist((ax, ay), (bx, by)))


def test_snapping_and_extending(spark):
    lines = frame(spark, [(1, [(0.0, 0.0), (100.0, 0.0)]), (2, [(110.0, 0.0), (200.0, 0.0)])], "id long, points array<struct<x:double,y:double>>")
    got = {r.id: r.points for r in geometry.snapped(lines, "id", 1.0, 20.0).collect()}
    assert tuple(got[1][-1]) == (110.0, 0.0) and len(got[1]) == 3 and tuple(got[2][0]) == (100.0, 0.0)
    segs = frame(spark, [(1, 0.0, 0.0, 90.0, 0.0), (2, 100.0, -50.0, 100.0, 50.0)], "id long, ax double, ay double, bx double, by double")
    ext = geometry.extended(segs, "id", 30.0).collect()
    assert [(r.id, r.end, r.other, r.x, r.y) for r in ext] == [(1, 1, 2, 100.0, 0.0)]


def test_tiled_thinning_is_untiled(spark):
    rnd = random.Random(8)
    cells = {(r + a, c + b) for r, c in [(rnd.randrange(90), rnd.randrange(90)) for _ in range(90)] for a in range(5) for b in range(7)}
    df = frame(spark, sorted(cells), "row long, col long")
    one = {(r.row, r.col) for r in raster.thinned(df, 10_000, 100).collect()}
    many = {(r.row, r.col) for r in raster.thinned(df, 25, 3).collect()}
    assert one == many
    again = {(r.row, r.col) for r in raster.thinned(frame(spark, sorted(one), "row long, col long"), 25, 3).collect()}
    assert again == one


def test_blobs_and_tracing(spark):
    cross = [(5, c) for c in range(11)] + [(r, 5) for r in range(11) if r != 5]
    df = frame(spark, cross, "row long, col long")
    kinds = raster.crossings(df)
    at = {(r.row, r.col): r.kind for r in kinds.collect()}
    assert at[(5, 5)] == "crossing" and at[(5, 2)] == "path"
    nodes, segs = raster.vectorised(kinds, tolerance=1.0)
    assert nodes.count() >= 1 and segs.count() >= 8
    two = frame(spark, [(0, 0), (1, 1), (5, 5), (5, 6)], "row long, col long")
    assert raster.centres(raster.blobs(two)).count() == 2


def test_closing_fills_gaps(spark):
    df = frame(spark, [(r, c, 10) for r in range(6) for c in range(9) if (r, c) != (3, 4)], "row long, col long, v long")
    assert {(r.row, r.col) for r in raster.closed(df, 1).collect()} >= {(3, 4)}


def test_covered_lengths(spark):
    own = frame(spark, [(1, 0.0, 0.0, 100.0, 0.0)], "edge_id long, ax double, ay double, bx double, by double")
    other = frame(spark, [(7, 20.0, 5.0, 40.0, 5.0), (8, 30.0, -5.0, 60.0, -5.0), (9, 500.0, 0.0, 600.0, 0.0)], "edge_id long, ax double, ay double, bx double, by double")
    got = evaluation.covered(own, other, 5.0).first()
    assert got.length == 100 and got.inside == pytest.approx(40, abs=0.01)
    s = evaluation.buffer_scores(own, other, [5.0]).first()
    assert s.completeness == pytest.approx(0.4, abs=1e-3) and 0 < s.correctness < 0.4


def test_mutual_matches(spark):
    m = frame(spark, [(1, 0.0, 0.0), (2, 1.0, 0.0)], "marble long, x double, y double")
    h = frame(spark, [(1, 0.4, 0.0), (2, 50.0, 0.0)], "hole long, hx double, hy double")
    assert [(r.marble, r.hole) for r in evaluation.mutual_matches(m, h, 5.0).collect()] == [(1, 1)]
    s = evaluation.marble_scores(m, h, 5.0).first()
    assert (s.precision, s.recall, s.f) == (0.5, 0.5, 0.5)
    none = evaluation.marble_scores(m.where("marble > 9"), h, 5.0).first()
    assert none.precision is None and none.f is None


def test_chains_and_walks(spark):
    e = frame(spark, [(1, 2), (2, 3), (3, 4), (4, 5), (4, 6), (10, 11), (11, 12), (12, 10)], "source long, target long")
    got = {(r.source, r.target, r.edges) for r in graph.chains(e).collect()}
    assert got == {(1, 4, 3), (4, 5, 1), (4, 6, 1), (None, None, 3)}
    far = frame(spark, [(1, (1 << 31) + 5), (2, 5), (10**10, 10**10 + 1), (10**10 + 1, -(10**17))], "source long, target long")
    assert {(r.source, r.target, r.edges) for r in graph.chains(far).collect()} == {(1, (1 << 31) + 5, 1), (2, 5, 1), (-(10**17), 10**10, 2)}
    assert sorted(tuple(r.nodes) for r in graph.walks(e.where("source < 5"), 2).collect()) == [(1, 2, 3), (2, 3, 4), (3, 4, 5), (3, 4, 6)]


def test_tiles(spark):
    box = (0.0, 0.0, 3.0, 4.0)
    assert tiles.tile_boxes(spark, box, 3, 4).count() == 12
    pts = frame(spark, [(0.5, 0.5), (3.0, 4.0), (1.5, 2.5), (9.0, 9.0)], "lat double, lon double")
    assert [r.t for r in pts.select(tiles.tile_of("lat", "lon", box, 3, 4).alias("t")).collect()] == [0, 11, 6, None]


def test_cluster_operators(spark):
    links = frame(spark, [(1, 0.0, 0.0, 35.0, 0.0), (2, 0.0, 0.0, 10.0, 0.0)], "edge_id long, ax double, ay double, bx double, by double")
    assert {r.edge_id: r["count"] for r in cluster.subdivided(links, "edge_id", 10.0).groupBy("edge_id").count().collect()} == {1: 5, 2: 2}


def test_sqlite_round_trip(spark, tmp_path):
    g = {
        "nodes": frame(spark, [(1, 35.5, 51.5, 2.0)], "id long, latitude double, longitude double, weight double"),
        "edges": frame(spark, [(1, 1, 1, 3.0)], "id long, in_node long, out_node long, weight double"),
        "segments": frame(spark, [(1, [4, 5])], "id long, edge_ids array<long>"),
        "intersections": frame(spark, [(1,)], "node_id long"),
    }
    file = str(tmp_path / "g.db")
    maps.export_sqlite(file, g)
    back = maps.import_sqlite(spark, file)
    assert back["segments"].first().edge_ids == [4, 5] and back["nodes"].first().latitude == 35.5
    with sqlite3.connect(file) as db:
        assert db.execute("SELECT edge_ids FROM segments").fetchone()[0] == "[4, 5]"


def test_text_trips(spark, tmp_path):
    (tmp_path / "trip_7.txt").write_text("1.0 2.0 3\n4.0 5.0 6\n\n")
    got = points.read_trip_texts(spark, str(tmp_path)).orderBy("n").collect()
    assert [(r.trip, r.x, r.y, r.t) for r in got] == [(7, 1, 2, 3), (7, 4, 5, 6)]
    points.write_trajectories(frame(spark, [(1, "a")], "route_id long, x string"), path := shared_path(spark, "t"), text=True)
    assert spark.read.text(path).count() == 1


def test_streaming_equals_batch(spark, tmp_path):
    from trackloom.streaming import online

    rnd = random.Random(9)
    obs = [(r, n, [(s, rnd.uniform(0.1, 1)) for s in (0, 1, 2)]) for r in (1, 2) for n in range(30)]
    df = frame(spark, obs, "route long, n long, candidates array<struct<state:long,e:double>>")
    for k in range(3):
        df.where(F.col("n").between(k * 10, k * 10 + 9)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    look = lambda s, t: 0.7 if s == t else 0.15
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = online.match_stream(stream, look, keep=5, silent_ms=None).writeStream.format("memory").queryName("matched").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    got = {(r.route, r.n): r.state for r in spark.table("matched").collect()}
    for r in (1, 2):
        want = kernels.matched([c for a, _, c in obs if a == r], look, {kernels.UNKNOWN: 1.0}, 5)
        own = [got[(r, n)] for n in range(sum(1 for a, _ in got if a == r))]
        assert len(own) == 25 and own == want[:25]


def test_windowed_speed(spark):
    from trackloom.streaming import online

    df = spark.sql("SELECT * FROM VALUES (timestamp'2024-01-01 00:10:00', 'a', 1.0D), (timestamp'2024-01-01 00:50:00', 'a', 3.0D), (timestamp'2024-01-01 01:10:00', 'a', 5.0D) AS t(ts, kind, value)")
    assert sorted((r.n, r["mean"]) for r in online.windowed_speed(df).collect()) == [(1, 5.0), (2, 2.0)]


def test_interval_sweep(spark):
    from trackloom.operators.aggregates import interval_sweep

    own = [("a", 0, 10, 1), ("a", 0, 4, 2), ("a", 4, 4, 3), ("a", 5, 6, 4), ("a", 10, 12, 5), ("a", 11, 12, 6), ("b", 3, 9, 7)]
    got = interval_sweep(spark.createDataFrame(own, "k string, l long, r long, i long"), ["k"], "l", "r", "i").collect()
    assert {r.i: (r.place, r.open) for r in got} == {2: (1, 0), 1: (2, 1), 3: (3, 2), 4: (4, 1), 5: (5, 1), 6: (6, 1), 7: (1, 0)}
    assert interval_sweep(spark.createDataFrame([], "k string, l long, r long, i long"), ["k"], "l", "r", "i").count() == 0


def test_database(spark):
    import uuid

    from py4j.protocol import Py4JJavaError

    from trackloom.sources import database

    url, name = "jdbc:derby:memory:tests;create=true", "t" + uuid.uuid4().hex
    one, two = spark.range(7).select((F.col("id") * 10).alias("v")), spark.range(5).select((F.col("id") + 100).alias("v"))
    database.append(one, url, name)
    database.append(two, url, name)
    database.add_primary_key(spark, url, name)
    for parts in (1, 3, 50):
        got = database.read(spark, url, name, parts).collect()
        assert sorted(r.v for r in got) == sorted([*range(0, 70, 10), *range(100, 105)])
        assert len({r.id for r in got}) == 12
    database.append(one.limit(0), url, name)
    assert database.read(spark, url, name).count() == 12
    with pytest.raises(Py4JJavaError):
        one.withColumn("id", F.lit(0).cast("long")).write.format("jdbc").options(url=url, dbtable=name).mode("append").save()
