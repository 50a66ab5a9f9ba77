"""Road graphs as tables: components, shortest paths, chains, walks, pruning."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.operators import joins


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) for each node of the pairs (a, b): root is the smallest node of its component.

    Rounds of neighbours' smallest roots, hooking and pointer jumping.
    """
    from trackloom.operators.raster import saved

    both = saved(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct())
    state = saved(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("root")))
    while True:
        seen = both.join(state.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("root").alias("c")).withColumnRenamed("u", "node")
        met = state.join(seen, "node")
        hook = met.groupBy(F.col("root").alias("node")).agg(F.min("c").alias("h"))
        hooked = met.join(hook, "node", "left").select("node", "root", F.least("root", "c", F.coalesce("h", "root")).alias("r"))
        jump = state.select(F.col("node").alias("r"), F.col("root").alias("rr"))
        new = saved(hooked.join(jump, "r").select("node", F.least("r", "rr").alias("root"), (F.least("r", "rr") < F.col("root")).alias("changed")))
        state = new.select("node", "root")
        if new.where("changed").isEmpty():
            return state


def without_isolated(nodes: DataFrame, edges: DataFrame, node_id: str = "node_id") -> DataFrame:
    """Nodes with an edge."""
    ends = edges.select(F.explode(F.array("source", "target")).alias(node_id)).distinct()
    return nodes.join(ends, node_id, "left_semi")


def intersections(nodes: DataFrame, edges: DataFrame, reach: float, xy: tuple[str, str] = ("x", "y"), node_id: str = "node_id") -> DataFrame:
    """Nodes with more than two neighbours, those within ``reach`` of each other merged: intersection, x, y, n."""
    from trackloom.operators.aggregates import degrees
    from trackloom.operators.joins import within_distance

    busy = nodes.join(degrees(edges).where("degree > 2").withColumnRenamed("node_id", node_id), node_id, "left_semi").select(node_id, *xy)
    other = busy.select(F.col(node_id).alias("b"), F.col(xy[0]).alias("_x2"), F.col(xy[1]).alias("_y2"))
    pairs = within_distance(busy.withColumnRenamed(node_id, "a"), other, reach, xy, ("_x2", "_y2")).where("a < b").select("a", "b")
    roots = components(pairs)
    named = busy.join(roots, busy[node_id] == roots.node, "left").withColumn("intersection", F.coalesce("root", node_id))
    return named.groupBy("intersection").agg(F.avg(xy[0]).alias(xy[0]), F.avg(xy[1]).alias(xy[1]), F.count(F.lit(1)).alias("n"))


def shortest_within(edges: DataFrame, sources: DataFrame, limit: float, weight: str = "length", most_rounds: int = 10_000) -> DataFrame:
    """Shortest distances up to a limit, from each source: source_id, node, dist, prev.

    Rounds of relaxation of the nodes that improved; each round joins the frontier
    with the edges and keeps the least distance. With distances limited, rounds are
    at most the edges of a path.
    """
    from trackloom.operators.raster import saved

    own = edges.select(F.col("source").alias("_s"), F.col("target").alias("_t"), F.col(weight).alias("_w"))
    best = sources.select(F.col("node_id").alias("source_id"), F.col("node_id").alias("node"), F.lit(0.0).alias("dist"), F.lit(None).cast("long").alias("prev"))
    frontier = best
    for _ in range(most_rounds):
        reached = frontier.join(own, frontier.node == own["_s"]).select("source_id", F.col("_t").alias("node"), (F.col("dist") + F.col("_w")).alias("dist"), F.col("_s").alias("prev")).where(F.col("dist") <= limit)
        both = best.withColumn("_old", F.lit(True)).unionByName(reached.withColumn("_old", F.lit(False)))
        merged = saved(both.groupBy("source_id", "node").agg(F.min(F.struct("dist", F.coalesce("prev", F.lit(-1)).alias("p"))).alias("m"), F.min(F.when(F.col("_old"), F.col("dist"))).alias("had")))
        best = merged.select("source_id", "node", F.col("m.dist").alias("dist"), F.when(F.col("m.p") >= 0, F.col("m.p")).alias("prev"))
        frontier = merged.where(F.col("had").isNull() | (F.col("m.dist") < F.col("had"))).select("source_id", "node", F.col("m.dist").alias("dist"))
        if frontier.isEmpty():
            return best
    raise RuntimeError("more rounds than allowed")


def dijkstra(heads: dict[int, list[tuple[int, float]]], source: int, limit: float = math.inf, target: int | None = None) -> tuple[dict[int, float], dict[int, int]]:
    """Distances and previous nodes from a source, with a heap."""
    dist, prev, done = {source: 0.0}, {}, set()
    heap = [(0.0, source)]
    while heap:
        d, u = heapq.heappop(heap)
        if u in done:
            continue
        done.add(u)
        if u == target:
            break
        for v, w in heads.get(u, ()):
            e = d + w
            if e <= limit and (e < dist.get(v, math.inf) or e == dist.get(v) and u < prev.get(v, u) and v not in done):
                dist[v], prev[v] = e, u
                heapq.heappush(heap, (e, v))
    return {n: d for n, d in dist.items() if n in done}, {n: p for n, p in prev.items() if n in done}


def route(prev: dict[int, int], source: int, target: int) -> list[int]:
    """Nodes of a path, empty if there is none."""
    out = [target]
    while out[-1] != source:
        if out[-1] not in prev:
            return []
        out.append(prev[out[-1]])
    return out[::-1]


def adjacency(edges: pd.DataFrame, weight: str = "length") -> dict[int, list[tuple[int, float]]]:
    out: dict[int, list[tuple[int, float]]] = {}
    for s, t, w in zip(edges["source"].tolist(), edges["target"].tolist(), edges[weight].tolist(), strict=True):
        out.setdefault(s, []).append((t, float(w)))
    return out


def _ground(df: DataFrame, edges: DataFrame, limit: float, size: float, x: str, y: str) -> tuple[DataFrame, DataFrame]:
    """``df`` with the tile of its place, and the edges with a place within ``limit`` of each such tile's bounds: whatever is within ``limit`` by road of a place in the tile."""
    tile = lambda i, j: i * 1_000_000 + j
    own = df.withColumn("tile", tile(F.floor(F.col(x) / size), F.floor(F.col(y) / size)))
    span = lambda c: F.sequence(F.floor((F.col(c) - limit) / size), F.floor((F.col(c) + limit) / size))
    dealt = edges.withColumn("_i", F.explode(span("ax"))).withColumn("_j", F.explode(span("ay"))).withColumn("tile", tile(F.col("_i"), F.col("_j"))).drop("_i", "_j")
    return own, dealt.join(own.select("tile").distinct(), "tile", "left_semi")


def paths_within(pairs: DataFrame, edges: DataFrame, limit: float, size: float = 2000.0, weight: str = "length") -> DataFrame:
    """Shortest path of each origin and destination (a, b) in edges (source, target, weight, and the place ax, ay of the source): a, b, dist, nodes; null if there is none of at most ``limit``.

    Weights must be at least the straight distance between an edge's ends. Origins are
    dealt to tiles, each with all edges within the limit of it, so tiles have no say
    in the result.
    """

    def each(key, od: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        heads = adjacency(own.sort_values(["source", "target", weight]), weight)
        rows = []
        for a, group in od.groupby("a", sort=True):
            dist, prev = dijkstra(heads, int(a), limit)
            for b in group["b"]:
                d = dist.get(int(b))
                rows.append((int(a), int(b), d, route(prev, int(a), int(b)) if d is not None else None))
        return pd.DataFrame(rows, columns=["a", "b", "dist", "nodes"])

    place = edges.groupBy(F.col("source").alias("a")).agg(F.min("ax").alias("_x"), F.min("ay").alias("_y"))
    own, dealt = _ground(pairs.select("a", "b").distinct().join(place, "a"), edges.select("source", "target", weight, "ax", "ay"), limit, size, "_x", "_y")
    found = own.select("tile", "a", "b").groupBy("tile").cogroup(joins.fresh(dealt.select("tile", "source", "target", weight)).groupBy("tile")).applyInPandas(each, "a long, b long, dist double, nodes array<long>")
    # origins without an edge reach nothing
    return pairs.select("a", "b").distinct().join(found, ["a", "b"], "left")


def chains(edges: DataFrame) -> DataFrame:
    """Undirected edges (source, target) contracted over nodes of degree two: chain, source, target, edges, where chain is its smallest edge, a pair (s, t).

    Edges that share a node of degree two are one component; ends are the nodes of
    it with other degrees. Rings without such a node have no ends.
    """
    from trackloom.operators.aggregates import degrees

    own = edges.select(F.least("source", "target").alias("s"), F.greatest("source", "target").alias("t")).distinct().withColumn("e", F.struct("s", "t"))  # a pair: ids may be any longs
    deg = degrees(edges)
    ends = own.select("e", F.explode(F.array("s", "t")).alias("node_id"))
    through = ends.join(deg.where("degree = 2"), "node_id").groupBy("node_id").agg(F.min("e").alias("a"), F.max("e").alias("b")).where("a < b")
    roots = components(through.select("a", "b"))
    named = own.join(roots, own.e == roots.node, "left").select("e", "s", "t", F.coalesce("root", "e").alias("chain"))
    tips = named.select("chain", F.explode(F.array("s", "t")).alias("node_id")).join(deg.where("degree <> 2"), "node_id")
    found = tips.groupBy("chain").agg(F.min("node_id").alias("source"), F.max("node_id").alias("target"))
    return named.groupBy("chain").agg(F.count(F.lit(1)).alias("edges")).join(found, "chain", "left")


def walks(edges: DataFrame, k: int, source: str = "source", target: str = "target") -> DataFrame:
    """All paths of ``k`` links that visit no node twice: an array of nodes."""
    step = edges.select(F.col(source).alias("_s"), F.col(target).alias("_t")).distinct()
    out = step.where("_s <> _t").select(F.array("_s", "_t").alias("nodes"))
    for _ in range(k - 1):
        out = out.join(step, F.element_at("nodes", -1) == step["_s"]).where(~F.array_contains("nodes", F.col("_t"))).select(F.concat("nodes", F.array("_t")).alias("nodes"))
    return out


def nearest_incident(edges: DataFrame, length: str = "length", bearing: str = "bearing") -> DataFrame:
    """For each node: its shortest edge, its smallest angle between two edges, its number of edges."""
    from pyspark.sql import Window as W

    w = W.partitionBy("source").orderBy(bearing, "target")
    turn = F.col(bearing) - F.lag(bearing).over(w)
    own = edges.withColumn("_turn", turn)
    round_ = own.groupBy("source").agg(F.min(length).alias("nearest"), F.min("_turn").alias("_m"), (F.min(bearing) + 360 - F.max(bearing)).alias("_wrap"), F.count(F.lit(1)).alias("edges"))
    return round_.select(F.col("source").alias("node_id"), "nearest", F.when(F.col("edges") > 1, F.least(F.coalesce("_m", F.lit(360.0)), "_wrap")).alias("angle"), "edges")


def shared_edge_groups(sticks: DataFrame, stick: str, edge: str) -> DataFrame:
    """Sticks that share an edge, over any number of steps, are one group: stick, group."""
    first = sticks.groupBy(edge).agg(F.min(stick).alias("a"))
    pairs = sticks.join(first, edge).where(F.col(stick) != F.col("a")).select("a", F.col(stick).alias("b")).distinct()
    roots = components(pairs)
    own = sticks.select(stick).distinct()
    return own.join(roots, own[stick] == roots.node, "left").select(stick, F.coalesce("root", stick).alias("group"))


def node_numbers(lines: DataFrame, cols: tuple[str, str, str, str]) -> DataFrame:
    """Places of line ends numbered from 1 in order of x, then y: x, y, node."""
    from trackloom.operators.trajectories import numbered

    ax, ay, bx, by = cols
    ends = lines.select(F.explode(F.array(F.struct(F.col(ax).alias("x"), F.col(ay).alias("y")), F.struct(F.col(bx).alias("x"), F.col(by).alias("y")))).alias("p")).select("p.x", "p.y").distinct()
    return numbered(ends, ["x", "y"], "node")


def spread_points(heads: dict[int, list[tuple[int, float]]], place: dict[int, tuple[float, float]], start: int, radius: float, every: float) -> np.ndarray:
    """Points every ``every`` along all edges within ``radius`` of the way from a start node, going outward."""
    dist, _ = dijkstra(heads, start, radius)
    out = []
    for u in sorted(dist):
        for v, w in sorted(heads.get(u, ())):
            if w <= 0 or dist.get(v, math.inf) < dist[u] or dist.get(v) == dist[u] and v < u:
                continue
            (x0, y0), (x1, y1) = place[u], place[v]
            first = math.ceil(dist[u] / every) * every
            for at in np.arange(first, min(radius, dist[u] + w), every):
                f = (at - dist[u]) / w
                out.append((x0 + (x1 - x0) * f, y0 + (y1 - y0) * f))
    return np.array(out, float).reshape(-1, 2)


def walk_points(edges: DataFrame, starts: DataFrame, radius: float, every: float, size: float = 2000.0) -> DataFrame:
    """Points of graph walks, a walk for each start (node_id), in edges (source, target, length, x1, y1, x2, y2): start, n, x, y.

    Starts are dealt to tiles, each with all edges within the radius of it.
    """

    def each(key, seeds: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["source", "target", "length"])
        heads, place = adjacency(own), {}
        for s, t, a, b, c, d in own[["source", "target", "ax", "ay", "x2", "y2"]].itertuples(index=False):
            place[s], place[t] = (a, b), (c, d)
        parts = []
        for s in sorted(seeds["node_id"]):
            p = spread_points(heads, place, int(s), radius, every) if s in place else np.zeros((0, 2))
            parts.append(pd.DataFrame({"start": int(s), "n": np.arange(len(p)), "x": p[:, 0], "y": p[:, 1]}))
        return pd.concat(parts) if parts else pd.DataFrame(columns=["start", "n", "x", "y"])

    own = edges.select("source", "target", "length", F.col("x1").alias("ax"), F.col("y1").alias("ay"), "x2", "y2")
    place = own.groupBy(F.col("source").alias("node_id")).agg(F.min("ax").alias("_x"), F.min("ay").alias("_y"))
    seeds, dealt = _ground(starts.select("node_id").distinct().join(place, "node_id"), own, radius, size, "_x", "_y")
    return seeds.select("tile", "node_id").groupBy("tile").cogroup(joins.fresh(dealt).groupBy("tile")).applyInPandas(each, "start long, n long, x double, y double")


def pruned(traces: DataFrame, most_rmse: float, least_traces: int = 2) -> DataFrame:
    """Segments kept after dropping traces whose RMSE is above a limit: segment_id, weight. traces: segment_id, trace_id, dist."""
    from trackloom.operators.aggregates import rmse, supported

    kept = rmse(traces, ["segment_id", "trace_id"], "dist").where(F.col("rmse") <= most_rmse)
    return supported(kept, "segment_id", "trace_id", least_traces)


def callbacks(df: DataFrame, key: str, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A user's function on each group."""
    return df.groupBy(key).applyInPandas(f, schema)


def turn(a: Column, b: Column) -> Column:
    return F.pmod(b - a + 180, F.lit(360.0)) - 180
