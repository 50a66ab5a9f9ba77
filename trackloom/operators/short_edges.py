"""Short edges of a road graph collapsed to their middles, unless the traces of the edges around them then fit badly.

An edge of at most ``most`` metres may become one node, at its middle, which the edges at
both its ends then reach. Each trace of these edges is held against all of them as they
would lie: the root of its mean squared distance from the nearest must not pass ``worst``.
Else the edge stays, and isn't tried again; an edge without others at its ends stays, too.
Edges whose ends fall together go. The smaller id of two nodes goes on.

Rounds: every edge to try claims itself and all edges at its ends; those that are the
shortest claimant (of equally long ones the smallest id) of all they claim are tried at
once, as they share no edge that moves. So a round does what its edges would do one after
another, shortest first. Once at most ``few`` edges and trace points are left, one task
goes on, shortest first. Distances to edges, errors and rewiring are joins and sums.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.kernels.curves import to_segments
from trackloom.operators import joins
from trackloom.session import written

#: Edges and points of traces that one task takes for the rest.
FEW = 50_000


def collapsed_in_turn(place: dict[int, tuple[float, float]], edges: dict[int, tuple[int, int]], traces: dict[int, list[np.ndarray]], most: float, worst: float, tried: set[int] | None = None, order: list[int] | None = None) -> list[int]:
    """The rule in one place, shortest first or in a given order; ``place`` and ``edges`` are changed. Returns the edges in the order of their trial."""
    tried, done = set(tried or ()), []
    length = lambda k: round(math.dist(place[edges[k][0]], place[edges[k][1]]), 9)
    at: dict[int, set[int]] = {}
    for k, e in edges.items():
        for n in e:
            at.setdefault(n, set()).add(k)
    while True:
        if order is None:
            short = min(((length(k), k) for k in edges if k not in tried and length(k) <= most), default=None)
            if short is None:
                return done
            e = short[1]
        elif len(done) == len(order):
            return done
        else:
            e = order[len(done)]
        tried.add(e)
        done.append(e)
        a, b = sorted(edges[e])
        middle = tuple((p + q) / 2 for p, q in zip(place[a], place[b], strict=True))
        moved = {k: tuple(a if n == b else n for n in edges[k]) for k in (at[a] | at[b]) - {e}}
        spot = lambda n, a=a, middle=middle: middle if n == a else place[n]
        lines = [np.array([spot(p), spot(q)]) for p, q in moved.values()]
        error = lambda t, lines=lines: math.sqrt(float(np.mean(np.min([to_segments(t, s) for s in lines], axis=0) ** 2)))
        if not moved or any(error(t) > worst for k in moved for t in traces.get(k, ())):
            continue
        place[a] = middle
        for k in [e, *[k for k, (p, q) in moved.items() if p == q]]:
            for n in set(edges.pop(k)):
                at[n].discard(k)
        for k, v in moved.items():
            if k in edges:
                edges[k] = v
                at[a].add(k)
        at.pop(b)


def collapse(nodes: DataFrame, edges: DataFrame, traces: DataFrame, most: float = 50.0, worst: float = 12.0, few: int = FEW) -> tuple[DataFrame, DataFrame]:
    """Edges left (edge_id, a, b, ax, ay, bx, by) of nodes (id, x, y) and edges (edge_id, a, b), and the edges tried in rounds (round, length, edge_id).

    traces: edge_id, trace, x, y. Edges that the last task tried have no row.
    """
    spark = nodes.sparkSession
    end = lambda k: nodes.select(F.col("id").alias(k), F.col("x").alias(f"{k}x"), F.col("y").alias(f"{k}y"))
    cols = ("edge_id", "a", "b", "ax", "ay", "bx", "by")
    state = written(edges.where("a != b").join(end("a"), "a").join(end("b"), "b").select(*cols, F.lit(False).alias("tried")), "short-edges")
    traces = written(traces.select("edge_id", "trace", "x", "y"), "edge-traces")
    n_traces = traces.count()
    log = spark.createDataFrame([], "round int, length double, edge_id long")
    n = 0
    while True:
        length = F.round(F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")), 9)
        own = state.withColumn("length", length)
        asked = own.where((F.col("length") <= most) & ~F.col("tried"))
        if asked.isEmpty():
            return state.select(*cols), log
        if state.count() + n_traces <= few:
            return written(_rest(state, traces, most, worst), "collapsed").select(*cols), log
        key = F.struct("length", "edge_id")
        at = asked.select(F.col("edge_id").alias("e"), key.alias("key"), F.explode(F.array("a", "b")).alias("node"))
        ends = state.select("edge_id", F.explode(F.array("a", "b")).alias("node"))
        claims = written(at.join(ends, "node").select("e", "key", "edge_id").distinct(), "claims")
        lost = claims.join(claims.groupBy("edge_id").agg(F.min("key").alias("first")), "edge_id").where("key != first").select("e").distinct()
        tried = written(asked.join(lost.withColumnRenamed("e", "edge_id"), "edge_id", "left_anti").select(F.col("edge_id").alias("e"), F.least("a", "b").alias("keep"), F.greatest("a", "b").alias("drop"), ((F.col("ax") + F.col("bx")) / 2).alias("mx"), ((F.col("ay") + F.col("by")) / 2).alias("my"), "length"), "tried-edges")
        # the edges around as they would lie
        ours = tried.select("*", F.explode(F.array("keep", "drop")).alias("node"))
        around = ends.join(ours, "node").where("edge_id != e").select("edge_id", "e", "keep", "drop", "mx", "my").distinct().join(state, "edge_id")
        for k in "ab":
            hit = (F.col(k) == F.col("keep")) | (F.col(k) == F.col("drop"))
            around = around.withColumns({f"{k}x": F.when(hit, F.col("mx")).otherwise(F.col(f"{k}x")), f"{k}y": F.when(hit, F.col("my")).otherwise(F.col(f"{k}y")), k: F.when(hit, F.col("keep")).otherwise(F.col(k))})
        around = written(around.select("e", *cols, "tried"), "moved-edges")
        held = around.select("e", "edge_id").join(traces, "edge_id").withColumn("point", F.monotonically_increasing_id())
        held = written(held, "held-traces")
        lines = around.select("e", *[F.col(c).alias(f"_{c}") for c in ("ax", "ay", "bx", "by")])
        met = held.join(lines, "e")
        ux, uy = F.col("_bx") - F.col("_ax"), F.col("_by") - F.col("_ay")
        f = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(((F.col("x") - F.col("_ax")) * ux + (F.col("y") - F.col("_ay")) * uy) / F.nullif(ux * ux + uy * uy, F.lit(0.0)), F.lit(0.0))))
        dx, dy = F.col("x") - F.col("_ax") - f * ux, F.col("y") - F.col("_ay") - f * uy
        least = met.groupBy("e", "edge_id", "trace", "point").agg(F.min(dx * dx + dy * dy).alias("d2"))
        bad = least.groupBy("e", "edge_id", "trace").agg(F.sqrt(F.avg("d2")).alias("rmse")).where(F.col("rmse") > worst).select("e").distinct()
        good = written(tried.join(around.select("e").distinct(), "e", "left_semi").join(bad, "e", "left_anti").select("e"), "collapsed-edges")
        log = log.unionByName(written(tried.select(F.lit(n).alias("round"), "length", F.col("e").alias("edge_id")), "trials"))
        changed = around.join(good, "e", "left_semi").drop("e")
        stays = state.join(changed.select("edge_id"), "edge_id", "left_anti").join(good.withColumnRenamed("e", "edge_id"), "edge_id", "left_anti")
        now = stays.unionByName(changed.where("a != b"))
        mark = tried.select(F.col("e").alias("edge_id"), F.lit(True).alias("_t"))
        state = written(now.join(mark, "edge_id", "left").select(*cols, F.coalesce("_t", "tried").alias("tried")), "short-edges")
        n += 1


def _rest(state: DataFrame, traces: DataFrame, most: float, worst: float) -> DataFrame:
    def each(key, own: pd.DataFrame, seen: pd.DataFrame) -> pd.DataFrame:
        place = dict(zip(own["a"], zip(own["ax"], own["ay"], strict=True), strict=True)) | dict(zip(own["b"], zip(own["bx"], own["by"], strict=True), strict=True))
        edges = dict(zip(own["edge_id"], zip(own["a"], own["b"], strict=True), strict=True))
        held: dict[int, list[np.ndarray]] = {}
        for (k, _), g in seen.groupby(["edge_id", "trace"], sort=True):
            held.setdefault(k, []).append(g[["x", "y"]].to_numpy(float))
        collapsed_in_turn(place, edges, held, most, worst, set(own["edge_id"][own["tried"]]))
        return pd.DataFrame([(k, a, b, *place[a], *place[b]) for k, (a, b) in edges.items()], columns=["edge_id", "a", "b", "ax", "ay", "bx", "by"])

    one = lambda df: df.withColumn("_all", F.lit(0)).groupBy("_all")
    return one(state).cogroup(one(joins.fresh(traces))).applyInPandas(each, "edge_id long, a long, b long, ax double, ay double, bx double, by double")
