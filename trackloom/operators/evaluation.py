"""Scores of an inferred map against a ground map."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.functions import geo
from trackloom.kernels import freespace
from trackloom.operators import joins
from trackloom.operators.joins import cell


def detections(matches: DataFrame, dropped: DataFrame, degrees: float = 20.0) -> DataFrame:
    """Pairs of a match (id, vx, vy, opath) and a dropped edge on its path (edge_id, ux, uy) of like direction."""
    each = joins.exploded_path(matches, dropped, keep=("id", "vx", "vy"))
    aligned = F.abs(geo.cosine("vx", "vy", "ux", "uy")) >= math.cos(math.radians(degrees))
    return each.where(aligned).select("id", "edge_id").distinct()


def precision_recall(found: DataFrame, matches: DataFrame, dropped: DataFrame, least_length: float, least_crossings: int | None = None) -> DataFrame:
    """precision, recall and f1, null where undefined.

    Precision: matches with a detection of all matches. Recall: edges detected of the
    dropped edges that are long (and, if asked, often crossed) enough.
    """
    hit = found.agg(F.countDistinct("id").alias("good"), F.countDistinct("edge_id").alias("detected"))
    every = matches.agg(F.count(F.lit(1)).alias("n"))
    own = dropped.where(F.col("length") >= least_length)
    if least_crossings is not None:
        own = own.where(F.col("num_trips") >= least_crossings)
    there = own.agg(F.countDistinct("edge_id").alias("relevant"))
    p, r = F.when(F.col("n") > 0, F.col("good") / F.col("n")), F.when(F.col("relevant") > 0, F.col("detected") / F.col("relevant"))
    out = hit.crossJoin(every).crossJoin(there).select(p.alias("precision"), r.alias("recall"))  # one row each
    return out.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))


def mutual_matches(marbles: DataFrame, holes: DataFrame, reach: float) -> DataFrame:
    """Pairs of a marble and a hole that are each other's nearest within reach: marble, hole, dist. marbles: marble, x, y; holes: hole, hx, hy."""
    near = joins.within_distance(marbles.select("marble", "x", "y"), holes.select("hole", "hx", "hy"), reach, ("x", "y"), ("hx", "hy"))
    a = near.withColumn("_a", F.row_number().over(W.partitionBy("marble").orderBy("dist", "hole")))
    both = a.withColumn("_b", F.row_number().over(W.partitionBy("hole").orderBy("dist", "marble")))
    return both.where("_a = 1 AND _b = 1").select("marble", "hole", "dist")


def marble_scores(marbles: DataFrame, holes: DataFrame, reach: float) -> DataFrame:
    pairs = mutual_matches(marbles, holes, reach).agg(F.count(F.lit(1)).alias("m"))
    n = marbles.agg(F.count(F.lit(1)).alias("marbles")).crossJoin(holes.agg(F.count(F.lit(1)).alias("holes")))
    own = pairs.crossJoin(n).select(F.when(F.col("marbles") > 0, F.col("m") / F.col("marbles")).alias("precision"), F.when(F.col("holes") > 0, F.col("m") / F.col("holes")).alias("recall"))
    return own.withColumn("f", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))


def spurious_missing(marbles: DataFrame, holes: DataFrame, reach: float) -> DataFrame:
    """Share of marbles without a hole within reach, of holes without a marble, and F of the complements."""
    pairs = joins.within_distance(marbles.select("marble", "x", "y"), holes.select("hole", "hx", "hy"), reach, ("x", "y"), ("hx", "hy"))
    met = pairs.agg(F.countDistinct("marble").alias("a"), F.countDistinct("hole").alias("b"))
    n = marbles.agg(F.count(F.lit(1)).alias("m")).crossJoin(holes.agg(F.count(F.lit(1)).alias("h")))
    own = met.crossJoin(n).select((1 - F.col("a") / F.col("m")).alias("spurious"), (1 - F.col("b") / F.col("h")).alias("missing"))
    s, t = 1 - F.col("spurious"), 1 - F.col("missing")
    return own.withColumn("f", F.when(s + t > 0, 2 * s * t / (s + t)))


def _intervals(pairs: DataFrame, reach: str = "reach") -> DataFrame:
    """``pairs`` with a and b, the part of the segment a-b, as fractions, within a reach of the segment c-d; the zone is convex, so it is one interval. Null if there is none.

    It is the hull of what lies beside c-d, within its strip, and of what is near c and
    near d. In steps, so that no generated method grows too long.
    """
    some = lambda v: F.nullif(v, F.lit(0.0))
    dot = lambda p, q, r, t: (F.col(f"{q}x") - F.col(f"{p}x")) * (F.col(f"{t}x") - F.col(f"{r}x")) + (F.col(f"{q}y") - F.col(f"{p}y")) * (F.col(f"{t}y") - F.col(f"{r}y"))
    cross = lambda p, q, r, t: (F.col(f"{q}y") - F.col(f"{p}y")) * (F.col(f"{t}x") - F.col(f"{r}x")) - (F.col(f"{q}x") - F.col(f"{p}x")) * (F.col(f"{t}y") - F.col(f"{r}y"))
    eps, size = F.col(reach), F.col("_size")
    own = pairs.withColumns({"_size": some(F.sqrt(dot("c", "d", "c", "d"))), "_qa": dot("a", "b", "a", "b")})
    # places of a and b along c-d and beside it
    own = own.withColumns({"_u0": dot("c", "a", "c", "d") / size, "_u1": dot("c", "b", "c", "d") / size, "_v0": cross("c", "a", "c", "d") / size, "_v1": cross("c", "b", "c", "d") / size})
    own = own.withColumns({f"_q{n}{p}": f for p in "cd" for n, f in (("b", 2 * dot(p, "a", "a", "b")), ("c", dot(p, "a", p, "a") - eps * eps))})
    for v, least, most in (("u", F.lit(0.0), size), ("v", -eps, eps)):
        v0, step = F.col(f"_{v}0"), F.col(f"_{v}1") - F.col(f"_{v}0")
        one, two = (least - v0) / some(step), (most - v0) / some(step)
        own = own.withColumns({f"_{v}lo": F.least(one, two), f"_{v}hi": F.greatest(one, two), f"_{v}in": (step != 0) | v0.between(least, most)})
    own = own.withColumns({"_0lo": F.greatest(F.lit(0.0), "_ulo", "_vlo"), "_0hi": F.least(F.lit(1.0), "_uhi", "_vhi")})  # nulls are passed over
    for p in "cd":
        qa, qb, qc = F.col("_qa"), F.col(f"_qb{p}"), F.col(f"_qc{p}")
        disc = qb * qb - 4 * qa * qc
        own = own.withColumn(f"_r{p}", F.sqrt(F.when(disc >= 0, disc)))
        root = F.col(f"_r{p}")
        own = own.withColumns({f"_{p}lo": F.greatest(F.lit(0.0), (-qb - root) / some(2 * qa)), f"_{p}hi": F.least(F.lit(1.0), (-qb + root) / some(2 * qa)), f"_{p}in": F.when(qa > 0, root.isNotNull()).otherwise(qc <= 0)})
    own = own.withColumn("_0in", size.isNotNull() & F.col("_uin") & F.col("_vin"))
    ok = {p: F.col(f"_{p}in") & (F.col(f"_{p}lo") <= F.col(f"_{p}hi")) for p in "0cd"}
    made = own.select(*pairs.columns, F.least(*[F.when(ok[p], F.col(f"_{p}lo")) for p in "0cd"]).alias("_lo"), F.greatest(*[F.when(ok[p], F.col(f"_{p}hi")) for p in "0cd"]).alias("_hi"))
    return made.withColumnsRenamed({"_lo": "from", "_hi": "to"})


def near_pairs(lines: DataFrame, other: DataFrame, reach: float, key: str = "edge_id") -> DataFrame:
    """Pairs of a segment (key, ax, ay, bx, by) and one of ``other`` (_o, cx, cy, dx, dy) whose boxes come within ``reach``, once each.

    Both are dealt to cells; a pair meets in the first cell that both are in.
    """
    size = max(reach, 50.0)
    low = lambda a, b, m: cell(F.least(a, b) - m, size)
    high = lambda a, b, m: cell(F.greatest(a, b) + m, size)
    dealt = lambda df, ax, ay, bx, by, m: df.withColumn("_cx", F.explode(F.sequence(low(ax, bx, m), high(ax, bx, m)))).withColumn("_cy", F.explode(F.sequence(low(ay, by, m), high(ay, by, m))))
    left = dealt(lines.select(key, "ax", "ay", "bx", "by"), "ax", "ay", "bx", "by", 0.0)
    right = other.select(F.col(key).alias("_o"), F.col("ax").alias("cx"), F.col("ay").alias("cy"), F.col("bx").alias("dx"), F.col("by").alias("dy"))
    both = left.join(dealt(right, "cx", "cy", "dx", "dy", reach), ["_cx", "_cy"])
    first = (F.col("_cx") == F.greatest(low("ax", "bx", 0.0), low("cx", "dx", reach))) & (F.col("_cy") == F.greatest(low("ay", "by", 0.0), low("cy", "dy", reach)))
    return both.where(first).drop("_cx", "_cy")


def _inside(lines: DataFrame, pairs: DataFrame, reaches: list[float], key: str) -> DataFrame:
    """key, reach, length, inside of every segment and reach, from pairs at the largest reach."""
    every = F.array(*[F.lit(float(r)) for r in reaches])
    found = _intervals(pairs.withColumn("reach", F.explode(every)))
    # an exploded array rather than a condition, which would be pushed into the expressions before it
    parts = found.select(key, "reach", F.explode(F.when(F.col("from") < F.col("to"), F.array(F.struct(F.col("from").alias("a"), F.col("to").alias("b"))))).alias("p")).select(key, "reach", "p.a", "p.b")
    w = W.partitionBy(key, "reach").orderBy("a", "b")
    seen = F.max("b").over(w.rowsBetween(W.unboundedPreceding, -1))
    share = parts.select(key, "reach", "a", "b", seen.alias("_s")).groupBy(key, "reach").agg(F.sum(F.greatest(F.lit(0.0), F.col("b") - F.greatest("a", F.coalesce("_s", "a")))).alias("share"))
    length = F.sqrt((F.col("ax") - F.col("bx")) * (F.col("ax") - F.col("bx")) + (F.col("ay") - F.col("by")) * (F.col("ay") - F.col("by")))
    own = lines.select(key, length.alias("length"), F.explode(every).alias("reach"))
    return own.join(share, [key, "reach"], "left").select(key, "reach", "length", (F.col("length") * F.coalesce("share", F.lit(0.0))).alias("inside"))


def covered(lines: DataFrame, other: DataFrame, reach: float, key: str = "edge_id") -> DataFrame:
    """Length of each segment (ax, ay, bx, by) and how much of it is within reach of any segment of ``other``; columns only."""
    return _inside(lines, near_pairs(lines, other, reach, key), [reach], key).drop("reach")


def buffer_scores(ground: DataFrame, inferred: DataFrame, reaches: list[float], key: str = "edge_id") -> DataFrame:
    """completeness, correctness and F for each reach, from one join of the two maps at the largest."""
    from trackloom.operators.raster import saved

    pairs = saved(near_pairs(ground, inferred, max(reaches), key))
    back = pairs.select(F.col("_o").alias(key), *[F.col(a).alias(b) for a, b in zip(("cx", "cy", "dx", "dy", "ax", "ay", "bx", "by"), ("ax", "ay", "bx", "by", "cx", "cy", "dx", "dy"), strict=True)])
    total = lambda lines, own, out: _inside(lines, own, reaches, key).groupBy("reach").agg((F.sum("inside") / F.sum("length")).alias(out))
    c, r = F.col("completeness"), F.col("correctness")
    both = total(ground, pairs, "completeness").join(total(inferred, back, "correctness"), "reach")
    return both.select("completeness", "correctness", F.when(c + r > 0, 2 * c * r / (c + r)).alias("f"), "reach")


def path_distances(paths: DataFrame, edges: DataFrame, kind: str = "frechet", most: int = 1600, size: float = 2400.0) -> DataFrame:
    """For each path (path, points) the least whole-number distance at which the graph has a curve like it: path, distance; null beyond ``most``.

    kind "frechet": a walk in the graph whose Frechet distance from the path is
    within it; "hausdorff": every point of the path is near some edge.

    Paths are dealt to tasks by the tile of their first point, each tile with all edges that come
    within the reach of any of its paths, so tiles have no say in the result. The reach
    is short at first, and longer for the paths that are still open.
    """
    from trackloom.operators.raster import saved

    def each(limit: int):
        def run(key, own: pd.DataFrame, graph: pd.DataFrame) -> pd.DataFrame:
            segs = graph[["source", "target", "ax", "ay", "bx", "by"]].to_numpy(float)
            lines = [np.column_stack([x, y]).astype(float) for x, y in zip(own["xs"], own["ys"], strict=True)]
            found = freespace.least_distances(lines, segs, kind, limit)
            return pd.DataFrame({"path": own["path"].to_numpy(), "distance": pd.array(found, "Int64")})

        return run

    p = lambda c, f: f(f"{c}s")
    tile = lambda x, y: F.floor(x / size) * 1_000_000 + F.floor(y / size)
    open_ = paths.where(F.size("points") > 0).select("path", *[F.col(f"points.{c}").cast("array<double>").alias(f"{c}s") for c in "xy"])
    open_ = open_.withColumn("tile", tile(F.get("xs", F.lit(0)), F.get("ys", F.lit(0))))
    boxed = open_.select("path", "tile", *[p(c, f).alias(f"{c}{n}") for c in "xy" for n, f in ((0, F.array_min), (1, F.array_max))])
    lines = edges.select("source", "target", "ax", "ay", "bx", "by")
    out, limits = None, [n for n in (50, 200) if n < most] + [most]
    for limit in limits:
        step = float(max(limit, 200))
        span = lambda a, b, m: F.sequence(cell(a - m, step), cell(b + m, step))  # noqa: B023, E731
        cells = boxed.withColumn("_cx", F.explode(span(F.col("x0"), F.col("x1"), limit))).withColumn("_cy", F.explode(span(F.col("y0"), F.col("y1"), limit))).select("tile", "_cx", "_cy").distinct()
        dealt = lines.withColumn("_cx", F.explode(span(F.least("ax", "bx"), F.greatest("ax", "bx"), 0.0))).withColumn("_cy", F.explode(span(F.least("ay", "by"), F.greatest("ay", "by"), 0.0)))
        graph = dealt.join(cells, ["_cx", "_cy"]).select("tile", "source", "target", "ax", "ay", "bx", "by").distinct()
        done = saved(open_.groupBy("tile").cogroup(joins.fresh(graph).groupBy("tile")).applyInPandas(each(limit), "path long, distance long"))
        found = done if limit == most else done.where("distance IS NOT NULL")
        out = found if out is None else out.unionByName(found)
        rest = done.where("distance IS NULL").select("path")
        if limit == most or rest.isEmpty():
            break
        open_, boxed = (saved(df.join(rest, "path", "left_semi")) for df in (open_, boxed))
    return out


def classes(edges: DataFrame, detected: DataFrame, false_ids: DataFrame, least_length: float, least_crossings: int) -> DataFrame:
    """What a plot colours edges by: detected, false, too short, too rarely crossed, or missed."""
    own = edges.join(detected.select("edge_id", F.lit(True).alias("_d")), "edge_id", "left").join(false_ids.select("edge_id", F.lit(True).alias("_f")), "edge_id", "left")
    kind = F.when(F.col("_d"), "detected").when(F.col("_f"), "false").when(F.col("length") < least_length, "short").when(F.coalesce("num_trips", F.lit(0)) < least_crossings, "rare").otherwise("missed")
    return own.select("edge_id", kind.alias("kind"))
