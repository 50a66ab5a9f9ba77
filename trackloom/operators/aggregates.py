"""Aggregations over crossings, traces, graphs and lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def trips_by_edge(crossings: DataFrame, edge_id: str = "edge_id") -> DataFrame:
    """Crossings of each edge; an edge that a trip crosses twice counts twice."""
    return crossings.groupBy(edge_id).agg(F.count(F.lit(1)).alias("num_trips"))


def extent(points: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    return points.agg(F.min(lat).alias("south"), F.max(lat).alias("north"), F.min(lon).alias("west"), F.max(lon).alias("east"), F.count(F.lit(1)).alias("n"))


def is_unmatched(ep: str, n: Column | int, overlap: float) -> Column:
    """Whether the sum of emission probabilities is above 0 but below ``n * overlap``; false for null."""
    total = F.aggregate(F.col(ep), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
    return F.coalesce((total > 0) & (total < n * F.lit(overlap)), F.lit(False))


def unmatched_ids(crossings: DataFrame, key: str, ep: str, n: int, overlap: float) -> DataFrame:
    """Keys whose sum of emission probabilities, a row each, is above 0 but below ``n * overlap``.

    Summed as decimals, so that no order of rows has a say where a sum is the bound itself.
    """
    total = F.sum(F.col(ep).cast("decimal(38,12)"))
    return crossings.groupBy(key).agg(total.alias("_t")).where((F.col("_t") > 0) & (F.col("_t") < F.lit(n * overlap).cast("decimal(38,12)"))).select(key)


def mean_score(ep: str, tp: str) -> Column:
    """Mean of ep * tp, where the first tp counts as 1; null for no entries."""
    products = F.zip_with(F.col(ep), F.transform(F.col(tp), lambda x, i: F.when(i == 0, 1.0).otherwise(x)), lambda a, b: a * b)
    return F.when(F.size(ep) > 0, F.aggregate(products, F.lit(0.0), lambda s, x: s + x) / F.size(ep))


def any_in_band(ep: str, error: float, low: float, high: float) -> Column:
    """Whether any emission lies strictly between those of the distances ``low`` and ``high``; the bounds are put in order."""
    import math

    a, b = sorted(math.exp(-0.5 * d / error) for d in (low, high))
    return F.exists(ep, lambda x: (x > a) & (x < b))




def rmse(df: DataFrame, keys: list[str], distance: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.sqrt(F.avg(F.col(distance) * F.col(distance))).alias("rmse"), F.count(F.lit(1)).alias("n"))


def supported(traces: DataFrame, segment: str, trace: str, least: int = 2) -> DataFrame:
    """Segments with at least ``least`` traces, and how many."""
    return traces.groupBy(segment).agg(F.countDistinct(trace).alias("weight")).where(F.col("weight") >= least)


def interior_mean(df: DataFrame, segment: str, pos: str, value: str) -> DataFrame:
    """Mean value over a segment's nodes without its ends; over the ends where there is nothing between."""
    from pyspark.sql import Window as W

    w = W.partitionBy(segment)
    own = df.withColumns({"_lo": F.min(pos).over(w), "_hi": F.max(pos).over(w)})
    inner = (F.col(pos) > F.col("_lo")) & (F.col(pos) < F.col("_hi"))
    return own.groupBy(segment).agg(F.coalesce(F.avg(F.when(inner, F.col(value))), F.avg(value)).alias("mean"))


def degrees(edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """Distinct neighbours of each node, whatever the direction."""
    both = edges.select(F.col(source).alias("node_id"), F.col(target).alias("n")).unionByName(edges.select(F.col(target).alias("node_id"), F.col(source).alias("n")))
    return both.groupBy("node_id").agg(F.countDistinct("n").alias("degree"))


def line_lengths(points: DataFrame, key: str, order: list[str], length: Column) -> DataFrame:
    """Sum of ``length``, the step to the next point, by key."""
    return points.groupBy(key).agg(F.coalesce(F.sum(length), F.lit(0.0)).alias("length"), F.count(F.lit(1)).alias("n"))


def overlap_scores(ground: DataFrame, inferred: DataFrame) -> DataFrame:
    """completeness, correctness and F from (length, inside) sums of either map; null-safe."""
    g = ground.agg((F.sum("inside") / F.sum("length")).alias("completeness"))
    i = inferred.agg((F.sum("inside") / F.sum("length")).alias("correctness"))
    c, r = F.col("completeness"), F.col("correctness")
    return g.crossJoin(i).withColumn("f", F.when(c + r > 0, 2 * c * r / (c + r)))


def interval_sweep(df: DataFrame, keys: list[str], left: str, end: str, id_col: str) -> DataFrame:
    """Each key's intervals in the order of left, then end, then id: place from 1, and how many earlier ones are still open at left.

    Starts and ends are swept as one stream, so no interval meets another; ends at
    the very start of an interval are still open. An interval must not end before it starts.
    """
    from pyspark.sql import Window as W

    start = df.select(*keys, F.col(left).alias("_t"), F.lit(0).alias("_e"), F.col(end).alias("_r"), F.col(id_col).alias("_i"))
    stop = df.select(*keys, F.col(end).alias("_t"), F.lit(1).alias("_e"), F.col(end).alias("_r"), F.col(id_col).alias("_i"))
    w = W.partitionBy(*keys).orderBy("_t", "_e", "_r", "_i").rowsBetween(W.unboundedPreceding, W.currentRow)
    ended = F.sum("_e").over(w)
    seen = F.count(F.lit(1)).over(w)
    swept = start.unionByName(stop).withColumns({"_ended": ended, "_seen": seen}).where("_e = 0")
    return swept.select(*keys, F.col("_i").alias(id_col), (F.col("_seen") - F.col("_ended")).alias("place"), (F.col("_seen") - 2 * F.col("_ended") - 1).alias("open"))
