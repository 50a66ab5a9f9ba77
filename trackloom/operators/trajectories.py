"""From positions to trajectories: lags, breaks, cuts, thinning, polylines."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackloom.functions import geo

ORDER = ("us", "event_id")


@dataclass(frozen=True)
class Limits:
    """When a trajectory breaks, and which points are too close to keep."""

    seconds: float = 10.0
    metres: float = 100.0
    speed: float | None = 25.0
    least_metres: float = 5.0


def by_route(route: str = "route_id", order: tuple[str, ...] = ORDER) -> W:
    return W.partitionBy(route).orderBy(*order)


def steps(df: DataFrame, route: str = "route_id", order: tuple[str, ...] = ORDER) -> DataFrame:
    """``df`` with dt (seconds), dist (metres) and speed since the route's point before; null at its first point."""
    w = by_route(route, order)
    lag = lambda c: F.lag(c).over(w)
    own = df.withColumn("dt", (F.col("us") - lag("us")) / 1_000_000).withColumn("dist", geo.haversine(lag("lat"), lag("lon"), F.col("lat"), F.col("lon")))
    return own.withColumn("dist", F.when(F.col("dt").isNotNull(), F.col("dist"))).withColumn("speed", geo.speed("dist", F.col("dt")))


def sessions(df: DataFrame, limits: Limits, route: str = "route_id", order: tuple[str, ...] = ORDER) -> DataFrame:
    """Points with steps, without those closer to the one before than allowed, and with session numbers by route; sessions of one point go.

    Steps are taken before points are dropped.
    """
    own = steps(df, route, order)
    own = own.where(F.col("dist").isNull() | (F.col("dist") > limits.least_metres))
    brk = F.col("dt").isNull() | (F.col("dt") > limits.seconds) | (F.col("dist") > limits.metres)
    if limits.speed is not None:
        brk = brk | (F.col("speed") > limits.speed)
    w = by_route(route, order)
    own = own.withColumn("session", F.sum(brk.cast("long")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    own = own.withColumn("n_points", F.count(F.lit(1)).over(W.partitionBy(route, "session")))
    return own.where(F.col("n_points") > 1)


def runs(df: DataFrame, changed: list[str], route: str = "route_id", order: tuple[str, ...] = ORDER, out: str = "run") -> DataFrame:
    """Numbers of runs of equal values in ``changed``, by route."""
    w = by_route(route, order)
    new = F.lag(F.lit(1)).over(w).isNull()
    for c in changed:
        new = new | ~F.lag(c).over(w).eqNullSafe(F.col(c))
    return df.withColumn(out, F.sum(new.cast("long")).over(w.rowsBetween(W.unboundedPreceding, 0)))


def boundaries(df: DataFrame, col: str, route: str, order: tuple[str, ...] = ORDER) -> DataFrame:
    """``df`` with ``last``: whether the next row has another value of ``col``, or there is none."""
    nxt = F.lead(col).over(by_route(route, order))
    return df.withColumn("last", ~nxt.eqNullSafe(F.col(col)))


def prefix(df: DataFrame, key: str, broken: Column, order: tuple[str, ...] = ORDER) -> DataFrame:
    """Points of each key before the first one whose step from the one before is broken; nothing of keys of one point."""
    w = W.partitionBy(key).orderBy(*order)
    own = df.withColumn("_broken", F.sum(F.coalesce(broken, F.lit(False)).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return own.where("_broken = 0").drop("_broken")


def cut_at_gap(df: DataFrame, key: str, seconds: float = 20, order: tuple[str, ...] = ORDER) -> DataFrame:
    w = W.partitionBy(key).orderBy(*order)
    return prefix(df, key, (F.col("us") - F.lag("us").over(w)) / 1_000_000 > seconds, order)


def cut_at_speed(df: DataFrame, key: str, least: float = 2, most: float = 26, order: tuple[str, ...] = ORDER) -> DataFrame:
    w = W.partitionBy(key).orderBy(*order)
    lag = lambda c: F.lag(c).over(w)
    v = geo.speed(geo.haversine(lag("lat"), lag("lon"), F.col("lat"), F.col("lon")), (F.col("us") - lag("us")) / 1_000_000)
    v = F.when(lag("us").isNotNull(), v)
    return prefix(df, key, (v > most) | (v < least), order)


def thinned(lat: np.ndarray, lon: np.ndarray, least: float, most: float) -> np.ndarray:
    """Indices kept: a point closer than ``least`` to the last kept one goes; beyond ``most`` the trip ends with the last kept one."""
    if not len(lat):
        return np.zeros(0, np.int64)
    la, lo = np.radians(lat), np.radians(lon)
    cosine, la, lo = np.cos(la).tolist(), la.tolist(), lo.tolist()
    sin, asin, sqrt = math.sin, math.asin, math.sqrt
    kept, j = [0], 0
    for i in range(1, len(la)):
        a = sin((la[i] - la[j]) / 2) ** 2 + cosine[i] * cosine[j] * sin((lo[i] - lo[j]) / 2) ** 2
        d = 2 * geo.EARTH_RADIUS * asin(min(1.0, sqrt(a)))
        if d < least:
            continue
        if d > most:
            break
        kept.append(i)
        j = i
    return np.array(kept, np.int64)


def thin(df: DataFrame, key: str, least: float = 5, most: float = 170, order: tuple[str, ...] = ORDER) -> DataFrame:
    """Distance thinning of each trip; the outcome for a point depends on all before it, so a trip is one group. Trips left with one point go."""

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order), kind="stable")
        kept = thinned(pdf["lat"].to_numpy(), pdf["lon"].to_numpy(), least, most)
        return pdf.iloc[kept if len(kept) > 1 else []]

    return df.groupBy(key).applyInPandas(each, df.schema)


def cleaned(df: DataFrame, key: str, seconds: float = 20, most: float = 170, least: float = 5, fastest: float = 26, slowest: float = 2) -> DataFrame:
    """The three cleaning steps in turn."""
    return cut_at_speed(thin(cut_at_gap(df, key, seconds), key, least, most), key, slowest, fastest)


def in_bound_runs(df: DataFrame, box: tuple[float, float, float, float], route: str = "route_id") -> DataFrame:
    """Runs of points strictly inside a box, numbered by route; runs of one point go."""
    from trackloom.operators.filters import strictly_inside

    own = runs(df.withColumn("in_bound", strictly_inside("lat", "lon", box)), ["in_bound"], route)
    own = own.where("in_bound").withColumn("n_points", F.count(F.lit(1)).over(W.partitionBy(route, "run")))
    return own.where("n_points > 1").drop("in_bound")


def numbered(df: DataFrame, keys: list[str], out: str = "traj_id") -> DataFrame:
    """A number for each combination of keys, 1, 2, 3... in their order.

    Keys are ranked by range partitions with offsets from partition counts, so no
    single task sees them all.
    """
    from trackloom.operators.raster import saved

    own = df.select(*keys).distinct()
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = own.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_p", F.spark_partition_id())
    # written once: both uses below must see the same partitions
    ranked = saved(dealt.withColumn("_r", F.row_number().over(W.partitionBy("_p").orderBy(*keys))))
    counts = ranked.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.withColumn("_o", F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)))  # a row for each partition
    ids = ranked.join(F.broadcast(offsets.select("_p", F.coalesce("_o", F.lit(0)).alias("_o"))), "_p").select(*keys, (F.col("_r") + F.col("_o")).cast("long").alias(out))
    return df.join(ids, keys)


def polylines(df: DataFrame, key: str, cols: list[str], order: tuple[str, ...] = ORDER) -> DataFrame:
    """A row for each key with its points as an array of structs, in order."""
    packed = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *[c for c in cols if c not in order]))).alias("_p"))
    return packed.select(key, F.transform("_p", lambda p: F.struct(*[p[c].alias(c) for c in cols])).alias("points"))


def pseudo_trajectories(edges: DataFrame, least_metres: float = 20, n: int = 9) -> DataFrame:
    """Inferred edges as trips of ``n`` points: edges longer than a minimum, one of each reversed pair, densified evenly."""
    from trackloom.operators.sets import one_direction

    kept = one_direction(edges.where(F.col("length") > least_metres))
    points = kept.select("edge_id", F.posexplode(geo.linspace("lon1", "lat1", "lon2", "lat2", n)).alias("n", "p"))
    return points.select("edge_id", F.col("n").cast("long").alias("n"), F.col("p.x").alias("lon"), F.col("p.y").alias("lat"))


def interpolated(df: DataFrame, key: str, spacing: float, xy: tuple[str, str] = ("x", "y"), order: tuple[str, ...] = ("n",)) -> DataFrame:
    """Points every ``spacing`` or less along the straight steps of a trip: key, leg, step, x, y."""
    w = W.partitionBy(key).orderBy(*order)
    x, y = xy
    own = df.select(key, *order, x, y, F.lead(x).over(w).alias("_x"), F.lead(y).over(w).alias("_y"), F.row_number().over(w).cast("long").alias("leg"))
    gap = F.sqrt(F.pow(F.col("_x") - F.col(x), 2) + F.pow(F.col("_y") - F.col(y), 2))
    parts = F.coalesce(F.greatest(F.ceil(gap / spacing), F.lit(1)), F.lit(1)).cast("int")
    dealt = own.withColumn("_k", parts).withColumn("step", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    f = F.col("step") / F.col("_k")
    at = lambda a, b: F.when(F.col("step") == 0, F.col(a)).otherwise(F.col(a) + (F.col(b) - F.col(a)) * f)
    return dealt.select(key, "leg", F.col("step").cast("long").alias("step"), at(x, "_x").alias("x"), at(y, "_y").alias("y"))


def motion(df: DataFrame, key: str, order: tuple[str, ...] = ORDER) -> DataFrame:
    """Seconds, metres, km/h, azimuth (whole degrees clockwise from north) to the next point; the last point has those of the one before."""
    w = W.partitionBy(key).orderBy(*order)
    lead = lambda c: F.lead(c).over(w)
    own = df.withColumn("dt", (lead("us") - F.col("us")) / 1_000_000).withColumn("dist", F.when(lead("us").isNotNull(), geo.haversine(F.col("lat"), F.col("lon"), lead("lat"), lead("lon"))))
    own = own.withColumn("azimuth", F.when(lead("us").isNotNull(), F.round(geo.bearing(F.col("lat"), F.col("lon"), lead("lat"), lead("lon"))) % 360))
    for c in ("dt", "dist", "azimuth"):
        own = own.withColumn(c, F.coalesce(F.col(c), F.lag(c).over(w)))
    return own.withColumn("kmh", F.when(F.col("dt") > 0, F.col("dist") / F.col("dt") * 3.6))




POINT = T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())])
