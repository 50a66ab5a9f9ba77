"""Predicates and projections over points, edges and trips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Box = tuple[float, float, float, float]  # south, west, north, east


def strictly_inside(lat: str, lon: str, box: Box) -> Column:
    s, w, n, e = box
    return (F.col(lat) > s) & (F.col(lat) < n) & (F.col(lon) > w) & (F.col(lon) < e)


def inside(lat: str, lon: str, box: Box) -> Column:
    s, w, n, e = box
    return F.col(lat).between(s, n) & F.col(lon).between(w, e)


def in_time(df: DataFrame, us: str, start: int | None, end: int | None) -> DataFrame:
    """Rows from ``start`` to ``end``, inclusive; everything unless both are given."""
    return df if start is None or end is None else df.where(F.col(us).between(start, end))


def both_ends_inside(box: Box, ends: tuple[tuple[str, str], tuple[str, str]] = (("lat1", "lon1"), ("lat2", "lon2"))) -> Column:
    (a, b), (c, d) = ends
    return inside(a, b, box) & inside(c, d, box)


def line_inside(points: str, box: Box) -> Column:
    """Whether the first and the last point of an array of lon, lat are inside."""
    s, w, n, e = box
    ok = lambda p: p["lat"].between(s, n) & p["lon"].between(w, e)
    return ok(F.element_at(points, 1)) & ok(F.element_at(points, -1))


def same_length(*arrays: str) -> Column:
    out = F.lit(True)
    for a in arrays[1:]:
        out = out & (F.size(arrays[0]) == F.size(a))
    return out


def speed_band(df: DataFrame, speed: str, least: float, most: float, xy: tuple[str, str], tie: str) -> DataFrame:
    """Rows within a band of speeds, and of rows at one place the one with the smallest ``tie``."""
    kept = df.where(F.col(speed).between(least, most))
    first = kept.groupBy(*xy).agg(F.min(F.struct(tie, *[c for c in df.columns if c not in (tie, *xy)])).alias("_r"))
    return first.select(*[F.col(c) if c in xy else F.col(f"_r.{c}").alias(c) for c in df.columns])
