"""Functions against independently computed values and vector geometry."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.functions import codec, geo, stats
from trackloom.operators import raster


def value(spark, col):
    return spark.range(1).select(col.alias("v")).first().v


@pytest.mark.parametrize(
    "col, want, tol",
    [
        (lambda: geo.haversine(35.7185, 51.32, 35.7384, 51.3822), 6034.935077, 1e-5),
        (lambda: geo.flat_distance(35.7185, 51.32, 35.7384, 51.3822, 111070.34306591158, 83044.98918812413), 5618.430849, 1e-5),
        (lambda: geo.flat_distance(35.7185, 51.32, 35.7384, 51.3822, 111195, 90450), 6045.507507, 1e-5),
        (lambda: geo.bearing(35.7185, 51.32, 35.7384, 51.3822), 68.471965, 1e-5),
        (lambda: geo.bearing(35.7384, 51.3822, 35.7185, 51.32), 248.508286, 1e-5),
        (lambda: geo.haversine(35.746346, 51.332306, 35.746475, 51.33229), 14.416640, 1e-5),
        (lambda: geo.haversine(1, 2, 1, 2), 0.0, 0),
        (lambda: geo.law_of_cosines(35.7185, 51.32, 35.7384, 51.3822), 6034.935077, 1e-2),
        (lambda: geo.bearing_difference(350, 10), 20.0, 1e-12),
        (lambda: geo.bearing_difference(90, 300), 150.0, 1e-12),
        (lambda: geo.speed(100, 0.2), 100.0, 0),
        (lambda: geo.speed(100, 4.9), 25.0, 0),
        (lambda: geo.line_angle(0, 0, -1, -1), 225.0, 1e-9),
        (lambda: stats.erf(F.lit(0.5)), math.erf(0.5), 2e-7),
        (lambda: stats.normal_cdf(F.lit(120.0), 100, 50), 0.6554217, 1e-6),
        (lambda: stats.spring_force(F.lit(3.0), 2.0), -6.0, 0),
    ],
)
def test_values(spark, col, want, tol):
    assert value(spark, col()) == pytest.approx(want, abs=tol)


def test_destination_and_back(spark):
    lat, lon = geo.destination_lat(35.7, 70.0, 5000.0), geo.destination_lon(35.7, 51.3, 70.0, 5000.0)
    assert value(spark, geo.haversine(F.lit(35.7), F.lit(51.3), lat, lon)) == pytest.approx(5000, abs=1e-4)


def unit(lat, lon):
    a, o = math.radians(lat), math.radians(lon)
    return np.array([math.cos(a) * math.cos(o), math.cos(a) * math.sin(o), math.sin(a)])


def plane(lat, lon, bearing):
    """Normal of the great circle from a place along a bearing."""
    a, o, b = map(math.radians, (lat, lon, bearing))
    north = np.array([-math.sin(a) * math.cos(o), -math.sin(a) * math.sin(o), math.cos(a)])
    east = np.array([-math.sin(o), math.cos(o), 0])
    return np.cross(unit(lat, lon), north * math.cos(b) + east * math.sin(b))


@pytest.mark.parametrize("p", [(51.885, 0.235, 108.547, 49.008, 2.549, 32.435), (35.7, 51.3, 40, 35.7, 51.4, 320), (10, 10, 100, 12, 14, 190)])
def test_great_circle_crossing(spark, p):
    got = value(spark, geo.great_circle_crossing(*p))
    both = np.cross(plane(*p[:3]), plane(*p[3:]))
    both /= np.linalg.norm(both)
    assert min(np.linalg.norm(unit(got.lat, got.lon) - both), np.linalg.norm(unit(got.lat, got.lon) + both)) < 1e-7


def test_ambiguous_crossings_are_null(spark):
    assert value(spark, geo.great_circle_crossing(10, 10, 0, 10, 10, 90)) is None
    assert value(spark, geo.line_crossing(0, 0, 1, 1, 0, 1, 1, 2)) is None


def test_utm(spark):
    # known: the central meridian's easting is 500 km; one degree of latitude on it is k0 times the meridian arc
    p = value(spark, geo.utm(0, 51, 39))
    assert (p.easting, p.northing) == (pytest.approx(500_000, abs=1e-6), pytest.approx(0, abs=1e-6))
    q = value(spark, geo.utm(35.7, 51.4, 39))
    assert q.easting == pytest.approx(536_190, abs=60) and q.northing == pytest.approx(3_950_810, abs=250)
    r = value(spark, geo.utm(45, 51, 39))
    assert r.northing == pytest.approx(0.9996 * 4984944.378, abs=0.01)  # meridian arc to 45 degrees


def test_projection_of_a_point(spark):
    f = value(spark, geo.clamped(geo.segment_fraction(2.0, 5.0, 0.0, 0.0, 4.0, 0.0)))
    assert f == 0.5
    assert value(spark, geo.clamped(geo.segment_fraction(9.0, 5.0, 0.0, 0.0, 4.0, 0.0))) == 1.0
    assert value(spark, geo.segment_fraction(9.0, 5.0, 1.0, 1.0, 1.0, 1.0)) == 0.0


@pytest.mark.parametrize("x, y", [(51.3822, 35.7384), (-87.6874, 41.8619), (0.5, -33.25), (51.32, 35.7185), (0.0, -0.0), (5e-324, 1.7976931348623157e308)])
def test_wkb(spark, x, y):
    import struct

    little = (b"\x01" + struct.pack("<Idd", 1, x, y)).hex()
    big = (b"\x00" + struct.pack(">Idd", 1, x, y)).hex().upper()
    for text in (little, big):
        got = value(spark, codec.wkb_point(F.lit(text)))
        assert (got.x, got.y) == (x, y)
    assert value(spark, codec.wkb_point(F.lit("0102"))) is None


def test_lists_and_times(spark):
    assert value(spark, codec.numbers(F.lit("1, 2.5,3"))) == [1.0, 2.5, 3.0]
    assert value(spark, codec.numbers(F.lit(" "))) == []
    assert value(spark, codec.seconds_of_day(F.lit(-1_000_000))) == 86_399
    assert value(spark, codec.box_name(F.lit(35.7), F.lit(51.3), F.lit(-35.7), F.lit(51.4))) == "35_51_-36_51"


def test_grid_and_kernel():
    assert raster.grid_size((35.7185, 51.32, 35.7384, 51.3822), 1.0) == (5613, 2212)
    k = raster.kernel()
    assert k[8] == pytest.approx(0.138011, abs=1e-6) and k[0] == k[16] == pytest.approx(0.003072, abs=1e-6) and sum(k) == pytest.approx(1)


def test_share_threshold(spark):
    df = spark.createDataFrame([(float(v),) for v in range(100)], "v double")
    assert stats.share_threshold(df, "v", 0.5, 10).first().threshold == 49
    assert stats.share_threshold(df.where("v < 0"), "v", 0.5, 10).first().threshold is None
