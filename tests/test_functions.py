"""Hand-computed values of the column functions."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydropanel.functions import calendar, dist, geo, text, units


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_water_year_and_season_year(spark):
    days = [dt.date(2001, 9, 30), dt.date(2001, 10, 1), dt.date(2001, 12, 1), dt.date(2002, 1, 1)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    wy = calendar.water_year("d")
    season = calendar.season(F.month("d"))
    got = rows(df.select(wy, calendar.water_year("d", 8), season, calendar.season_year(season, F.year("d"), wy)))
    assert got == [
        (2001, 2002, "SON", 2001),
        (2002, 2002, "SON", 2001),
        (2002, 2002, "DJF", 2002),
        (2002, 2002, "DJF", 2002),
    ]


def test_dates(spark):
    df = spark.createDataFrame([("1980.10.01", 36526)], "t string, n int")
    got = df.select(calendar.parse_date("t", "yyyy.MM.dd"), calendar.excel_date("n"), calendar.parse_date(F.lit("x"))).first()
    assert tuple(got) == (dt.date(1980, 10, 1), dt.date(2000, 1, 1), None)
    assert rows(spark.range(1).select(calendar.years(1950, 1953), calendar.years(3, 1))) == [([1950, 1951, 1952, 1953], [])]


def test_month_depth(spark):
    df = spark.range(1, 13).select(calendar.month_depth(F.lit(1.0), F.col("id")).alias("d"))
    assert [r.d for r in df.orderBy("d").collect()] == [28] + [30] * 4 + [31] * 7


def test_ids_and_labels(spark):
    df = spark.createDataFrame([("1013500", 0.0), ("123456789", 98765.0)], "id string, v double")
    assert [r[0] for r in df.select(text.pad_id("id")).collect()] == ["01013500", "123456789"]
    assert [tuple(r) for r in df.select(text.sigfig("v", 2), text.sci("v", 2)).collect()] == [
        (0.0, "0.00e+00"),
        (99000.0, "9.88e+04"),
    ]
    got = spark.createDataFrame([(0.0001,), (0.04,), (0.2,), (None,)], "p double").select(
        text.p_label("p"), text.sig_label("p"), text.sci("p")
    )
    assert [tuple(r)[:2] for r in got.collect()] == [
        ("p<0.001", "Significant"), ("p=0.040", "Significant"), ("p=0.200", "Marginally"), (None, "Insignificant"),
    ]
    assert got.collect()[3][2] == " "
    assert spark.range(1).select(text.strip(F.lit("USGS-0101"), "USGS-")).first()[0] == "0101"


def test_units_and_guards(spark):
    one = spark.range(1)
    assert one.select(units.convert(F.lit(1.0), "ft3/s", "m3/s")).first()[0] == 0.028316846592
    assert one.select(units.runoff_ratio(F.lit(1.0), F.lit(2.0), F.lit(0.0))).first()[0] is None
    assert one.select(units.runoff_ratio(F.lit(1.0), F.lit(0.0), F.lit(1.0))).first()[0] is None
    assert one.select(units.log10_safe(F.lit(0.0)), units.log10_safe(F.lit(100.0))).first()[:] == (None, 2.0)
    assert one.select(units.rose_scale(F.lit(0.0)), units.rose_scale(F.lit(-0.1))).first()[:] == (0.0, 1.0)
    assert one.select(units.null_if_beyond(F.lit(-9999.0)), units.null_if_beyond(F.lit(5.0))).first()[:] == (None, 5.0)
    a, b = one.select(units.signed_share(F.lit(-1.0), F.lit(3.0)), units.signed_share(F.lit(3.0), F.lit(-1.0))).first()
    assert (a, b) == (-0.25, 0.75)


def test_tail_probabilities(spark):
    assert dist.t_tail([2.0], [10])[0] == pytest.approx(0.073388, abs=1e-6)
    # t with one degree of freedom is Cauchy; F with two numerator degrees has a closed form
    assert dist.t_tail([1.0], [1])[0] == pytest.approx(0.5, abs=1e-12)
    assert dist.f_tail([3.0], [2], [8])[0] == pytest.approx((1 + 6 / 8) ** -4, rel=1e-12)
    assert dist.f_tail([4.0], [1], [10])[0] == pytest.approx(dist.t_tail([2.0], [10])[0], rel=1e-12)
    assert dist.t_tail([60.0], [400])[0] < 1e-100
    assert np.isnan(dist.t_tail([1.0], [0])[0])
    got = spark.createDataFrame([(4.0, 10.0), (1.0, 0.0)], "f double, d double").select(
        dist.f_pvalue("f", F.lit(1.0), "d"), dist.t_pvalue(F.sqrt("f"), "d")
    )
    first, second = got.collect()
    assert first[0] == pytest.approx(0.073388, abs=1e-6) and first[1] == pytest.approx(first[0])
    assert tuple(second) == (None, None)


def test_projection_round_trip(spark):
    df = spark.createDataFrame([(-96.0, 40.0), (-120.5, 61.25), (-70.0, 25.0)], "lon double, lat double")
    x, y = geo.to_albers("lon", "lat")
    back = geo.from_albers("x", "y")
    got = df.withColumns({"x": x, "y": y}).select("lon", "lat", "x", "y", *back).collect()
    assert abs(got[0].x) < 1e-6 and abs(got[0].y) < 1e-6
    for r in got:
        assert r[4] == pytest.approx(r[0], abs=1e-7) and r[5] == pytest.approx(r[1], abs=1e-7)


def test_equal_area(spark):
    """Quarter-degree cells of one latitude band have the area of the band on the ellipsoid."""
    def corner(lon, lat):
        d = spark.createDataFrame([(lon, lat)], "lon double, lat double")
        return d.select(*geo.to_albers("lon", "lat")).first()

    def shoelace(p):
        return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1]))) / 2

    h = 0.01
    sizes = []
    for lon, lat in ((-100.0, 30.0), (-60.0, 60.0)):
        cell = [corner(lon, lat), corner(lon + h, lat), corner(lon + h, lat + h), corner(lon, lat + h)]
        e2 = geo.FLATTENING * (2 - geo.FLATTENING)
        s = math.sin(math.radians(lat + h / 2))
        m = geo.AXIS * (1 - e2) / (1 - e2 * s * s) ** 1.5
        n = geo.AXIS / math.sqrt(1 - e2 * s * s)
        true = m * n * math.cos(math.radians(lat + h / 2)) * math.radians(h) ** 2
        sizes.append(shoelace([tuple(c) for c in cell]) / true)
    assert sizes == pytest.approx([1.0, 1.0], rel=1e-5)


def test_point_in_ring(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0)]  # a notch in the top
    df = spark.createDataFrame(
        [(1.0, 1.0, ring), (2.0, 2.0, ring), (3.5, 3.0, ring), (5.0, 1.0, ring), (-1.0, 1.0, ring)],
        "x double, y double, r array<struct<lon:double,lat:double>>",
    )
    assert [r[0] for r in df.select(geo.in_ring("x", "y", "r")).collect()] == [True, False, True, False, False]
    closed = df.withColumn("r", F.concat("r", F.slice("r", 1, 1)))
    assert [r[0] for r in closed.select(geo.in_ring("x", "y", "r")).collect()] == [True, False, True, False, False]
