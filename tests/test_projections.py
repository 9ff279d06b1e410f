"""Projections against published points and by going back, as arrays and as columns."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.operators.projection import BODIES, Projection, from_map_info, from_proj_string, pixel_to_latlon, utm

CLARKE = (6378206.4, 1 - math.sqrt(1 - 0.00676866))
WGS84 = (6378137.0, 1 / 298.257223563)
PLACES = [
    # the worked examples of a well-known manual of map projections: (projection, lon, lat, x, y, error)
    (Projection("tmerc", *CLARKE, lon0=-75, k0=0.9996), -73.5, 40.5, 127106.5, 4484124.4, 0.1),
    (Projection("stere", *CLARKE, lat0=40, lon0=-100, k0=0.9999), -90, 30, 971630.8, -1063049.3, 0.1),
    (Projection("stere", 6378388.0, 1 / 297, lat0=-90, lon0=-100, lat_ts=-71), 150, -75, -1540033.6, -560526.4, 0.5),
    (Projection("merc", *CLARKE, lon0=180), -75, 35, 11688673.7, 4139145.6, 0.1),
    # a quarter of a meridian, and one degree of the equator
    (Projection("eqc", *WGS84), 0, 90, 0, 10001965.729, 0.001),
    (Projection("eqc", *WGS84), 1, 0, 111319.4907932, 0, 0.001),
    (Projection("stere", 1.0, lat0=0), 90, 0, 2.0, 0.0, 1e-12),
    (Projection("tmerc", 1.0), 0, 60, 0.0, math.pi / 3, 1e-12),
]


@pytest.mark.parametrize("at", range(len(PLACES)))
def test_published_points(at):
    projection, lon, lat, x, y, error = PLACES[at]
    assert projection.forward(float(lon), float(lat)) == pytest.approx((x, y), abs=error)


def kinds():
    for a, f in (WGS84, (3396190.0, 1 / 169.894447223612), (1737400.0, 0.0)):
        yield Projection("longlat", a, f)
        yield Projection("eqc", a, f, lat0=10, lon0=140, lat_ts=35, x0=5, y0=-7)
        yield Projection("merc", a, f, lon0=-170, lat_ts=20)
        yield Projection("stere", a, f, lat0=90, lon0=30, lat_ts=70)
        yield Projection("stere", a, f, lat0=-90)
        yield Projection("stere", a, f, lat0=37, lon0=-100, k0=0.9)
        yield Projection("tmerc", a, f, lat0=-12, lon0=33, k0=0.9996, x0=500_000)


def test_there_and_back():
    for p in kinds():
        lon, lat = np.meshgrid(np.arange(-179.5, 180, 7.25), np.arange(-80.0, 81, 5.5))
        if p.kind == "tmerc":
            lon = p.lon0 + lon / 180 * 40  # the series hold around the meridian
        if p.kind == "stere":
            cos = np.sin(np.radians(lat)) * math.sin(math.radians(p.lat0)) + np.cos(np.radians(lat)) * math.cos(math.radians(p.lat0)) * np.cos(np.radians(lon - p.lon0))
            lon, lat = lon[cos > -0.9], lat[cos > -0.9]
        back = p.inverse(*p.forward(lon, lat))
        assert np.abs(back[1] - lat).max() < 1e-9, p
        turn = np.abs(back[0] - lon)
        assert np.minimum(turn, 360 - turn).max() < 1e-9, p


def test_columns_equal_arrays(spark):
    lon, lat = np.linspace(20.0, 46.0, 60), np.linspace(-70.0, 75.0, 60)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(lon, lat, strict=True)], "lon double, lat double").coalesce(1)
    for p in kinds():
        x, y = p.forward(F.col("lon"), F.col("lat"))
        rows = df.select(x.alias("x"), y.alias("y")).select("*", *(c.alias(n) for c, n in zip(p.inverse(F.col("x"), F.col("y")), ("lon", "lat"), strict=True))).collect()
        want = p.forward(lon, lat)
        for n, w in zip(("x", "y", "lon", "lat"), (*want, *p.inverse(*want)), strict=True):
            assert np.allclose([r[n] for r in rows], w, rtol=1e-12, atol=1e-9), (p, n)
    nothing = spark.createDataFrame([(None, 1.0)], "lon double, lat double").select(*utm(33).forward(F.col("lon"), F.col("lat"))).first()
    assert tuple(nothing) == (None, None)


def test_texts():
    for p in kinds():
        again = from_proj_string(p.proj_string())
        assert again.flattening == pytest.approx(p.flattening, abs=1e-15) and np.allclose(again.forward(31.0, 12.0), p.forward(31.0, 12.0), rtol=1e-9)
    assert from_proj_string("+proj=utm +zone=33 +south +datum=WGS84 +units=m") == utm(33, south=True)
    assert from_proj_string("+proj=longlat +R=1737400").a == 1737400
    assert from_map_info(["UTM", "1", "1", "500000", "4000000", "30", "30", "11", "North", "WGS-84", "units=Meters"]) == utm(11)
    assert from_map_info(["Geographic Lat/Lon", "1", "1", "-120", "35", "0.1", "0.1", "WGS-84"]).kind == "longlat"
    for text in ("+proj=lcc", "+proj=merc +ellps=nowhere", "+proj=merc +units=us-ft", ""):
        with pytest.raises(ValueError):
            from_proj_string(text)
    with pytest.raises(ValueError):
        from_map_info(["Arbitrary", "1", "1", "0", "0", "1", "1"])
    with pytest.raises(ValueError):
        utm(61)
    with pytest.raises(ValueError):
        Projection("stere", lat0=91)
    assert all(a > 0 for a, _ in BODIES.values())


def test_pixels():
    zone = utm(11)
    gt = [500_000.0, 30.0, 0.0, 4_000_000.0, 0.0, -30.0]
    lat, lon = pixel_to_latlon(np.array([0.0, 100.0]), np.array([0.0, 50.0]), gt, zone)
    assert lon[0] == pytest.approx(-117) and lat[0] == pytest.approx(36.1443, abs=1e-3)
    assert zone.forward(lon, lat)[0] == pytest.approx([500_000, 503_000])
