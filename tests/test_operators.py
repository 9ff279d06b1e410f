import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.functions import text, units
from lumenfold.operators import continuum, geo, matching, pca, raster, roi


def test_hull_is_the_highest_chord():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 12, 40):
        x, y = np.cumsum(rng.uniform(0.5, 2, n)), rng.uniform(0.1, 1, n)
        chord = [max(y[j] if i == k else y[i] + (y[k] - y[i]) * (x[j] - x[i]) / (x[k] - x[i]) for i in range(j + 1) for k in range(j, n) if i < k or i == j) for j in range(n)]
        assert continuum.hull_values(x, y) == pytest.approx(chord)


def test_continuum_of_missing_and_zero():
    removed, hull = continuum.remove(np.array([1.0, 2, 3, 4]), np.array([1.0, np.nan, 0.5, 1.0]))
    assert np.isnan(removed[1]) and removed[[0, 2, 3]] == pytest.approx([1, 0.5, 1])
    assert (continuum.remove(np.array([1.0, 2]), np.zeros(2))[0] == 1).all()


def angle(spark, t, r, mode="spectrum"):
    floats = [[None if v is None else float(v) for v in x] for x in (t, r)]
    df = spark.createDataFrame([tuple(floats)], "t array<double>, r array<double>")
    f = matching.angle_of_spectrum if mode == "spectrum" else matching.angle_of_pixel
    return df.select(f(F.col("t"), F.col("r")).alias("a")).first()["a"]


def test_angles(spark):
    assert angle(spark, [100.0, 200, 300, 400, 500], [0.1, 0.2, 0.3, 0.4, 0.5]) == pytest.approx(0, abs=1e-5)
    assert angle(spark, [float("nan"), 200.0, 300, 400, 500], [0.1, 0.2, 0.3, 0.4, None]) == pytest.approx(0, abs=1e-5)
    assert angle(spark, [1.0, 2, None], [1.0, 2, 3]) is None  # two common bands
    assert angle(spark, [0.0, 0, 0], [1.0, 2, 3]) == 90
    assert angle(spark, [0.0, 0, 0], [1.0, 2, 3], "image") is None
    assert angle(spark, [1.0, 0, 0], [0.0, 1, 0], "image") == pytest.approx(90)


def test_feature_fit_scales(spark):
    w = [1.0, 2, 3, 4, 5]
    ref = [1.0, 0.8, 0.6, 0.8, 1.0]
    half = [1 - (1 - v) / 2 for v in ref]
    pixels = spark.createDataFrame([(0, 0, half)], "y int, x int, spectrum array<double>")
    refs = spark.createDataFrame([(7, ref)], "ref_id long, ref array<double>")
    row = matching.sff(pixels, refs, w).first()
    assert (row["ref_id"], row["scale"], row["score"], row["is_match"]) == (7, pytest.approx(0.5), pytest.approx(0, abs=1e-9), True)


def test_resampling(spark):
    refs = spark.createDataFrame([(1, w, 2 * w) for w in (1.0, 2.0, 4.0)], "ref_id long, wavelength double, value double")
    grid = spark.createDataFrame([(0, 0.5), (1, 1.0), (2, 3.0), (3, 4.0), (4, 5.0)], "band int, wavelength double")
    assert dict(r[1:] for r in matching.resample(refs, grid).collect()) == {1: 2.0, 2: 6.0, 3: 8.0}
    assert dict(r[1:] for r in matching.resample(refs, grid, extrapolate=True).collect()) == {0: 1.0, 1: 2.0, 2: 6.0, 3: 8.0, 4: 10.0}


def test_components_equal_numpy(spark):
    x = np.random.default_rng(0).normal(size=(60, 5)) @ np.diag([5, 3, 2, 1, 0.5])
    rows = [(i // 10, i % 10, [float(v) for v in r]) for i, r in enumerate(x)] + [(9, 9, [None] * 5)]
    cube = spark.createDataFrame(rows, "y int, x int, spectrum array<double>")
    model = pca.fit(cube, 3)
    centred = x - x.mean(0)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    vt *= np.sign(vt[np.arange(5), np.abs(vt).argmax(1)])[:, None]
    assert model.variance == pytest.approx(s[:3] ** 2 / 59)
    got = {(r["y"], r["x"]): r["spectrum"] for r in pca.transform(cube, model).collect()}
    assert np.array([got[i // 10, i % 10] for i in range(60)]) == pytest.approx(centred @ vt[:3].T)
    assert got[9, 9] == [None] * 3


def test_units(spark):
    rows = [(1.0, "um", 1000.0), (2.0, "cm", 2e7), (10000.0, "1/cm", 1000.0), (299792.458, "GHz", 1000.0), (5000.0, "Angstroms", 500.0), (1.0, "parsec", None), (0.0, "mhz", None)]
    df = spark.createDataFrame(rows, "v double, u string, nm double")
    assert [r["x"] for r in df.select(units.to_nm(F.col("v"), F.col("u")).alias("x")).collect()] == [pytest.approx(r[2]) if r[2] else None for r in rows]
    assert spark.range(1).select(units.convert(F.lit(1.0), F.lit("um"), F.lit("1/cm")).alias("x")).first()["x"] == pytest.approx(10000)


def test_coordinates(spark):
    rows = ["12 30 36 S", "12", "12° 30' N", "abc", "1 2 3 4", "-5.5E", None]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    assert [r["v"] for r in df.select(text.parse_dms(F.col("t")).alias("v")).collect()] == [pytest.approx(-12.51), 12.0, 12.5, None, None, -5.5, None]
    assert [r["v"] for r in df.select(text.parse_northing_easting(F.col("t")).alias("v")).collect()][:2] == [None, 12.0]


def test_masks_windows_and_nearest(spark):
    cube = spark.createDataFrame([(0, 0, [1.0, -9999.0001, float("nan"), 4.0])], "y int, x int, spectrum array<double>")
    assert cube.select(raster.mask_values(F.col("spectrum"), -9999.0, [True, True, True, False]).alias("s")).first()["s"] == [1.0, None, None, None]
    bands = spark.createDataFrame([(0, 450.0), (1, 460.0), (2, 470.0)], "band int, wavelength double")
    wanted = spark.createDataFrame([(455.0,), (471.0,), (700.0,)], "target double")
    assert sorted((r["target"], r["band"]) for r in raster.nearest_band(bands, wanted).collect()) == [(455.0, 0), (471.0, 2)]
    assert raster.display_bands(bands) == [0, 1, 2]
    with pytest.raises(ValueError):
        raster.spectrum_at(cube, 0, 0, 2, 3)


def test_regions(spark):
    grid = spark.range(100).selectExpr("int(id % 10) AS x", "int(id div 10) AS y")
    square = roi.polygon_pixels(grid, 1, [(2, 2), (5, 2), (5, 5), (2, 5)], all_touched=False)
    assert {(r["x"], r["y"]) for r in square.collect()} == {(x, y) for x in (2, 3, 4) for y in (2, 3, 4)}
    assert [tuple(r) for r in roi.rectangles(square).collect()] == [(1, 2, 4, 2, 4)]
    touched = roi.polygon_pixels(grid, 1, [(2.2, 2.2), (2.3, 2.2), (2.3, 8.0)])
    assert touched.count() >= 6


def test_geometry(spark):
    gt = [100.0, 2.0, 0.5, 50.0, 0.1, -3.0]
    df = spark.createDataFrame([(7, 3)], "x int, y int")
    gx, gy = geo.to_geo(F.col("x"), F.col("y"), gt)
    back = df.select(*[c.alias(n) for c, n in zip(geo.to_pixel(gx, gy, gt), "xy", strict=True)]).first()
    assert tuple(back) == (7, 3)
    with pytest.raises(ValueError):
        geo.to_pixel(F.col("x"), F.col("y"), [0, 1, 1, 0, 1, 1])
    ids = "ds_id long, width int, height int, gt struct<gt0:double,gt1:double,gt2:double,gt3:double,gt4:double,gt5:double>, wkt string"
    a = spark.createDataFrame([(1, 10, 10, (0.0, 1.0, 0.0, 0.0, 0.0, 1.0), "A")], ids)
    b = spark.createDataFrame([(2, 10, 10, (90.0, 1.0, 0.0, 0.0, 0.0, 1.0), "A"), (3, 5, 9, (8.0, 1.0, 0.0, 8.0, 0.0, 1.0), "A"), (4, 5, 9, (8.0, 1.0, 0.0, 8.0, 0.0, 1.0), None), (5, 5, 9, (50.0, 1.0, 0.0, 8.0, 0.0, 1.0), "A")], ids)
    assert sorted(tuple(r) for r in geo.link_state(a, b, 16.0).collect()) == [(1, 2, "PIXEL"), (1, 3, "SPATIAL")]
    points = spark.createDataFrame([(float(i), float(j), 2.0 * i + j, i - 3.0 * j + 1) for i in range(3) for j in range(3)], "px double, py double, gx double, gy double")
    found, fitted = geo.fit_points(points)
    assert found == pytest.approx(np.array([[0, 2, 1], [1, 1, -3]]), abs=1e-9)
    assert fitted.agg(F.max("residual")).first()[0] == 0
    with pytest.raises(ValueError):
        geo.fit_points(points.limit(2))
    band = spark.createDataFrame([(y, x, float(10 * y + x)) for y in range(3) for x in range(4)], "y int, x int, value double")
    turned = {(r["y"], r["x"]): r["value"] for r in geo.rotate_bilinear(band, 0.0, 1.0, 4, 3).collect()}
    assert turned[1, 2] == 12.0
