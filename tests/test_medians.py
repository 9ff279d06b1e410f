"""Medians and exports of any size against plain ones."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.operators import roi
from lumenfold.sources import spectra_text


def test_medians_equal_plain_ones(spark):
    rng = np.random.default_rng(3)
    groups = {
        0: rng.normal(size=501).tolist(), 1: rng.exponential(size=400).tolist(), 2: [2.0] * 7, 3: [1.0, 1.0, 5.0, 9.0], 4: [None, 3.0], 5: [None],
        6: [1e9, *rng.uniform(size=99).tolist()], 7: [-4.0, 4.0], 8: rng.integers(0, 5, 300).astype(float).tolist(),
    }
    rows = spark.createDataFrame([(g, v) for g, values in groups.items() for v in values], "g int, v double")
    for accuracy in (10, 100, 10_000):
        got = dict(map(tuple, roi.exact_medians(rows, ["g"], accuracy).collect()))
        want = {g: statistics.median(there) if (there := [v for v in values if v is not None]) else None for g, values in groups.items()}
        assert got == want
    assert roi.exact_medians(rows.limit(0), ["g"]).count() == 0


def test_pixels_as_columns(spark):
    rows = spark.createDataFrame([(x, y, b, None if (x, b) == (2, 1) else float(10 * x + b)) for x in (2, 1) for y in (5,) for b in (0, 1)], "x int, y int, band int, value double")
    assert [r["text"] for r in spectra_text.export_pixel_spectra(rows).collect()] == ["band\t(1 5)\t(2 5)", "0\t10.0\t20.0", "1\t11.0\tNaN"]


def test_an_empty_spectrum_in_an_export(spark):
    df = spark.createDataFrame([(1, "b", "nm", [1.0], [None]), (0, "a", None, None, [])], "position int, name string, unit string, wavelengths array<double>, values array<double>")
    assert [r["text"] for r in spectra_text.export_spectra(df).select(F.col("text")).collect()] == ["Band\ta\tWavelength (nm)\tb", "9999\t9999\t1.0\tNaN"]
    assert spectra_text.export_spectra(df.limit(0)).collect() == []


def test_outliers_do_not_matter(spark):
    """A few huge values beside many alike leave the middle where it is, and few values meet."""
    rng = random.Random(6)
    values = [rng.random() for _ in range(40_001)] + [1e300, -1e300, 1e12, float(2**60)]
    rows = spark.createDataFrame([(1, v) for v in values] + [(2, 5.0)] * 3000 + [(3, None)], "g int, v double").repartition(7)
    got = dict(map(tuple, roi.exact_medians(rows, ["g"]).collect()))
    assert got == {1: statistics.median(values), 2: 5.0, 3: None}


def test_listed_points(spark):
    cube = spark.createDataFrame([(0, 0, [1.0, 5.0]), (0, 1, [3.0, None]), (0, 2, [8.0, 1.0])], "y int, x int, spectrum array<double>")
    points = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (1, 0, 0), (2, 0, 0), (2, 2, 0), (3, 9, 9)], "roi_id long, x int, y int")
    told = lambda how: {(r["roi_id"], r["band"]): r["value"] for r in roi.points_spectrum(cube, points, how).collect()}
    assert told("mean") == {(1, 0): pytest.approx(5 / 3), (1, 1): None, (2, 0): 4.5, (2, 1): 3.0}
    assert told("median") == {(1, 0): 1.0, (1, 1): None, (2, 0): 4.5, (2, 1): 3.0}


def test_medians_of_counted_values(spark):
    rng = random.Random(8)
    groups = {0: [(rng.random(), rng.randint(1, 900)) for _ in range(300)], 1: [(1.0, 5), (2.0, 5)], 2: [(1.0, 1), (3.0, 1_000_000), (9.0, 2)], 3: [(None, 7)], 4: [(None, 7), (4.0, 1)], 5: [(7.0, 3), (7.0, 2), (-1.0, 5)], 6: [(float(v % 9), 1 + v % 3) for v in range(99)]}
    rows = spark.createDataFrame([(g, v, n) for g, own in groups.items() for v, n in own], "g int, v double, _c long")
    want = {g: statistics.median(there) if (there := [v for v, n in own for _ in range(n) if v is not None]) else None for g, own in groups.items()}
    for parts, accuracy in ((64, 1000), (4, 10), (1, 10)):
        assert dict(map(tuple, roi.counted_medians(rows, ["g"], parts, accuracy).collect())) == want
    assert roi.counted_medians(rows.limit(0), ["g"]).count() == 0


def test_points_are_counted_before_they_meet_the_cube(spark, monkeypatch):
    """A point that is listed often makes no more rows of bands than one listed once."""
    cube = spark.createDataFrame([(0, x, [float(x), 2.0 * x]) for x in range(3)], "y int, x int, spectrum array<double>")
    points = spark.range(30_000).selectExpr("id % 2 AS roi_id", "int(id % 3) AS x", "0 AS y")
    met, plain = [], roi.counted_medians
    monkeypatch.setattr(roi, "counted_medians", lambda rows, keys: met.append(rows.count()) or plain(rows, keys))
    for how in ("mean", "median"):
        found = roi.points_spectrum(cube, points, how).collect()
        assert {(r["roi_id"], r["band"]): r["value"] for r in found} == {(i, b): b + 1.0 for i in (0, 1) for b in (0, 1)}
    assert met == [12]
