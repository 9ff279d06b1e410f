"""Sources in memory and as text, and the faults of metadata operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.functions.dtypes import TYPES, result_dtype
from lumenfold.functions.registry import BandFunction, Registry
from lumenfold.operators import matching, pca, raster, roi
from lumenfold.operators.bandmath import BandMathError, evaluate
from lumenfold.plans import metadata_queries
from lumenfold.sources import arrays, ascii_grid

GRID = "ncols 3\nNROWS 2\nxllcorner 100\nyllcenter 205\ncellsize 10\nNODATA_value -9999\n1 2 3\n4 -9999 nan\n"


def test_ascii_grid(spark, tmp_path):
    (tmp_path / "a.asc").write_text(GRID)
    (tmp_path / "b.txt").write_text("not a grid")
    got = {(r["y"], r["x"]): r["value"] for r in ascii_grid.read_grid(spark, str(tmp_path)).collect()}
    assert got == {(0, 0): 1.0, (0, 1): 2.0, (0, 2): 3.0, (1, 0): 4.0, (1, 1): None, (1, 2): None}
    info = ascii_grid.read_info(spark, str(tmp_path)).first()
    assert (info["width"], info["height"], info["ignore_value"], info["gt"]) == (3, 2, -9999.0, [100.0, 10.0, 0.0, 220.0, 0.0, -10.0])


def test_short_grid_raises(spark, tmp_path):
    (tmp_path / "a.asc").write_text(GRID.replace("4 -9999 nan", "4"))
    with pytest.raises(Exception, match="values that its header tells"):
        ascii_grid.read_grid(spark, str(tmp_path)).collect()


def test_arrays(spark):
    values = np.ma.MaskedArray(np.arange(12.0).reshape(2, 2, 3), mask=False)
    values[1, 0, 2] = np.ma.masked
    pixels, bands, ignore = arrays.from_array(spark, values)
    got = {(r["y"], r["x"]): r["spectrum"] for r in pixels.collect()}
    assert got[0, 2] == [2.0, None] and got[1, 1] == [4.0, 10.0] and len(got) == 6
    assert ignore == 8.0 and [tuple(r) for r in bands.orderBy("band").collect()] == [(0, True), (1, True)]
    assert arrays.from_array(spark, np.ones((2, 2)))[2] is None


def test_result_types():
    for a in TYPES:
        for b in TYPES:
            assert result_dtype(a, b) == (np.zeros(1, a) + np.zeros(1, b)).dtype.name
    assert result_dtype("int16", "int16", "compare") == "bool"
    assert [result_dtype(t, operation="trig") for t in ("uint8", "float64")] == ["float32", "float64"]
    assert result_dtype(None, "int16") == "int16"
    with pytest.raises(ValueError):
        result_dtype("int16", "int16", "other")


def test_subset_must_be_exact(spark):
    bands = spark.createDataFrame([(1, b, 400.0 + b) for b in range(5)], "ds_id long, band int, wavelength double")
    assert [(r["band"], r["wavelength"], r["first"], r["size"]) for r in raster.exact_subset(bands, 403.0, 401.0).orderBy("band").collect()] == [(0, 401.0, 1, 3), (1, 402.0, 1, 3), (2, 403.0, 1, 3)]
    with pytest.raises(Exception, match="exactly"):
        raster.exact_subset(bands, 400.5, 403.0).collect()
    shown = [raster.moved_display(F.lit([3, 1, 2]), F.lit(1), F.lit(n)).alias(f"n{n}") for n in (3, 2, 0)]
    assert list(spark.range(1).select(*shown).first()) == [[2, 0, 1], [0, 1], []]


def test_components_of_good_bands(spark):
    """Large raw values, a bad band, an absent pixel; a pixel that lacks a good band raises."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 4)) * [3, 2, 1, 0.5] + 1e7
    rows = [(i, 0, [float(v) if b != 2 else None for b, v in enumerate(r)]) for i, r in enumerate(x)]
    cube = spark.createDataFrame([*rows, (99, 0, [None] * 4), (98, 0, None)], "y int, x int, spectrum array<double>")
    good = [True, True, False, True]
    model = pca.fit(cube, 2, good=good)
    centred = x[:, good] - x[:, good].mean(0)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    vt *= np.sign(vt[np.arange(3), np.abs(vt).argmax(1)])[:, None]
    assert model.count == 50 and model.variance == pytest.approx(s[:2] ** 2 / 49, rel=1e-6)
    got = {r["y"]: r["spectrum"] for r in pca.transform(cube, model).collect()}
    assert np.array([got[i] for i in range(50)]) == pytest.approx(centred @ vt[:2].T, abs=1e-5)
    with pytest.raises(Exception, match="some bands only"):
        pca.fit(cube.union(spark.createDataFrame([(97, 0, [1.0, None, 1.0, 1.0])], cube.schema)), 2, good=good)
    with pytest.raises(ValueError, match="no pixel"):
        pca.fit(cube.limit(0), 2)


def test_arguments_by_name_and_plugins(spark):
    own = Registry(less=BandFunction(lambda a, b: a - b, 2, params=("a", "b")))
    value = lambda text: spark.range(1).select(evaluate(text, {}, own)[1].alias("v")).first()["v"]
    assert [value(t) for t in ("less(b = 1, a = 5)", "less(5, b = 1)", "less(5, 1)")] == [4.0, 4.0, 4.0]
    with pytest.raises(BandMathError):
        value("less(5, a = 1)")
    with pytest.warns(UserWarning, match="passed over"):
        own.plug_in("no.such.plugin")
    own.plug_in(f"{metadata_queries.__name__}.example_plugin")
    with pytest.warns(UserWarning, match="takes the place"):
        own.plug_in(f"{metadata_queries.__name__}.example_plugin")
    assert value("bump(x = 3)") == 10.0


def test_unreadable_selections_and_missing_scores(spark):
    rows = spark.createDataFrame([(1, None), (2, "{"), (3, '{"type": "RECTANGLE", "point1": [2, 2], "point2": [2, 9]}'), (4, '{"type": "POLYGON", "points": [[0, 0], [4, 4]]}'), (5, '{"type": "SINGLE_PIXEL", "pixel": [7, 8]}')], "roi_id long, json string")
    assert [tuple(r) for r in roi.selection_pixels(rows).collect()] == [(5, 7, 8)]
    matches = spark.createDataFrame([(0, 0, 2, None, False), (0, 0, 1, 3.5, True)], "y int, x int, ref_id long, score double, is_match boolean")
    assert matching.as_cube(matches, missing=-1.0).first()["spectrum"] == [3.5, -1.0]
    assert matching.as_cube(matches, "is_match").first()["spectrum"] == [1.0, 0.0]


def test_grids_of_many_splits(spark, tmp_path):
    """Values broken into lines anyhow, more than one split to a file, keys and values on lines of their own."""
    cells = [str(i) if i % 7 else "-9999" for i in range(60 * 50)]
    wrapped, at = [], 0
    while at < len(cells):
        wrapped.append((" " * (at % 3)) + " \t".join(cells[at : at + 1 + at % 37]) + ("\r\n" if at % 2 else "\n\n"))
        at += 1 + at % 37
    (tmp_path / "a.asc").write_bytes(("\n\nncols 60 nrows\n50\n\nNODATA_value\t-9999\ndx 2\ndy 4\n" + "".join(wrapped)).encode())
    (tmp_path / "b.asc").write_text("ncols 2\nnrows 1\n8 9")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert ascii_grid._lines(spark, str(tmp_path)).select("path", "start").distinct().count() > 9
        rows = ascii_grid.read_grid(spark, str(tmp_path)).collect()
        info = {r["path"][-5:]: (r["width"], r["height"], r["ignore_value"], r["gt"]) for r in ascii_grid.read_info(spark, str(tmp_path)).collect()}
        (tmp_path / "c.asc").write_text(" \n")
        with pytest.raises(Exception, match="values that its header tells"):
            ascii_grid.read_grid(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert {(r["y"], r["x"]): r["value"] for r in rows if r["path"].endswith("a.asc")} == {(i // 60, i % 60): float(i) if i % 7 else None for i in range(3000)}
    assert sorted((r["x"], r["value"]) for r in rows if r["path"].endswith("b.asc")) == [(0, 8.0), (1, 9.0)] and len(rows) == 3002
    assert info == {"a.asc": (60, 50, -9999.0, [0.0, 2.0, 0.0, 200.0, 0.0, -4.0]), "b.asc": (2, 1, None, [0.0, None, 0.0, None, 0.0, None])}
