"""Types and headers of results, and results as files."""

import numpy as np
import pytest

from lumenfold.operators.bandmath import BandMathError, Image, compute, evaluate, stored_as
from lumenfold.sources.rasters import open_raster, read_rasters
from pyspark.sql import functions as F


def cube(spark, dtype=None, header=None):
    rows = [(y, x, [float(10 * y + x), float(y - x)]) for y in range(3) for x in range(4)]
    return Image("cube", spark.createDataFrame(rows, "y int, x int, spectrum array<double>"), ("y", "x"), 2, dtype, header)


def band(spark, dtype=None):
    return Image("band", spark.createDataFrame([(y, x, float(y * x)) for y in range(3) for x in range(4)], "y int, x int, value double"), ("y", "x"), None, dtype)


@pytest.mark.parametrize("text,dtype", [
    ("a + a", "int16"), ("a * b", "float32"), ("a + u", "int32"), ("a + 0.5", "int16"), ("0.5 * a", "int16"), ("a / a", "int16"), ("a > 3", "int8"),
    ("sin(a)", "float32"), ("sin(d)", "float64"), ("arctan2(b, a)", "float32"), ("a + s", "float64"), ("m + a", "int32"), ("m * 2", "uint8"), ("m + n", "uint8"), ("n + m", "int16"),
    ("dotprod(a, s)", "float64"), ("dotprod(b, b)", "float32"), ("-a", "int16"), ("a ** 2", "int16"), ("x + a", "int16"), ("x", None), ("m < 2", "int8"), ("(a > 3) + (b > 3)", "int8"),
])
def test_types(spark, text, dtype):
    names = {"a": cube(spark, "int16"), "b": cube(spark, "float32"), "u": cube(spark, "uint16"), "d": cube(spark, "float64"), "x": cube(spark), "m": band(spark, "uint8"), "n": band(spark, "int16"), "s": [1.0, 2.0]}
    if text == "m + a":
        names["m"] = band(spark, "int32")
    assert compute(text, names).dtype == dtype


def test_values_in_their_type(spark):
    found = compute("a * 1.5", {"a": cube(spark, "int16")}).typed()
    assert found.schema["spectrum"].dataType.simpleString() == "array<smallint>"
    got = {(r["y"], r["x"]): r["spectrum"] for r in found.collect()}
    assert got == {(y, x): [int((10 * y + x) * 1.5), int((y - x) * 1.5)] for y in range(3) for x in range(4)}
    assert compute("m / 2", {"m": band(spark, "float32")}).typed().schema["value"].dataType.simpleString() == "float"
    assert compute("x + 1", {"x": cube(spark)}).typed().schema["spectrum"].dataType.simpleString() == "array<double>"
    rows = spark.createDataFrame([(v,) for v in (-1.0, -0.5, 0.0, 255.9, 256.0, 1e30, float("nan"), None)], "v double")
    assert [r[0] for r in rows.select(stored_as(F.col("v"), "uint8")).collect()] == [None, 0, 0, 255, None, None, None, None]
    assert [r[0] for r in rows.limit(3).select(stored_as(F.col("v"), "int8")).collect()] == [-1, 0, 0]


def test_saved_with_what_is_known(spark, tmp_path):
    header = {"samples": 4, "lines": 3, "bands": 2, "wavelength": [500.0, 600.0], "wavelength units": "nm", "bbl": [1, 1], "band names": ["p", "q"], "map info": ["Arbitrary", 1, 1, 100, 50, 2, 2]}
    names = {"a": cube(spark, "int16", header), "b": cube(spark, "float32")}
    found = compute("b * 0 + a * 2", names)
    assert found.header is None  # the first image of the highest kind tells it
    found = compute("a * 2 + b * 0", names)
    assert found.header["wavelength"] == [500.0, 600.0] and found.dtype == "float32"
    found.save(f"{tmp_path}/cube.img")
    raster = open_raster(f"{tmp_path}/cube.img")
    assert (raster.wavelengths, raster.unit, raster.names, raster.gt, raster.kind) == ((500.0, 600.0), "nm", ("p", "q"), (100.0, 2.0, 0.0, 50.0, 0.0, -2.0), "<f4")
    got = {(r["y"], r["x"]): r["spectrum"] for r in read_rasters(spark, str(tmp_path)).collect()}
    assert got == {(y, x): [2.0 * (10 * y + x), 2.0 * (y - x)] for y in range(3) for x in range(4)}
    mask = compute("dotprod(a, s) > 10", names | {"s": [1.0, 0.0]})
    assert (mask.kind, mask.dtype, mask.header["bands"]) == ("band", "int8", 1) and "wavelength" not in mask.header
    mask.save(f"{tmp_path}/band/mask.tif", "gtiff")
    got = {(r["y"], r["x"]): r["spectrum"] for r in read_rasters(spark, f"{tmp_path}/band").collect()}
    assert got == {(y, x): [float(10 * y + x > 10)] for y in range(3) for x in range(4)}
    for text in ("1 + 1", "s"):
        with pytest.raises(BandMathError):
            compute(text, {"s": [1.0]}).save(f"{tmp_path}/no.img")
    with pytest.raises(BandMathError):
        compute("a", {"a": cube(spark)}).save(f"{tmp_path}/no.img")
    assert evaluate("1 + 1", {})[0] == "number" and np.dtype("int16").name == "int16"
