import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.operators.bandmath import BandMathError
from lumenfold.sources import envi, folder, gcp, geojson, spectra_text
from lumenfold.streaming.folder_stream import evaluate_stream, watch

HEADER = "ENVI\ndescription = {a\n b}\nsamples = 3\nlines = 2\nbands = 2\nheader offset = 0\ndata type = {t}\ninterleave = {i}\nbyte order = {o}\ndata ignore value = -9999\nwavelength units = Nanometers\nwavelength = { 450.5, 550 }\nbbl = {1, 1}\n"


@pytest.mark.parametrize(("kind", "interleave", "order"), [(4, "bsq", 0), (2, "bil", 1), (12, "bip", 0), (5, "bsq", 1)])
def test_envi_rasters(spark, tmp_path, kind, interleave, order):
    x = np.arange(12).reshape(2, 3, 2)
    axes = {"bsq": (2, 0, 1), "bil": (0, 2, 1), "bip": (0, 1, 2)}[interleave]
    dtype = np.dtype(envi.TYPES[kind]).newbyteorder(">" if order else "<")
    (tmp_path / "a.img").write_bytes(x.transpose(axes).astype(dtype).tobytes())
    (tmp_path / "a.hdr").write_text(HEADER.replace("{t}", str(kind)).replace("{i}", interleave).replace("{o}", str(order)))
    got = {(r["y"], r["x"]): r["spectrum"] for r in envi.read_raster(spark, str(tmp_path)).collect()}
    assert got == {(y, c): x[y, c].tolist() for y in range(2) for c in range(3)}
    assert [(r["band"], r["wavelength"], r["good"]) for r in envi.read_bands(spark, str(tmp_path)).orderBy("band").collect()] == [(0, 450.5, True), (1, 550.0, True)]


def test_envi_round_trip_with_missing(spark, tmp_path):
    cube = spark.createDataFrame([(y, x, [float(y), None if x == 1 else 2.5]) for y in range(5) for x in range(3)], "y int, x int, spectrum array<double>")
    for r in envi.encode_blocks(cube, 3, 2).collect():
        (tmp_path / f"b{r['block']}.hdr").write_text(r["header"])
        (tmp_path / f"b{r['block']}.img").write_bytes(r["data"])
    back = envi.read_raster(spark, str(tmp_path)).select("y", "x", "spectrum")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, cube.collect()))
    assert envi.ignore_value_for("u1") == 0 and envi.ignore_value_for("i2") == -9999


@pytest.mark.parametrize("interleave", ["bsq", "bil", "bip"])
def test_envi_by_blocks(spark, tmp_path, interleave):
    """Blocks of one line each; a crop, some bands, a missing pixel and line, and the metadata that go with them."""
    head = {
        "samples": 4, "lines": 7, "bands": 3, "wavelength": [400, 500, 600], "bbl": [1, 1, 1], "default bands": [3, 1, 3],
        "map info": ["UTM", "1.0", "1.0", "1000", "2000", "30", "30"], "data ignore value": -1,
    }
    x = np.arange(84.0).reshape(7, 4, 3)
    rows = [(y, c, x[y, c].tolist()) for y in range(7) for c in range(4) if y != 3 and (y, c) != (1, 1)]
    cube = spark.createDataFrame(rows, "y int, x int, spectrum array<double>")
    at = str(tmp_path / "a b+c")
    files = envi.write_raster(cube, at, "r", head, left=1, top=1, width=2, height=5, include=[True, False, True], interleave=interleave, kind=2, size=40)
    assert [(r["block"], r["lines"]) for r in files.collect()] == [(b, 1) for b in range(5)]
    back = {(r["y"], r["x"]): r["spectrum"] for r in envi.read_raster(spark, at, size=10).collect()}
    want = {(y - 1, c - 1): [None, None] if y == 3 or (y, c) == (1, 1) else x[y, c, [0, 2]].tolist() for y in range(1, 6) for c in (1, 2)}
    assert back == want
    only = envi.read_raster(spark, at, bands=[1]).where("y = 3").collect()
    assert sorted(r["spectrum"] for r in only) == [[want[3, 0][1]], [want[3, 1][1]]]
    read = envi.parse_header((tmp_path / "a b+c" / "r_000002.hdr").read_text())
    assert read["wavelength"] == ["400", "600"] and read["default bands"] == ["2", "1", "2"] and read["y start"] == "3"
    assert [float(v) for v in read["map info"][1:3]] == [-0.0, -2.0]  # line 3 of the source is line 1 here


def test_envi_lines_and_faults(spark, tmp_path):
    (tmp_path / "a.img").write_bytes(np.arange(12, dtype="<i2").tobytes())
    head = {"samples": 2, "lines": 3, "bands": 2, "data type": 2, "interleave": "bip"}
    (tmp_path / "a.hdr").write_text(envi.write_header(head))
    got = envi.read_raster(spark, str(tmp_path), lines=(1, 2)).orderBy("y", "x").collect()
    assert [(r["y"], r["x"], r["spectrum"]) for r in got] == [(1, 0, [4.0, 5.0]), (1, 1, [6.0, 7.0])]
    with pytest.raises(ValueError, match="too few"):
        envi.line_blocks(head, 20, 100)
    with pytest.raises(ValueError, match="fit"):
        envi.subset_header(head, left=1, width=2)
    assert envi.subset_header(head | {"default bands": [2]}, include=[True, False])["default bands"] == [1]
    assert envi.result_header(head | {"bbl": [1, 1]}, "band") == head | {"bands": 1}


def test_spectral_library(spark, tmp_path):
    head, data = envi.encode_raster(np.arange(6.0).reshape(2, 3, 1), {"wavelength units": "Micrometers", "wavelength": [0.4, 0.5, 0.6], "spectra names": ["a", "b"]})
    (tmp_path / "lib.hdr").write_text(head)
    (tmp_path / "lib.sli").write_bytes(data)
    rows = envi.read_library(spark, str(tmp_path)).orderBy("spec_id").collect()
    assert [(r["name"], r["values"]) for r in rows] == [("a", [0.0, 1.0, 2.0]), ("b", [3.0, 4.0, 5.0])]
    assert rows[0]["wavelengths"] == pytest.approx([400, 500, 600])


def test_not_a_header():
    with pytest.raises(ValueError):
        envi.parse_header("something else")


@pytest.mark.parametrize(("layout", "content", "want"), [
    ("first", "w,a,b\n1,10,20\n2,30,-1\n", [("a", [1.0, 2.0], [10.0, 30.0]), ("b", [1.0, 2.0], [20.0, None])]),
    ("none", "a,b\n10,20\n30,40\n", [("a", [None, None], [10.0, 30.0]), ("b", [None, None], [20.0, 40.0])]),
    ("odd", "w,a,w,b\n1,10,5,20\n2,30,,\n", [("a", [1.0, 2.0], [10.0, 30.0]), ("b", [5.0], [20.0])]),
])
def test_spectra_from_text(spark, tmp_path, layout, content, want):
    (tmp_path / "s.csv").write_text(content)
    rows = spectra_text.import_spectra(spectra_text.read_lines(spark, str(tmp_path)), layout=layout, ignore=-1.0).orderBy("column").collect()
    assert [(r["name"], r["wavelengths"], r["values"]) for r in rows] == want


def test_spectra_to_text(spark):
    rows = [(2, "a", "nm", [1.0, 2.0], [3.0, None]), (1, "a", "um", [0.5], [1e-5]), (0, "z", None, None, [4.0, 1e16])]
    df = spark.createDataFrame(rows, "position int, name string, unit string, wavelengths array<double>, values array<double>")
    assert [r["text"] for r in spectra_text.export_spectra(df).collect()] == ["Band\tz\tWavelength (um)\ta\tWavelength (nm)\ta", "0\t4.0\t0.5\t1e-05\t1.0\t3.0", "1\t1e+16\t9999\t9999\t2.0\tNaN"]


def test_wavelength_lists(spark, tmp_path):
    (tmp_path / "w.csv").write_text("band,nm\n1,400\n2,410\n")
    lines = spectra_text.read_lines(spark, str(tmp_path / "w.csv"))
    assert spectra_text.import_wavelengths(lines, 1, "column") == [400.0, 410.0]


def test_geojson_round_trip(spark, tmp_path):
    rows = [("r", "Point", [[1.0, 2.0]]), ("r", "Rectangle", [[0.0, 0.0], [2.0, 0.0], [2.0, 3.0], [0.0, 3.0]]), ('q"', "Polygon", [[0.0, 0.0], [2.0, 1.0], [1.0, 3.0]]), ("m", "MultiPoint", [[1.0, 1.0], [2.0, 2.0]])]
    df = spark.createDataFrame(rows, "name string, type string, points array<array<double>>")
    geojson.write_rois(df).write.option("maxRecordsPerFile", 1).text(str(tmp_path / "out"))
    assert sorted(map(tuple, geojson.read_rois(spark, str(tmp_path / "out")).collect())) == sorted(rows)


def test_control_points(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 2.0, 3.5, 4.5), (5.0, 6.0, 7.5, 8.5)], gcp.POINTS)
    for name, write, read in (("q", gcp.qgis_lines, gcp.read_qgis), ("e", gcp.envi_lines, gcp.read_envi)):
        write(df).write.text(str(tmp_path / name))
        assert sorted(map(tuple, read(spark, str(tmp_path / name)).collect())) == sorted(map(tuple, df.collect()))


def test_batch_names(spark):
    df = spark.createDataFrame([("/d/a",), ("/d/a.img",), ("/d/b.c.img",)], "name string")
    assert sorted(map(tuple, folder.one_of_each(df).collect())) == [("a", "/d/a.img"), ("b.c", "/d/b.c.img")]
    assert df.select(folder.result_name(F.col("name"), "_out").alias("r")).first()["r"] == "a_out"


def test_stream(spark, tmp_path):
    cube = spark.createDataFrame([(1, 0, x, [float(x), 2.0]) for x in range(4)], "ds_id long, y int, x int, spectrum array<double>")
    cube.write.parquet(str(tmp_path / "in"))
    out = evaluate_stream("c * s + 1", watch(spark, str(tmp_path / "in"), "ds_id long, y int, x int, spectrum array<double>"), s=[2.0, 3.0])
    q = out.writeStream.format("memory").queryName("watched").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["spectrum"] for r in spark.table("watched").collect()) == [[1.0 + 2 * x, 7.0] for x in range(4)]
    with pytest.raises(BandMathError):
        evaluate_stream("c +", out)
