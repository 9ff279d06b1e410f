"""Raster formats: written, read back by ranges, and read from files that are put together by hand."""

import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.sources import datasource, fits, geotiff, netcdf, pds, rasters
from lumenfold.sources.envi import store

W, H, N = 13, 29, 5


def values(seed=1, kind="f4"):
    rng = np.random.default_rng(seed)
    return rng.standard_normal((H, W, N)).astype(kind) if kind[0] == "f" else rng.integers(0, 200, (H, W, N)).astype(kind)


def frame(spark, data):
    rows = [(y, x, [float(v) for v in data[y, x]]) for y in range(data.shape[0]) for x in range(data.shape[1]) if (y, x) != (3, 4) and y != 7]
    return spark.createDataFrame(rows, "y int, x int, spectrum array<double>").repartition(6)


def same(rows, data):
    got = {(r["y"], r["x"]): r["spectrum"] for r in rows}
    assert set(got) == {(y, x) for y in range(data.shape[0]) for x in range(data.shape[1])}
    for (y, x), s in got.items():
        if (y, x) == (3, 4) or y == 7:
            assert s == [None] * data.shape[2]
        else:
            assert s == [float(v) for v in data[y, x]]


CASES = [("envi", "bsq", "f4"), ("envi", "bil", "i2"), ("envi", "bip", "f8"), ("gtiff", "bsq", "f4"), ("gtiff", "bip", "u2"), ("fits", "bsq", "f8"), ("fits", "bsq", "i4"), ("netcdf", "bsq", "f4"), ("netcdf", "bip", "i2"), ("netcdf", "bil", "f8"), ("pds3", "bsq", "f4"), ("pds3", "bil", "u1"), ("pds4", "bip", "i4"), ("pds4", "bsq", "f8")]


@pytest.mark.parametrize("format,interleave,kind", CASES)
def test_round_trip(spark, tmp_path, format, interleave, kind):
    data = values(kind=kind)
    at = f"{tmp_path}/file.img"
    waves, gt = [400.0 + 10 * b for b in range(N)], [500.0, 2.0, 0.0, 900.0, 0.0, -2.0]
    ignore = 255.0 if kind == "u1" else 9999.0 if kind[0] == "u" else -9999.0
    datasource.write_file(frame(spark, data), at, format, lines=6, width=W, height=H, bands=N, kind=kind, interleave=interleave, ignore=ignore, wavelengths=waves, unit="nm", gt=gt)
    names = sorted(n for n in os.listdir(tmp_path) if not n.endswith(".crc"))
    assert names == {"envi": ["file.hdr", "file.img"], "pds4": ["file.img", "file.xml"]}.get(format, ["file.img"])
    whole = spark.read.format(format).option("blockbytes", 250).load(str(tmp_path))
    assert whole.rdd.getNumPartitions() > 5
    same(whole.collect(), data)
    same(rasters.read_rasters(spark, str(tmp_path), size=700).collect(), data)  # the format is found
    info = rasters.raster_info(spark, str(tmp_path)).first()
    assert (info["format"], info["width"], info["height"], info["bands"], info["ignore"]) == (format, W, H, N, [] if (format, kind[0]) == ("fits", "f") else [ignore])
    if format in ("envi", "gtiff", "netcdf", "fits"):
        assert info["gt"] == gt
    if format in ("envi", "netcdf", "fits", "pds3"):
        assert [r["wavelength"] for r in rasters.raster_bands(spark, str(tmp_path)).orderBy("band").collect()] == waves
    some = {(r["y"], r["x"]): r["spectrum"] for r in rasters.read_rasters(spark, str(tmp_path), bands=[4, 1], lines=(9, 12)).collect()}
    assert some == {(y, x): [float(data[y, x, 4]), float(data[y, x, 1])] for y in range(9, 12) for x in range(W)}


def test_what_is_left_out_is_not_read(spark, tmp_path):
    data = values()
    at = f"{tmp_path}/file.img"
    datasource.write_file(frame(spark, data), at, "envi", lines=4, width=W, height=H, bands=N)
    read = lambda: spark.read.format("envi").option("blockbytes", W * N * 4 * 2).load(at)
    assert read().rdd.getNumPartitions() == 15
    told = spark.read.format("envi").options(blockbytes=W * N * 4 * 2, lines="10:14", columns="5:6").load(at)
    pushed = spark.read.format("envi").options(blockbytes=W * N * 4 * 2, pushdown=True).load(at).where("y >= 10 AND y < 14 AND x = 5")
    for part in (told, pushed):
        assert part.rdd.getNumPartitions() == 2
        assert {(r["y"], r["x"]) for r in part.collect()} == {(y, 5) for y in range(10, 14)}
    whole = read()  # without the option, filters of one use leave the next alone
    assert whole.where("y < 5").count() == 5 * W and whole.count() == H * W
    os.truncate(at, os.path.getsize(at) - W * 4 * 3)  # the last band's last lines are gone
    assert spark.read.format("envi").option("lines", "0:20").load(at).count() == 20 * W
    assert spark.read.format("envi").option("bands", "0,2").load(at).count() == H * W
    with pytest.raises(Exception, match="bytes are there"):
        read().count()


def test_writing_is_whole_or_nothing(spark, tmp_path):
    data, at = values(), f"{tmp_path}/file.img"
    datasource.register(spark)
    options = {"width": W, "height": H, "bands": N}
    rows = frame(spark, data)
    with pytest.raises(Exception, match="one line|come together"):  # lines are not dealt to tasks
        rows.repartition(5).write.format("envi").options(**options).mode("overwrite").save(at)
    assert os.listdir(tmp_path) == []
    with pytest.raises(Exception, match="outside the raster"):
        datasource.write_file(rows.unionByName(rows.limit(1).withColumn("y", F.lit(H))), at, "envi", **options)
    assert os.listdir(tmp_path) == []
    rows.where("y < 20").coalesce(1).sortWithinPartitions("y").write.format("envi").options(**options).mode("overwrite").save(at)
    got = spark.read.format("raster").load(at)
    assert got.where("y >= 20 AND spectrum[0] IS NOT NULL").count() == 0 and got.count() == W * H
    with pytest.raises(Exception, match="is there"):
        rows.write.format("envi").options(**options).mode("append").save(at)
    with pytest.raises(Exception, match="no raster"):
        rasters.open_raster(f"{tmp_path}/file.hdr", "gtiff")


def packbits(data):
    out, at = bytearray(), 0
    while at < len(data):
        run = 1
        while run < 128 and at + run < len(data) and data[at + run] == data[at]:
            run += 1
        out += bytes([257 - run, data[at]]) if run > 1 else bytes([0, data[at]])
        at += run
    return bytes(out)


def lzw(data):
    words, bits, wide = {bytes([i]): i for i in range(256)}, [], 9
    put = lambda code: bits.append(format(code, f"0{wide}b"))
    put(256)
    n, word = 258, b""
    for byte in data:
        longer = word + bytes([byte])
        if longer in words:
            word = longer
            continue
        put(words[word])
        words[longer] = n
        n += 1
        wide = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
        if n == 4095:
            put(256)
            words, n, wide = {bytes([i]): i for i in range(256)}, 258, 9
        word = bytes([byte])
    put(words[word])
    n += 1
    wide = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
    put(257)
    text = "".join(bits)
    return int(text.ljust(-(-len(text) // 8) * 8, "0"), 2).to_bytes(-(-len(text) // 8), "big")


PACKERS = {1: bytes, 5: lzw, 8: zlib.compress, 32773: packbits}


def tiff(data, order="<", packing=1, predictor=1, tile=None, rows=4, planes=False, large=False, extra=()):
    """A file by hand: [line][sample][band] values."""
    h, w, n = data.shape
    kind = data.dtype.newbyteorder(order)
    size = tile or (rows, w)
    parts = []
    for p in range(n) if planes else [None]:
        own = data if p is None else data[:, :, p : p + 1]
        for y in range(0, h, size[0]):
            for x in range(0, w, size[1]):
                seg = own[y : y + size[0], x : x + size[1]]
                if tile:
                    seg = np.pad(seg, ((0, size[0] - seg.shape[0]), (0, size[1] - seg.shape[1]), (0, 0)))
                if predictor == 2:
                    unsigned = seg.view(f"u{kind.itemsize}")
                    seg = np.concatenate([unsigned[:, :1], np.diff(unsigned, axis=1)], 1).view(seg.dtype)
                raw = seg.astype(kind).tobytes()
                if predictor == 3:
                    lines, width, depth = seg.shape
                    planes_ = np.ascontiguousarray(seg).astype(f">f{kind.itemsize}").view(np.uint8).reshape(lines, width * depth, kind.itemsize).transpose(0, 2, 1).reshape(lines, -1, depth)
                    raw = np.concatenate([planes_[:, :1], np.diff(planes_, axis=1)], 1).tobytes()
                parts.append(PACKERS[packing](raw))
    entries = {256: (4, [w]), 257: (4, [h]), 258: (3, [kind.itemsize * 8] * n), 259: (3, [packing]), 277: (3, [n]), 284: (3, [2 if planes else 1]), 317: (3, [predictor]), 339: (3, [{"u": 1, "i": 2, "f": 3}[kind.kind]] * n)} | dict(extra)
    head, entry = (16, 20) if large else (8, 12)
    number, long = (16, "Q") if large else (4, "I")
    at, offsets = head, []
    for p in parts:
        offsets.append(at)
        at += len(p)
    entries |= {324: (number, offsets), 325: (number, [len(p) for p in parts]), 322: (3, [size[1]]), 323: (3, [size[0]])} if tile else {273: (number, offsets), 279: (number, [len(p) for p in parts]), 278: (3, [rows])}
    table, rest, start = b"", b"", at
    begin = start + (8 if large else 2) + entry * len(entries) + (8 if large else 4)
    for tag, (code, v) in sorted(entries.items()):
        raw = v if isinstance(v, bytes) else struct.pack(f"{order}{len(v)}{geotiff.TAG_TYPES[code][0]}", *v)
        table += struct.pack(f"{order}HH{long}", tag, code, len(v))
        if len(raw) <= (8 if large else 4):
            table += raw.ljust(8 if large else 4, b"\0")
        else:
            table += struct.pack(f"{order}{long}", begin + len(rest))
            rest += raw
    mark = b"II" if order == "<" else b"MM"
    first = mark + (struct.pack(f"{order}HHHQ", 43, 8, 0, start) if large else struct.pack(f"{order}HI", 42, start))
    return first + b"".join(parts) + struct.pack(f"{order}{'Q' if large else 'H'}", len(entries)) + table + b"\0" * (8 if large else 4) + rest


def test_tiff_layouts(spark, tmp_path):
    made = {}
    for packing in PACKERS:
        for predictor, kind in ((1, "f4"), (2, "i2"), (2, "u1"), (3, "f8"), (3, "f4")):
            for tile, planes, order in ((None, False, "<"), ((16, 16), True, ">"), ((16, 16), False, "<"), (None, True, ">")):
                name = f"{packing}_{predictor}_{kind}_{bool(tile)}_{planes}.tif"
                made[name] = np.round(values(len(made), kind)) if kind[0] == "f" else values(len(made), kind)
                (tmp_path / name).write_bytes(tiff(made[name], order, packing, predictor, tile, planes=planes, large=len(made) % 2 == 0))
    got = {}
    for r in rasters.read_rasters(spark, str(tmp_path), size=900).collect():
        got.setdefault(os.path.basename(r["path"]), np.zeros((H, W, N)))[r["y"], r["x"]] = r["spectrum"]
    assert set(got) == set(made)
    for name, data in made.items():
        assert (got[name] == data).all(), name


def test_long_lzw():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 7, 300_000).astype("u1").tobytes() + bytes(5000) + rng.integers(0, 256, 50_000).astype("u1").tobytes()
    assert geotiff.unpacked(lzw(data), 5, len(data)) == data


def test_tiff_places(tmp_path):
    gt = {33550: (12, [2.0, 3.0, 0.0]), 33922: (12, [1.0, 2.0, 0.0, 100.0, 50.0, 0.0]), 34735: (3, [1, 1, 0, 2, 1025, 0, 1, 2, 3072, 0, 1, 32611]), 42113: (2, b"-5\0")}
    (tmp_path / "a.tif").write_bytes(tiff(values(kind="i2"), extra=gt.items()))
    r = rasters.open_raster(f"{tmp_path}/a.tif")
    assert r.gt == (97.0, 2.0, 0.0, 57.5, 0.0, -3.0) and r.projection == "EPSG:32611" and r.ignore == (-5.0,)
    matrix = {34264: (12, [2.0, 0.5, 0, 7.0, 0.25, -2.0, 0, 9.0, 0, 0, 0, 0, 0, 0, 0, 1.0])}
    (tmp_path / "b.tif").write_bytes(tiff(values(kind="i2"), extra=matrix.items()))
    assert rasters.open_raster(f"{tmp_path}/b.tif").gt == (7.0, 2.0, 0.5, 9.0, 0.25, -2.0)
    (tmp_path / "c.tif").write_bytes(b"II*\0\x08\0\0\0\0\0\0\0")
    with pytest.raises(ValueError):
        rasters.open_raster(f"{tmp_path}/c.tif")


def card(k, v):
    return f"{k:<8}= {v:>20}".ljust(80)


def fits_unit(cards, data):
    text = "".join(card(k, v) for k, v in cards) + "END".ljust(80)
    return text.ljust(-(-len(text) // 2880) * 2880).encode() + data.ljust(-(-len(data) // 2880) * 2880, b"\0")


def test_fits(spark, tmp_path):
    cube = np.arange(2 * 3 * 4, dtype=">i2").reshape(4, 3, 2)  # NAXIS3, NAXIS2, NAXIS1
    primary = fits_unit([("SIMPLE", "T"), ("BITPIX", 16), ("NAXIS", 3), ("NAXIS1", 2), ("NAXIS2", 3), ("NAXIS3", 4), ("BZERO", 32768), ("BLANK", 5)], cube.tobytes())
    row = np.zeros(3, [("a", ">i4"), ("b", ">f8", 2), ("c", "S4"), ("d", "S1"), ("e", ">i2")])
    row["a"], row["b"], row["c"], row["d"], row["e"] = [1, -9, 3], [[1, 2], [np.nan, 4], [5, 6]], [b"xy", b"abcd", b""], [b"T", b"F", b"\0"], [2, 4, 6]
    table = fits_unit([("XTENSION", "'BINTABLE'"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", row.itemsize), ("NAXIS2", 3), ("PCOUNT", 0), ("GCOUNT", 1), ("TFIELDS", 5), ("TTYPE1", "'a'"), ("TFORM1", "'J'"), ("TNULL1", -9), ("TTYPE2", "'b'"), ("TFORM2", "'2D'"), ("TTYPE3", "'c'"), ("TFORM3", "'4A'"), ("TTYPE4", "'d'"), ("TFORM4", "'L'"), ("TTYPE5", "'e'"), ("TFORM5", "'I'"), ("TSCAL5", 0.5)], row.tobytes())
    (tmp_path / "cube.fits").write_bytes(primary + table)
    got = {(r["y"], r["x"]): r["spectrum"] for r in rasters.read_rasters(spark, str(tmp_path)).collect()}
    assert got == {(y, x): [None if cube[b, y, x] == 5 else float(cube[b, y, x]) + 32768 for b in range(4)] for y in range(3) for x in range(2)}
    other = {(r["y"], r["x"]): r["spectrum"] for r in rasters.read_rasters(spark, str(tmp_path), axes=[3, 1, 2]).collect()}
    assert other[1, 2] == [32768.0 + cube[2, b, 1] if cube[2, b, 1] != 5 else None for b in range(3)]
    rows = [tuple(r)[1:] for r in fits.read_table(spark, str(tmp_path), rows=2).orderBy("row").collect()]
    assert rows == [(0, 1, [1.0, 2.0], "xy", True, 1.0), (1, None, [None, 4.0], "abcd", False, 2.0), (2, 3, [5.0, 6.0], "", None, 3.0)]
    with pytest.raises(ValueError):
        rasters.open_raster(f"{tmp_path}/cube.fits", axes=[1, 2])
    flat = np.arange(12, dtype=">f4").reshape(4, 3)
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "lib.fits").write_bytes(fits_unit([("SIMPLE", "T"), ("BITPIX", -32), ("NAXIS", 2), ("NAXIS1", 3), ("NAXIS2", 4)], flat.tobytes()))
    read = lambda *a: sorted((r["name"], r["wavelengths"], r["values"]) for r in fits.read_spectra(spark, f"{tmp_path}/s", *a).collect())
    assert read(0, 1, "t") == [("lib_t_0", [1, 4, 7, 10], [0, 3, 6, 9]), ("lib_t_1", [1, 4, 7, 10], [2, 5, 8, 11])]
    assert [n for n, *_ in read(1, 0)] == ["lib_0", "lib_1", "lib_2"] and read(1, 0)[0][2] == [3, 4, 5]


def test_pds_labels(spark, tmp_path):
    label = pds.parse_label('PDS_VERSION_ID = PDS3 /* a\n comment */\n^IMAGE = ("A.IMG", 3 <BYTES>)\nTEXT = "two\nlines = 3"\nOBJECT = IMAGE\n LINES = 4\n MASK = 2#101#\n RANGE = (1.5 <M>, -2)\n OBJECT = INNER\n  X = \'s\'\n END_OBJECT\nEND_OBJECT = IMAGE\nEND\nrubbish = 1')
    assert label["TEXT"] == "two\nlines = 3" and label["IMAGE"][0]["MASK"] == 5 and label["IMAGE"][0]["RANGE"] == [1.5, -2] and label["IMAGE"][0]["INNER"][0]["X"] == "s" and "RUBBISH" not in label
    data = values(kind="i2").astype(">i2")
    around = b"".join(b"PP" + data[y, :, b].tobytes() + b"SSS" for b in range(N) for y in range(H))
    text = f'PDS_VERSION_ID = PDS3\r\n^IMAGE = ("a.img", 11 <BYTES>)\r\nOBJECT = IMAGE\r\n LINES = {H}\r\n LINE_SAMPLES = {W}\r\n BANDS = {N}\r\n SAMPLE_TYPE = MSB_INTEGER\r\n SAMPLE_BITS = 16\r\n LINE_PREFIX_BYTES = 2\r\n LINE_SUFFIX_BYTES = 3\r\n OFFSET = 1.0\r\n SCALING_FACTOR = 0.5\r\nEND_OBJECT = IMAGE\r\nOBJECT = IMAGE_MAP_PROJECTION\r\n MAP_SCALE = 0.5 <KM/PIXEL>\r\n SAMPLE_PROJECTION_OFFSET = 9.5\r\n LINE_PROJECTION_OFFSET = 1.5\r\nEND_OBJECT\r\nEND\r\n'
    (tmp_path / "a.img").write_bytes(b"0123456789" + around)
    (tmp_path / "a.lbl").write_text(text)
    got = np.zeros((H, W, N))
    for r in rasters.read_rasters(spark, str(tmp_path), size=300, scaled=True).collect():
        got[r["y"], r["x"]] = r["spectrum"]
    assert (got == data * 0.5 + 1).all()
    assert rasters.open_raster(f"{tmp_path}/a.lbl").gt == (-5000.0, 500.0, 0.0, 1000.0, 0.0, -500.0)
    cube = values(kind="f4")
    (tmp_path / "q").mkdir()
    head = f"PDS_VERSION_ID = PDS3\nRECORD_BYTES = 1024\n^QUBE = 2\nOBJECT = QUBE\n AXES = 3\n AXIS_NAME = (SAMPLE, BAND, LINE)\n CORE_ITEMS = ({W}, {N}, {H})\n CORE_ITEM_BYTES = 4\n CORE_ITEM_TYPE = PC_REAL\n CORE_NULL = -1.0\nEND_OBJECT = QUBE\nEND\n"
    (tmp_path / "q" / "b.cub").write_bytes(head.encode().ljust(1024) + cube.transpose(0, 2, 1).tobytes())
    for r in rasters.read_rasters(spark, f"{tmp_path}/q").collect():
        got[r["y"], r["x"]] = r["spectrum"]
    assert (got == cube).all()


def classic(variables, dims, version=2, records=0):
    """A NetCDF file by hand: variables are (name, dims, attributes, array)."""
    word, place = lambda n: struct.pack(">I", n), lambda n: struct.pack(">I" if version == 1 else ">Q", n)
    pad = lambda b: b + b"\0" * (-len(b) % 4)
    text = lambda s: word(len(s)) + pad(s.encode())
    attribute = lambda k, v: text(k) + (word(2) + text(v) if isinstance(v, str) else word(6) + word(1) + struct.pack(">d", v))
    codes = {np.dtype(v): k for k, v in netcdf.TYPES.items()}
    names = [d for d, _ in dims]
    fixed = [v for v in variables if not (v[1] and dims[names.index(v[1][0])][1] == 0)]
    moving = [v for v in variables if v not in fixed]

    def head(starts):
        out = b"CDF" + bytes([version]) + word(records) + word(10) + word(len(dims)) + b"".join(text(d) + word(n) for d, n in dims) + word(0) + word(0) + word(11) + word(len(variables))
        for name, own, attributes, array in variables:
            size = array.nbytes if (name, own, attributes, array) in fixed else array.nbytes // max(1, records)
            out += text(name) + word(len(own)) + b"".join(word(names.index(d)) for d in own) + (word(12) + word(len(attributes)) + b"".join(attribute(k, v) for k, v in attributes.items()) if attributes else word(0) + word(0)) + word(codes[array.dtype]) + word(-(-size // 4) * 4) + place(starts.get(name, 0))
        return out

    at, starts = len(head({})), {}
    for name, *_, array in fixed:
        starts[name], at = at, at + -(-array.nbytes // 4) * 4
    for name, *_, array in moving:
        starts[name], at = at, at + (-(-array[0].nbytes // 4) * 4 if len(moving) > 1 else array[0].nbytes)
    body = b"".join(pad(v[3].tobytes()) for v in fixed)
    body += b"".join(pad(v[3][i].tobytes()) if len(moving) > 1 else v[3][i].tobytes() for i in range(records) for v in moving)
    return head(starts) + body


def test_netcdf(spark, tmp_path):
    cube, noise = values(kind="i2").astype(">i2"), values(2, "f4").astype(">f4")
    waves = (np.arange(N) + 400).astype(">f8")
    bands = cube.transpose(2, 0, 1).copy()
    fixed = [("noise", ("y", "x", "band"), {}, noise), ("surface_reflectance", ("band", "y", "x"), {"_FillValue": 7.0, "long_name": "of the ground"}, bands), ("wavelengths", ("band",), {"units": "um"}, waves)]
    for version in (1, 2):
        (tmp_path / f"fixed{version}.nc").write_bytes(classic(fixed, [("band", N), ("y", H), ("x", W)], version))
    one = [("refl", ("time", "x", "band"), {}, cube)]
    (tmp_path / "one.nc").write_bytes(classic(one, [("time", 0), ("x", W), ("band", N)], 2, H))
    two = [("mask", ("time", "x"), {}, cube[:, :, 0].copy()), ("reflectance", ("time", "x", "band"), {}, cube)]
    (tmp_path / "two.nc").write_bytes(classic(two, [("time", 0), ("x", W), ("band", N)], 1, H))
    got = {}
    for r in rasters.read_rasters(spark, str(tmp_path), size=500).collect():
        got.setdefault(os.path.basename(r["path"]), {})[r["y"], r["x"]] = r["spectrum"]
    for name in ("fixed1.nc", "fixed2.nc", "one.nc", "two.nc"):
        none = 7 if name.startswith("fixed") else None
        assert got[name] == {(y, x): [None if v == none else float(v) for v in cube[y, x]] for y in range(H) for x in range(W)}, name
    noisy = {(r["y"], r["x"]): r["spectrum"] for r in rasters.read_rasters(spark, f"{tmp_path}/fixed1.nc", variable="noise").collect()}
    assert noisy[4, 5] == [float(v) for v in noise[4, 5]]
    r = rasters.open_raster(f"{tmp_path}/fixed2.nc")
    assert r.wavelengths == tuple(waves.tolist()) and r.unit == "um" and r.tags == {"variable": "surface_reflectance"}
    told = {(os.path.basename(v["path"]), v["variable"]): v["score"] for v in netcdf.read_variables(spark, str(tmp_path)).collect()}
    assert told["fixed1.nc", "noise"] == 0 and told["two.nc", "reflectance"] > told["two.nc", "mask"]
    found, place = store(f"{tmp_path}/two.nc")
    with found.open_input_file(place) as file:
        assert netcdf.named(netcdf.header(file)[1], "reflectance").name == "reflectance"


def test_scores():
    """Words in the name count six, in the description three, and alike parts up to ten, times their weights."""
    # the name holds reflectance (5) and refl (4), and is like the first word (10 of 10), the third (7) and the fourth (8)
    assert netcdf.score("reflectance") == 6 * (5 + 4) + 10 * 5 + 7 * 4 + 8 * 3
    assert netcdf.score("/group/sr") == 6 * 1 + 10 * 1
    assert netcdf.score("x", "surface reflectance") == 3 * (5 + 4)
    assert netcdf.score("") == 0 and netcdf.score("reflectanse") == 6 * 4 + 9 * 5 + 7 * 3
    assert netcdf.score("radiance") == 0
