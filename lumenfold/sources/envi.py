"""ENVI rasters: a header of key = value lines and a binary file of samples.

The reader lists files with Spark and parses their headers (small texts); tasks read the byte ranges of their lines, so
that rasters may be of any size. The writer makes a raster of each block of lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from urllib.parse import quote
from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Data types of the format.
TYPES = {1: "u1", 2: "i2", 3: "i4", 4: "f4", 5: "f8", 6: "c8", 9: "c16", 12: "u2", 13: "u4", 14: "i8", 15: "u8"}
BLOCK = 32 << 20  # bytes that a task reads or writes at once
TASKS = 50_000


def parse_header(text: str) -> dict[str, str | list[str]]:
    """Keys in lower case; values in braces as lists."""
    if not text.lstrip().startswith("ENVI"):
        raise ValueError("not an ENVI header")
    out: dict[str, str | list[str]] = {}
    for m in re.finditer(r"^[ \t]*([^=\n;{}]+?)[ \t]*=[ \t]*(\{[^}]*\}|[^\n]*)", text, re.M):
        value = m[2].strip()
        key = re.sub(r"\s+", " ", m[1].lower())
        out[key] = [x.strip() for x in value[1:-1].split(",")] if value.startswith("{") else value
    return out


def write_header(fields: dict) -> str:
    lines = ["ENVI"]
    for key, value in fields.items():
        lines.append(f"{key} = " + ("{" + ", ".join(map(str, value)) + "}" if isinstance(value, list | tuple) else str(value)))
    return "\n".join(lines) + "\n"


def samples(data: bytes, header: dict) -> np.ndarray:
    """[line][sample][band] of a data file."""
    w, h, n = (int(header[k]) for k in ("samples", "lines", "bands"))
    flat = np.frombuffer(data, sample_type(header), count=w * h * n, offset=int(header.get("header offset", 0)))
    shape, axes = {"bsq": ((n, h, w), (1, 2, 0)), "bil": ((h, n, w), (0, 2, 1)), "bip": ((h, w, n), (0, 1, 2))}[str(header.get("interleave", "bsq")).lower()]
    return flat.reshape(shape).transpose(axes)


def bad_or_ignored(x: np.ndarray, header: dict, bands: Sequence[int] | None = None) -> np.ndarray:
    """NaN for the ignore value (up to rounding), infinities and bad bands."""
    x = x.astype(np.float64)
    if "data ignore value" in header:
        ignore = float(header["data ignore value"])
        x[np.abs(x - ignore) <= 1e-8 + 1e-5 * abs(ignore)] = np.nan
    if "bbl" in header:
        bad = np.array([float(v) == 0 for v in header["bbl"]])
        x[..., bad if bands is None else bad[list(bands)]] = np.nan
    return np.where(np.isfinite(x), x, np.nan)


def headers(spark: SparkSession, path: str) -> DataFrame:
    """(stem, header): the header text of each raster below a path."""
    files = spark.read.option("pathGlobFilter", "*.hdr").option("recursiveFileLookup", "true").text(path, wholetext=True)
    return files.select(F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), r"\.hdr$", "").alias("stem"), F.col("value").alias("header"))


def bands_of(header: dict) -> list[tuple]:
    """(band, description, wavelength, unit, good) of a header."""
    n = int(header["bands"])
    names, waves, good = (header.get(k) or [None] * n for k in ("band names", "wavelength", "bbl"))
    unit = header.get("wavelength units")
    return [(i, names[i], float(waves[i]) if waves[i] is not None else None, unit, good[i] is None or float(good[i]) != 0) for i in range(n)]


def read_bands(spark: SparkSession, path: str) -> DataFrame:
    """(stem, band, description, wavelength, unit, good) for each raster; headers are parsed in tasks."""

    def run(batches):
        for pdf in batches:
            rows = [(stem, *band) for stem, text in zip(pdf["stem"], pdf["header"], strict=True) for band in bands_of(parse_header(text))]
            if rows:
                yield pd.DataFrame(rows, columns=["stem", "band", "description", "wavelength", "unit", "good"])

    return headers(spark, path).mapInPandas(run, "stem string, band int, description string, wavelength double, unit string, good boolean")


def local_path(uri: str) -> str:
    return re.sub(r"^file:/+", "/", uri)


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """The store of a path and the path in it: a local or mounted folder, or one that pyarrow knows (hdfs, s3, gs)."""
    if re.match(r"file:|/", uri):
        return fs.LocalFileSystem(), local_path(uri)
    return fs.FileSystem.from_uri(quote(re.sub(r"^s3[an]://", "s3://", uri), safe=":/@"))


def sample_type(header: dict) -> np.dtype:
    return np.dtype(TYPES[int(header["data type"])]).newbyteorder(">" if str(header.get("byte order", "0")) == "1" else "<")


def line_blocks(header: dict, length: int, size: int, lines: tuple[int, int] | None = None) -> list[tuple[int, int]]:
    """(first line, lines) of the blocks of a data file, each of about ``size`` bytes and at least a line.

    ``lines`` keeps those from a first to before a last one. A file that is too short for its header raises.
    """
    w, h, n = (int(header[k]) for k in ("samples", "lines", "bands"))
    line = w * n * sample_type(header).itemsize
    if length < int(header.get("header offset", 0)) + h * line:
        raise ValueError(f"{length} bytes are too few for {h} lines of {line}")
    low, high = (0, h) if lines is None else (max(0, lines[0]), min(h, lines[1]))
    step = max(1, size // max(1, line))
    return [(at, min(step, high - at)) for at in range(low, high, step)]


def read_block(file: pa.NativeFile, header: dict, at: int, lines: int, bands: Sequence[int] | None = None) -> np.ndarray:
    """[line][sample][band] of some lines, by reading their byte ranges only; of a band-sequential file only some bands."""
    w, h, n = (int(header[k]) for k in ("samples", "lines", "bands"))
    kind, start = sample_type(header), int(header.get("header offset", 0))
    wanted = list(range(n)) if bands is None else list(bands)
    take = lambda first, count: np.frombuffer(file.read_at(count * kind.itemsize, start + first * kind.itemsize), kind)
    interleave = str(header.get("interleave", "bsq")).lower()
    if interleave == "bsq":
        return np.stack([take((b * h + at) * w, lines * w).reshape(lines, w) for b in wanted], axis=2)
    flat = take(at * w * n, lines * w * n)
    if interleave == "bil":
        return flat.reshape(lines, n, w).transpose(0, 2, 1)[:, :, wanted]
    return flat.reshape(lines, w, n)[:, :, wanted]


def read_raster(spark: SparkSession, path: str, bands: Sequence[int] | None = None, lines: tuple[int, int] | None = None, size: int = BLOCK) -> DataFrame:
    """(stem, y, x, spectrum) of all rasters below a path; missing values are NULL.

    Spark lists the files and reads the headers; a row for each block of lines is dealt over as many tasks as there are
    blocks, and a task reads the byte ranges of its block, so that one raster of any size is read by many. ``bands``
    and ``lines`` (from, before) leave out what isn't wanted before it is read.
    """
    data = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("NOT path LIKE '%.hdr' AND NOT path LIKE '%/_SUCCESS'")
    files = data.select(F.regexp_replace("path", r"\.(img|dat|raw|bsq|bil|bip)$", "").alias("stem"), "path", "length")
    norm = lambda c: F.regexp_replace(c, r"^file:/+", "/")
    both = files.withColumn("k", norm("stem")).join(headers(spark, path).select(norm("stem").alias("k"), "header"), "k").drop("k")

    def plan(batches):
        for pdf in batches:
            rows = [(r.stem, r.path, r.header, at, count) for r in pdf.itertuples() for at, count in line_blocks(parse_header(r.header), r.length, size, lines)]
            yield pd.DataFrame(rows, columns=["stem", "path", "header", "at", "lines"])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                head = parse_header(row["header"])
                found, place = store(row["path"])
                with found.open_input_file(place) as file:
                    block = bad_or_ignored(read_block(file, head, row["at"], row["lines"], bands), head, bands)
                _, w, n = block.shape
                first = int(head.get("y start", 1)) - 1 + row["at"]
                step = max(1, 200_000 // max(1, w * n))
                for at in range(0, len(block), step):
                    part = block[at : at + step].reshape(-1, n)
                    values = pa.array(part.ravel(), from_pandas=True)
                    offsets = pa.array(np.arange(len(part) + 1, dtype=np.int32) * n)
                    pixel = np.arange(len(part)) + at * w
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["stem"]] * len(part)), pa.array((pixel // w + first).astype(np.int32)), pa.array((pixel % w).astype(np.int32)), pa.ListArray.from_arrays(offsets, values)],
                        names=["stem", "y", "x", "spectrum"],
                    )

    blocks = both.mapInPandas(plan, "stem string, path string, header string, at int, lines int")
    tasks = min(max(1, blocks.count()), TASKS)  # headers only; further blocks share tasks
    return blocks.repartition(tasks).mapInArrow(run, "stem string, y int, x int, spectrum array<double>")


def subset_header(header: dict, left: int = 0, top: int = 0, width: int | None = None, height: int | None = None, include: Sequence[bool] | None = None, ignore: float | None = None) -> dict:
    """The header of a crop with some bands: their names, wavelengths and flags, default bands numbered anew (the next
    kept one in place of one that goes, or the last) and the reference pixel of the map moved, which shifts the geotransform whatever its rotation."""
    w, h, n = (int(header[k]) for k in ("samples", "lines", "bands"))
    width, height = w if width is None else width, h if height is None else height
    for name, at, count, whole in (("left", left, width, w), ("top", top, height, h)):
        if not 0 <= at < whole or count < 0 or at + count > whole:
            raise ValueError(f"{name} {at} and size {count} do not fit into {whole}")
    kept = [b for b in range(n) if include is None or include[b]]
    out = header | {"samples": width, "lines": height, "bands": len(kept)}
    for key in ("wavelength", "fwhm", "bbl", "band names"):
        if header.get(key):
            out[key] = [header[key][b] for b in kept]
    if header.get("default bands"):
        shown = [int(float(b)) - 1 for b in header["default bands"]]
        out["default bands"] = [min(sum(k < b for k in kept), len(kept) - 1) + 1 for b in shown]
    if header.get("map info"):
        info = list(header["map info"])
        info[1:3] = [float(info[1]) - left, float(info[2]) - top]
        out["map info"] = info
    if ignore is not None:
        out["data ignore value"] = ignore
    return out


def result_header(header: dict, kind: str) -> dict:
    """The header of a result of band math: a cube keeps all that its source says, a band what isn't about bands."""
    if kind == "cube":
        return dict(header)
    return {k: v for k, v in header.items() if k not in ("wavelength", "wavelength units", "fwhm", "bbl", "band names", "default bands")} | {"bands": 1}


def write_raster(
    cube: DataFrame, path: str, name: str, header: dict, left: int = 0, top: int = 0, width: int | None = None, height: int | None = None,
    include: Sequence[bool] | None = None, ignore: float | None = None, interleave: str = "bsq", kind: int = 4, size: int = BLOCK,
) -> DataFrame:
    """Writes a raster (y, x, spectrum) with the header of its source, or a crop and some bands of it; (block, file, lines).

    Each block of lines is a raster of its own beside the others, with its ``y start`` and map, written by one task under
    a name of its own and then moved, so that a repeated task does no harm. Pixels that the cube lacks and missing
    values are the ignore value: the given one, else the header's, else the default if the data type holds it.
    """
    head = subset_header(header, left, top, width, height, include, ignore)
    w, h, n = head["samples"], head["lines"], head["bands"]
    missing = float(head.get("data ignore value", ignore_value_for(TYPES[kind])))
    head |= {"header offset": 0, "file type": "ENVI Standard", "data type": kind, "interleave": interleave, "byte order": 0, "data ignore value": missing}
    lines = max(1, size // max(1, w * n * 8))
    kept = [b for b in range(int(header["bands"])) if include is None or include[b]]
    inside = cube.where(F.col("x").between(left, left + w - 1) & F.col("y").between(top, top + h - 1))
    spectrum = F.col("spectrum") if len(kept) == int(header["bands"]) else F.array(*(F.get("spectrum", F.lit(b)) for b in kept))
    pixels = inside.select((F.col("y") - top).cast("int").alias("y"), (F.col("x") - left).cast("int").alias("x"), spectrum.cast("array<double>").alias("spectrum"))
    marks = cube.sparkSession.range((h + lines - 1) // lines).select((F.col("id") * lines).cast("int").alias("y"), F.lit(-1).alias("x"), F.lit(None).cast("array<double>").alias("spectrum"))
    axes = {"bsq": (2, 0, 1), "bil": (0, 2, 1), "bip": (0, 1, 2)}[interleave]
    dtype = np.dtype(TYPES[kind]).newbyteorder("<")

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        block = key[0].as_py()
        table = table.filter(pc.and_(pc.greater_equal(table.column("x"), 0), pc.is_valid(table.column("spectrum"))))
        y, x = table.column("y").to_numpy(), table.column("x").to_numpy()
        count = min(lines, h - block * lines)
        out = np.full((count, w, n), np.nan)
        if len(y):
            flat = table.column("spectrum").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            out[y - block * lines, x] = flat.reshape(len(y), n)
        out = np.where(np.isfinite(out), out, missing).astype(dtype).transpose(axes)
        own = subset_header(head, top=block * lines, height=count) | {"y start": block * lines + 1}
        stem = f"{path.rstrip('/')}/{name}_{block:06d}"
        for suffix, content in ((".hdr", write_header(own).encode()), (".img", out.tobytes())):
            put(stem + suffix, content)
        return pa.table({"block": pa.array([block], pa.int32()), "file": [stem + ".img"], "lines": pa.array([count], pa.int32())})

    blocks = pixels.unionByName(marks).withColumn("block", F.floor(F.col("y") / lines).cast("int"))
    written = blocks.groupBy("block").applyInArrow(run, "block int, file string, lines int")
    rows = [(r["block"], r["file"], r["lines"]) for r in written.collect()]  # names of files
    return cube.sparkSession.createDataFrame(sorted(rows), "block int, file string, lines int")


def put(uri: str, content: bytes | Iterable[bytes]) -> None:
    """A file that is there as a whole or not at all, written piece by piece if it comes so."""
    found, place = store(uri)
    found.create_dir(place.rpartition("/")[0], recursive=True)
    own = place if found.type_name in ("s3", "gcs") else f"{place.rpartition('/')[0]}/_{uuid4().hex}"  # object stores show closed files only
    with found.open_output_stream(own) as out:
        for piece in [content] if isinstance(content, bytes) else content:
            out.write(piece)
    if own != place:
        found.move(own, place)


def encode_raster(values: np.ndarray, fields: dict | None = None, ignore: float = -9999.0) -> tuple[str, bytes]:
    """(header, data) of [y][x][band] values as float32 in band order; NaN becomes the ignore value."""
    h, w, n = values.shape
    filled = np.where(np.isfinite(values), values, ignore).astype("<f4")
    head = {"samples": w, "lines": h, "bands": n, "header offset": 0, "file type": "ENVI Standard", "data type": 4, "interleave": "bsq", "byte order": 0, "data ignore value": ignore}
    return write_header(head | (fields or {})), filled.transpose(2, 0, 1).tobytes()


def encode_blocks(cube: DataFrame, width: int, lines: int, ignore: float = -9999.0) -> DataFrame:
    """(block, header, data): a raster (y, x, spectrum) as ENVI files of so many lines; ``y start`` places them."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        y, x = table.column("y").to_numpy(), table.column("x").to_numpy()
        spectra = table.column("spectrum").to_pylist()
        n = max(map(len, spectra))
        first = key[0].as_py() * lines
        out = np.full((int(y.max()) - first + 1, width, n), np.nan)
        out[y - first, x] = [[np.nan if v is None else v for v in s] for s in spectra]
        header, data = encode_raster(out, {"y start": first + 1}, ignore)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "header": [header], "data": pa.array([data], pa.binary())})

    return cube.withColumn("block", F.floor(F.col("y") / lines).cast("int")).groupBy("block").applyInArrow(run, "block int, header string, data binary")


def ignore_value_for(kind: str, default: float = -9999.0) -> float:
    """The default if a type can hold it, else the least value of the type."""
    t = np.dtype(kind)
    if t.kind == "f":
        return default
    info = np.iinfo(t)
    return default if info.min <= default <= info.max else float(info.min)


def read_library(spark: SparkSession, path: str) -> DataFrame:
    """(stem, spec_id, name, wavelengths, values) of spectral libraries: rasters of one band whose lines are spectra."""
    from lumenfold.functions.units import to_nm

    data = spark.read.format("binaryFile").load(path).where("path LIKE '%.sli' OR path LIKE '%.lib'")
    files = data.select(F.regexp_replace(F.regexp_replace("path", r"^file:/+", "/"), r"\.(sli|lib)$", "").alias("stem"), "content")
    both = files.join(headers(spark, path).select(F.regexp_replace("stem", r"^file:/+", "/").alias("stem"), "header"), "stem")

    def run(batches):
        for pdf in batches:
            for stem, content, text in zip(pdf["stem"], pdf["content"], pdf["header"], strict=True):
                head = parse_header(text)
                found = samples(content, head)[:, :, 0].astype(float)
                names = head.get("spectra names") or [f"{i}" for i in range(len(found))]
                waves = [float(w) for w in head.get("wavelength", [])]
                yield pd.DataFrame({"stem": stem, "spec_id": range(len(found)), "name": names[: len(found)], "unit": str(head.get("wavelength units", "nm")), "w": [waves] * len(found), "values": list(found)})

    rows = both.mapInPandas(run, "stem string, spec_id long, name string, unit string, w array<double>, values array<double>")
    return rows.select("stem", "spec_id", "name", F.transform("w", lambda w: to_nm(w, F.col("unit"))).alias("wavelengths"), "values")
