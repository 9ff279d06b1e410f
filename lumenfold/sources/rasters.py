"""Raster files of several formats as DataFrames: a header tells where the values lie, tasks read byte ranges.

A ``Raster`` is what a header says: size, type of the values, and their place as an offset and steps between lines,
samples and bands. ENVI, FITS, PDS and classic NetCDF files are such arrays; those of GeoTIFF come in segments, which are
unpacked. Headers are read in tasks too, one for each file, then the blocks of lines of all files are dealt over tasks.
"""

from __future__ import annotations

import inspect
import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.sources.envi import BLOCK, TASKS, store

PIXELS = "path string, y int, x int, spectrum array<double>"
INFO = "path string, format string, width int, height int, bands int, gt array<double>, projection string, ignore array<double>, unit string"
BANDS = "path string, band int, description string, wavelength double, unit string, good boolean"


class NotThisFormat(ValueError):
    """The file is of another format."""


@dataclass(frozen=True)
class Raster:
    path: str  # of the values
    format: str
    width: int
    height: int
    bands: int
    kind: str  # numpy's name of the type, with its byte order
    offset: int = 0
    steps: tuple[int, int, int] = (0, 0, 0)  # bytes from line to line, sample to sample, band to band
    gt: tuple[float, ...] | None = None
    projection: str | None = None
    ignore: tuple[float, ...] = ()
    scale: float = 1.0
    shift: float = 0.0
    scaled: bool = False  # whether values are told as stored * scale + shift; ignore values are as stored
    names: tuple[str, ...] = ()
    wavelengths: tuple[float, ...] = ()
    unit: str | None = None
    good: tuple[bool, ...] = ()
    first: int = 0  # the line of the whole that line 0 is
    tags: dict = field(default_factory=dict)

    def __post_init__(self):
        if min(self.width, self.height, self.bands) < 1:
            raise ValueError(f"{self.path}: no pixels")

    @property
    def unit_of_lines(self) -> int:
        """Lines that can only be read together."""
        return 1

    def blocks(self, size: int = BLOCK, lines: tuple[int, int] | None = None) -> list[tuple[int, int]]:
        """(first line, lines) of blocks of about ``size`` bytes; ``lines`` keeps those from a first to before a last one of the whole."""
        line, step = self.width * self.bands * np.dtype(self.kind).itemsize, self.unit_of_lines
        step *= max(1, size // max(1, line * step))
        low, high = (0, self.height) if lines is None else (max(0, lines[0] - self.first), min(self.height, lines[1] - self.first))
        if low >= high:
            return []
        at = low // self.unit_of_lines * self.unit_of_lines
        return [(max(a, low), min(a + step, high) - max(a, low)) for a in range(at, high, step)]

    def part(self, at: int, count: int) -> Raster:
        """The same, with no more than what a task needs for these lines."""
        return self

    def stored(self, file: pa.NativeFile, at: int, count: int, bands: Sequence[int]) -> np.ndarray:
        """[line][sample][band] of some lines as they are stored."""
        line, sample, band = self.steps
        kind = np.dtype(self.kind)

        def view(first: int, shape: tuple[int, ...], steps: tuple[int, ...]) -> np.ndarray:
            length = sum((n - 1) * s for n, s in zip(shape, steps, strict=True)) + kind.itemsize
            data = file.read_at(length, first)
            if len(data) < length:
                raise ValueError(f"{self.path}: {len(data)} of {length} bytes are there at {first}")
            return np.ndarray(shape, kind, data, 0, steps)

        if band > line:  # bands one after the other: those that aren't wanted are never read
            own = [view(self.offset + b * band + at * line, (count, self.width), (line, sample)) for b in bands]
            return np.stack(own, 2)
        return view(self.offset + at * line, (count, self.width, self.bands), self.steps)[:, :, list(bands)]

    def read(self, file: pa.NativeFile, at: int, count: int, bands: Sequence[int] | None = None) -> np.ndarray:
        """[line][sample][band] in doubles; NaN for what is missing: ignore values (up to rounding), infinities, bad bands."""
        wanted = list(range(self.bands)) if bands is None else list(bands)
        raw = self.stored(file, at, count, wanted)
        out = raw.astype(np.float64)
        for ignore in self.ignore:
            out[np.abs(out - ignore) <= (1e-8 + 1e-5 * abs(ignore) if raw.dtype.kind == "f" else 0)] = np.nan
        if self.scaled and (self.scale, self.shift) != (1.0, 0.0):
            out = out * self.scale + self.shift
        if self.good:
            out[..., [not self.good[b] for b in wanted]] = np.nan
        out[~np.isfinite(out)] = np.nan
        return out


Opener = Callable[[pa.NativeFile, str, Callable[[str], bytes]], Raster]


def openers() -> dict[str, Opener]:
    """By name, in the order in which they are tried."""
    from lumenfold.sources import envi_file, fits, geotiff, netcdf, pds

    return {"envi": envi_file.opened, "gtiff": geotiff.opened, "netcdf": netcdf.opened, "fits": fits.opened, "pds3": pds.opened3, "pds4": pds.opened4}


def beside(path: str, name: str) -> str:
    """The path of a file of that name in the same folder."""
    return path.rsplit("/", 1)[0] + "/" + name if "/" in path else name


def whole(path: str) -> bytes:
    found, place = store(path)
    with found.open_input_file(place) as file:
        return file.read()


def open_raster(path: str, format: str | None = None, scaled: bool = False, **options) -> Raster:
    """What the header of a file says. Without a format all are tried in turn."""
    found, place = store(path)
    failed = []
    for name, opener in openers().items():
        if format not in (None, "raster", name) or not set(options) <= set(inspect.signature(opener).parameters):
            continue  # options tell the format too
        with found.open_input_file(place) as file:
            try:
                raster = opener(file, path, whole, **options)
                return replace(raster, scaled=True) if scaled else raster
            except NotThisFormat as e:
                failed.append(f"{name}: {e}")
    raise ValueError(f"{path}: no raster that is known here ({'; '.join(failed) or format})")


#: Files that belong to another one, which names them.
_ASIDE = r"(?i)(\.(hdr|xml|lbl|aux|tfw|prj|ovr|crc)$)|(/[_.][^/]*$)"


def data_files(spark: SparkSession, path: str) -> DataFrame:
    """(path) of the files below a path that hold values; labels that tell of other files stand for those."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    labels = files.where(r"path RLIKE '(?i)\\.(xml|lbl)$'").select("path", F.regexp_replace("path", r"\.[^./]*$", "").alias("stem"))
    held = files.where(~F.col("path").rlike(_ASIDE)).withColumn("stem", F.regexp_replace("path", r"\.[^./]*$", ""))
    return held.join(labels.select("stem"), "stem", "left_anti").select("path").union(labels.select("path"))


def _opened(files: DataFrame, format: str | None, options: dict, what: Callable[[str, Raster], list[tuple]], schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path in pdf["path"]:
                yield pd.DataFrame(what(path, open_raster(path, format, **options)), columns=names)

    return files.mapInPandas(run, schema)


def raster_info(spark: SparkSession, path: str, format: str | None = None, **options) -> DataFrame:
    """A row for each raster below a path: INFO."""
    told = lambda p, r: [(p, r.format, r.width, r.height, r.bands, None if r.gt is None else list(r.gt), r.projection, list(r.ignore), r.unit)]
    return _opened(data_files(spark, path), format, options, told, INFO)


def raster_bands(spark: SparkSession, path: str, format: str | None = None, **options) -> DataFrame:
    """A row for each band of each raster: BANDS."""

    def told(p: str, r: Raster) -> list[tuple]:
        of = lambda values, b, default=None: values[b] if b < len(values) else default
        return [(p, b, of(r.names, b), of(r.wavelengths, b), r.unit, of(r.good, b, True)) for b in range(r.bands)]

    return _opened(data_files(spark, path), format, options, told, BANDS)


def batches_of(raster: Raster, name: str, at: int, count: int, bands: Sequence[int] | None = None, columns: tuple[int, int] | None = None) -> Iterator[pa.RecordBatch]:
    """PIXELS of some lines, some 200,000 values at a time."""
    found, place = store(raster.path)
    low, high = (0, raster.width) if columns is None else (max(0, columns[0]), min(raster.width, columns[1]))
    if low >= high:
        return
    with found.open_input_file(place) as file:
        block = raster.read(file, at, count, bands)[:, low:high]
    _, w, n = block.shape
    step = max(1, 200_000 // max(1, w * n))
    for i in range(0, len(block), step):
        part = block[i : i + step].reshape(-1, n)
        pixel = np.arange(len(part))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * n), pa.array(part.ravel(), from_pandas=True))
        y, x = pixel // w + i + at + raster.first, pixel % w + low
        yield pa.record_batch([pa.array([name] * len(part)), pa.array(y.astype(np.int32)), pa.array(x.astype(np.int32)), lists], names=["path", "y", "x", "spectrum"])


def read_rasters(spark: SparkSession, path: str, format: str | None = None, bands: Sequence[int] | None = None, lines: tuple[int, int] | None = None, size: int = BLOCK, **options) -> DataFrame:
    """PIXELS of all rasters below a path; missing values are NULL. ``bands`` and ``lines`` (from, before) leave out what isn't wanted before it is read."""
    planned = lambda p, r: [(p, pickle.dumps(r.part(at, count)), at, count) for at, count in r.blocks(size, lines)]
    blocks = _opened(data_files(spark, path), format, options, planned, "path string, raster binary, at int, lines int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from batches_of(pickle.loads(row["raster"]), row["path"], row["at"], row["lines"], bands)

    return blocks.repartition(min(max(1, blocks.count()), TASKS)).mapInArrow(run, PIXELS)  # headers only are counted


@dataclass(frozen=True)
class Layout:
    """What a writer needs: the raster, bytes before the values, bytes after them, and files beside."""

    raster: Raster
    head: bytes = b""
    tail: bytes = b""
    aside: dict[str, bytes] = field(default_factory=dict)  # by path

    @property
    def length(self) -> int:
        r = self.raster
        return self.raster.offset + r.width * r.height * r.bands * np.dtype(r.kind).itemsize


def steps_of(interleave: str, width: int, height: int, bands: int, size: int) -> tuple[int, int, int]:
    """Bytes from line to line, sample to sample and band to band."""
    orders = {"bsq": (width, 1, width * height), "bil": (width * bands, 1, width), "bip": (width * bands, bands, 1)}
    if interleave not in orders:
        raise ValueError(f"no order {interleave!r}; there are bsq, bil and bip")
    return tuple(n * size for n in orders[interleave])


def moved(raster: Raster, offset: int) -> Raster:
    return replace(raster, offset=offset)
