"""Raster files as Spark data sources: ``spark.read.format("envi")`` and ``.write.format("envi")``, and so for the others.

``register(spark)`` makes the formats known. Reading: a partition for each block of lines; the options ``lines`` and
``columns`` (from:before) and ``bands`` leave out what isn't wanted before it is read. With the option ``pushdown`` filters
on y and x do so too. That is a choice since Spark 4.1 keeps what a filter pushed down for later uses of the same frame:
after ``df.where("y < 9")`` a ``df.count()`` would see those lines only. Load such a frame anew for each use. Writing fills one file from many tasks: a task writes whole lines at their place in a file that is hidden
until all are there, so that a repeated task does no harm; a failed job leaves nothing.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from lumenfold.sources import envi_file, fits, geotiff, netcdf, pds
from lumenfold.sources.envi import BLOCK, ignore_value_for, local_path, put, store
from lumenfold.sources.rasters import PIXELS, Layout, Raster, batches_of, open_raster, openers, steps_of

LAYOUTS = {"envi": envi_file.layout, "gtiff": geotiff.layout, "fits": fits.layout, "netcdf": netcdf.layout, "pds3": pds.layout3, "pds4": pds.layout4}
FLUSH = 64 << 20  # bytes that a writing task holds


@dataclass
class Block(InputPartition):
    name: str
    raster: Raster
    at: int
    count: int

    def __init__(self, name: str, raster: Raster, at: int, count: int):
        super().__init__(None)
        self.name, self.raster, self.at, self.count = name, raster, at, count


def listed(path: str) -> list[str]:
    """The raster files of a path, or the path itself."""
    found, place = store(path)
    info = found.get_file_info(place)
    if info.type == fs.FileType.File:
        for label in (re.sub(r"\.[^./]*$", "", path) + end for end in (".xml", ".lbl")):  # it speaks for its values
            if found.get_file_info(store(label)[1]).type == fs.FileType.File:
                return [label]
        return [path]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    names = [f.path for f in found.get_file_info(fs.FileSelector(place, recursive=True)) if f.type == fs.FileType.File]
    stem = lambda n: n.rsplit("/", 1)[0] + "/" + n.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    labels = {stem(n): n for n in names if n.lower().endswith((".xml", ".lbl"))}
    data = [n for n in names if not n.rsplit("/", 1)[-1].startswith((".", "_")) and not n.lower().endswith((".hdr", ".xml", ".lbl", ".aux", ".tfw", ".prj", ".ovr", ".crc")) and stem(n) not in labels]
    prefix = path[: len(path.rstrip("/")) - len(place.rstrip("/"))] if path.rstrip("/").endswith(place.rstrip("/")) else ""
    return sorted(prefix + n for n in [*data, *labels.values()])


class RasterReader(DataSourceReader):
    def __init__(self, format: str, options: dict):
        self.format, self.path = format, options["path"]
        self.bands = [int(b) for b in options["bands"].split(",")] if options.get("bands") else None
        self.size = int(options.get("blockbytes", BLOCK))
        self.scaled = str(options.get("scaled", "false")).lower() == "true"
        self.own = {k: v for k, v in options.items() if k in ("variable",)} | ({"hdu": int(options["hdu"])} if "hdu" in options else {}) | ({"axes": [int(a) for a in options["axes"].split(",")]} if "axes" in options else {})
        (y0, y1), (x0, x1) = ((int(v) for v in options.get(k, f"{-(2**30)}:{2**30}").split(":")) for k in ("lines", "columns"))
        self.low, self.high = {"y": y0, "x": x0}, {"y": y1 - 1, "x": x1 - 1}

    def partitions(self) -> Sequence[InputPartition]:
        names = listed(self.path)
        with ThreadPoolExecutor(16) as pool:
            rasters = list(pool.map(lambda n: open_raster(n, self.format, self.scaled, **self.own), names))
        lines = (self.low["y"], self.high["y"] + 1)
        return [Block(n, r.part(at, count), at, count) for n, r in zip(names, rasters, strict=True) for at, count in r.blocks(self.size, lines)]

    def read(self, partition: Block) -> Iterator[pa.RecordBatch]:
        yield from batches_of(partition.raster, partition.name, partition.at, partition.count, self.bands, (self.low["x"], self.high["x"] + 1))


class PushingReader(RasterReader):
    """A reader that filters narrow."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Bounds of y and x; Spark tests all filters again."""
        for f in filters:
            axis = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if axis not in self.low:
                yield f
                continue
            if isinstance(f, EqualTo | EqualNullSafe) and f.value is not None:
                self._within(axis, f.value, f.value)
            elif isinstance(f, In) and all(v is not None for v in f.value):
                self._within(axis, min(f.value, default=0), max(f.value, default=-1))
            elif isinstance(f, GreaterThan | GreaterThanOrEqual):
                self._within(axis, f.value + isinstance(f, GreaterThan), self.high[axis])
            elif isinstance(f, LessThan | LessThanOrEqual):
                self._within(axis, self.low[axis], f.value - isinstance(f, LessThan))
            yield f

    def _within(self, axis: str, low: int, high: int) -> None:
        self.low[axis], self.high[axis] = max(self.low[axis], low), min(self.high[axis], high)


@dataclass
class Lines(WriterCommitMessage):
    """Ranges of lines (from, before) that a task wrote."""

    ranges: list[tuple[int, int]]


class RasterWriter(DataSourceArrowWriter):
    def __init__(self, layout: Layout, target: str, overwrite: bool):
        self.layout, self.target = layout, target
        if os.path.exists(target) and not overwrite:
            raise FileExistsError(f"{target} is there; overwrite it or choose another name")
        os.makedirs(os.path.dirname(target), exist_ok=True)
        self.hidden = f"{os.path.dirname(target)}/.{os.path.basename(target)}-{uuid.uuid4().hex}"
        with open(self.hidden, "wb") as file:
            file.truncate(layout.length)

    @property
    def missing(self) -> float:
        r = self.layout.raster
        return r.ignore[0] if r.ignore else np.nan if np.dtype(r.kind).kind == "f" else 0

    def _put(self, file, first: int, block: np.ndarray) -> None:
        """[line][sample][band] from a line on, in the file's order."""
        r = self.layout.raster
        line, _, band = r.steps
        values = block.astype(r.kind)
        if band > line:
            for b in range(r.bands):
                os.pwrite(file.fileno(), values[:, :, b].tobytes(), r.offset + b * band + first * line)
        else:
            os.pwrite(file.fileno(), (values.transpose(0, 2, 1) if band > r.steps[1] else values).tobytes(), r.offset + first * line)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Lines:
        r = self.layout.raster
        missing = self.missing
        held: dict[int, np.ndarray] = {}
        done: set[int] = set()
        most = max(1, FLUSH // (8 * r.width * r.bands))

        def flush(file, keep: int | None) -> None:
            own = sorted(y for y in held if y != keep)
            for run in np.split(own, np.flatnonzero(np.diff(own) > 1) + 1) if own else []:
                block = np.stack([held.pop(int(y)) for y in run])
                self._put(file, int(run[0]), np.where(np.isfinite(block), block, missing))
            done.update(own)

        with open(self.hidden, "r+b") as file:
            for batch in iterator:
                y, x, spectra = batch.column("y").to_numpy(), batch.column("x").to_numpy(), batch.column("spectrum")
                if len(y) and (y.min() < 0 or y.max() >= r.height or x.max() >= r.width):
                    raise ValueError("a pixel outside the raster")
                pixels = np.flatnonzero((x >= 0) & (np.array(spectra.is_valid())))
                values = spectra.take(pa.array(pixels)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
                if len(values) != len(pixels) * r.bands:
                    raise ValueError(f"spectra of {r.bands} bands are written")
                values = values.reshape(len(pixels), r.bands)
                for line in np.unique(y):
                    if int(line) in done:
                        raise ValueError(f"the rows of line {line} don't come together; write_file sorts them")
                    held.setdefault(int(line), np.full((r.width, r.bands), np.nan))
                rows = y[pixels]
                for line in np.unique(rows):
                    own = np.flatnonzero(rows == line)
                    held[int(line)][x[pixels[own]]] = values[own]
                if len(held) > most:
                    flush(file, int(y[-1]))
            flush(file, None)
        lines = sorted(done)
        return Lines([(int(run[0]), int(run[-1]) + 1) for run in np.split(lines, np.flatnonzero(np.diff(lines) > 1) + 1)] if lines else [])

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        r = self.layout.raster
        ranges = sorted(x for m in messages if m is not None for x in m.ranges)
        try:
            if any(a[1] > b[0] for a, b in zip(ranges, ranges[1:], strict=False)):
                raise ValueError("two tasks wrote one line; write_file deals lines to tasks")
            with open(self.hidden, "r+b") as file:
                at = 0
                for first, last in [*ranges, (r.height, r.height)]:  # lines without a pixel
                    for line in range(at, first):
                        self._put(file, line, np.full((1, r.width, r.bands), self.missing))
                    at = last
                os.pwrite(file.fileno(), self.layout.head, 0)
                os.pwrite(file.fileno(), self.layout.tail, self.layout.length)
                os.fsync(file.fileno())
            for name, content in self.layout.aside.items():
                put(name, content)
            os.replace(self.hidden, self.target)
        except BaseException:
            self.abort(messages)
            raise

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        if os.path.exists(self.hidden):
            os.remove(self.hidden)


class RasterSource(DataSource):
    """Options of writing: width, height, bands, and kind, interleave, ignore, gt, wavelengths, unit, names, projection."""

    format = "raster"

    @classmethod
    def name(cls) -> str:
        return cls.format

    def schema(self) -> str:
        return PIXELS

    def reader(self, schema: StructType) -> RasterReader:
        kind = PushingReader if str(self.options.get("pushdown", "false")).lower() == "true" else RasterReader
        return kind(self.format, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> RasterWriter:
        if self.format not in LAYOUTS:
            raise ValueError(f"choose a format to write: {', '.join(LAYOUTS)}")
        found, _ = store(self.options["path"])
        if not isinstance(found, fs.LocalFileSystem):
            raise ValueError("one file from many tasks needs a folder that all of them mount; envi.write_raster writes a raster of each block")
        return RasterWriter(layout_of(self.format, dict(self.options)), local_path(self.options["path"]), overwrite)


def layout_of(format: str, options: dict) -> Layout:
    width, height, bands = (int(options[k]) for k in ("width", "height", "bands"))
    kind, interleave = np.dtype(options.get("kind", "f4")).newbyteorder("<"), options.get("interleave", "bsq")
    if format == "fits":
        kind = kind.newbyteorder(">")
    numbers = lambda k: tuple(json.loads(options[k])) if options.get(k) else ()
    missing = float(options.get("ignore") or ignore_value_for(kind.str))
    raster = Raster(
        local_path(options["path"]), format, width, height, bands, kind.str, 0, steps_of(interleave, width, height, bands, kind.itemsize), gt=numbers("gt") or None, projection=options.get("projection"),
        ignore=(missing,), names=numbers("names"), wavelengths=numbers("wavelengths"), unit=options.get("unit"), good=numbers("good"),
    )
    return LAYOUTS[format](replace(raster, kind=kind.str), interleave)


SOURCES = [RasterSource, *(type(f"{n.title()}Source", (RasterSource,), {"format": n, "__module__": __name__}) for n in openers())]
globals().update({c.__name__: c for c in SOURCES})


def register(spark: SparkSession) -> None:
    """Makes the formats known to a session, and lets it hand filters to those readers that ask for them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in SOURCES:
        spark.dataSource.register(source)


def write_file(cube: DataFrame, path: str, format: str = "envi", lines: int | None = None, **options) -> None:
    """A cube (y, x, spectrum) as one raster file, filled by as many tasks as there are blocks of ``lines``.

    ``options`` are those of RasterSource; lists may be given as they are. Pixels that the cube lacks and missing values
    are the ignore value.
    """
    register(cube.sparkSession)
    width, height, bands = (int(options[k]) for k in ("width", "height", "bands"))
    lines = lines or max(1, BLOCK // (8 * width * bands))
    marks = cube.sparkSession.range(0, height, lines).select(F.col("id").cast("int").alias("y"), F.lit(-1).alias("x"), F.lit(None).cast("array<double>").alias("spectrum"))
    rows = cube.select(F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col("spectrum").cast("array<double>").alias("spectrum")).unionByName(marks)
    tasks = -(-height // lines)
    dealt = rows.repartitionByRange(tasks, F.floor(F.col("y") / lines)).sortWithinPartitions("y") if tasks > 1 else rows.coalesce(1).sortWithinPartitions("y")
    told = {k: v if isinstance(v, str) else json.dumps(v) for k, v in options.items() if v is not None}
    dealt.write.format(format).options(**told).mode("overwrite").save(path)
