"""Classic NetCDF files (versions 1, 2 and 5): variables of fixed size or by records, and the choice of one by its name.

Without a name, the variable that looks most like a reflectance is read: words in its name and description score, and so
does the likeness of parts of the name with the words, by their longest matching blocks.
"""

from __future__ import annotations

import difflib
import re
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lumenfold.sources.envi import store
from lumenfold.sources.rasters import Layout, NotThisFormat, Raster, data_files, moved, steps_of

# Types by their codes; attributes of missing values and of the map, in order; words that score, with their weights.
TYPES = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: "u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
NODATA = ("_FillValue", "missing_value", "data_ignore_value", "NoDataValue", "no_data_value", "nodata")
WORDS = {"reflectance": 5, "refl": 4, "surface_reflectance": 4, "reflectance_img": 3, "refl_img": 2, "sr": 1}
ALIKE = 0.72
WAVELENGTHS = ("wavelengths", "wavelength")
HEADER = 1 << 26  # bytes of a header at most


@dataclass(frozen=True)
class Variable:
    name: str
    dims: tuple[str, ...]
    shape: tuple[int, ...]
    kind: str
    offset: int
    steps: tuple[int, ...]  # bytes along each dimension
    attributes: dict = field(default_factory=dict)


class _Reader:
    """Big-endian words of a header, more of which is read where needed."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.data, self.at = file, b"", 0

    def take(self, n: int) -> bytes:
        while len(self.data) < self.at + n:
            more = self.file.read_at(max(65_536, len(self.data)), len(self.data))
            if not more or len(self.data) > HEADER:
                raise ValueError("the header has no end")
            self.data += more
        self.at += n
        return self.data[self.at - n : self.at]

    def word(self) -> int:
        return struct.unpack(">I", self.take(4))[0]

    def long(self) -> int:
        return struct.unpack(">Q", self.take(8))[0]


def header(file: pa.NativeFile) -> tuple[dict, dict[str, Variable]]:
    """(attributes of the file, variables by name)"""
    r = _Reader(file)
    if file.size() < 8 or r.take(3) != b"CDF":
        raise NotThisFormat("no mark of the classic format")
    version = r.take(1)[0]
    if version not in (1, 2, 5):
        raise NotThisFormat(f"version {version}")
    number = r.long if version == 5 else r.word
    place = r.word if version == 1 else r.long

    def text() -> str:
        n = number()
        return r.take(-(-n // 4) * 4)[:n].decode("utf-8", "replace")

    def values() -> str | list:
        kind = r.word()
        n = number()
        dtype = np.dtype(TYPES[kind])
        raw = r.take(-(-n * dtype.itemsize // 4) * 4)[: n * dtype.itemsize]
        return raw.decode("utf-8", "replace").rstrip("\0") if kind == 2 else np.frombuffer(raw, dtype).tolist()

    def listed(one: Callable) -> list:
        r.word()  # the kind of the list
        return [one() for _ in range(number())]

    records = number()
    dims = listed(lambda: (text(), number()))
    about = dict(listed(lambda: (text(), values())))
    raw = listed(lambda: (text(), [number() for _ in range(number())], dict(listed(lambda: (text(), values()))), r.word(), number(), place()))
    by_record = [v for v in raw if v[1] and dims[v[1][0]][1] == 0]
    size = lambda v: int(np.dtype(TYPES[v[3]]).itemsize * np.prod([dims[d][1] for d in v[1][1:]], dtype=object))
    record = size(by_record[0]) if len(by_record) == 1 else sum(-(-size(v) // 4) * 4 for v in by_record)
    out = {}
    for name, ids, attributes, kind, _, begin in raw:
        own = [dims[d][1] for d in ids]
        dtype = np.dtype(TYPES[kind])
        steps = [int(dtype.itemsize * np.prod(own[i + 1 :], dtype=object)) for i in range(len(own))]
        if ids and own[0] == 0:
            if records in (0xFFFFFFFF, 0xFFFFFFFFFFFFFFFF):  # told by the length of the file
                records = max(0, file.size() - min(v[5] for v in by_record)) // record
            own[0], steps[0] = records, record
        out[name] = Variable(name, tuple(dims[d][0] for d in ids), tuple(own), dtype.str, begin, tuple(steps), attributes)
    return about, out


def score(name: str, description: str = "") -> int:
    """How much a variable looks like a reflectance."""
    name, description = name.lower(), description.lower()
    parts = [p for p in re.split(r"[/_ ]", name) if p]
    total = 0
    for word, weight in WORDS.items():
        total += weight * (6 * (word in name) + 3 * (word in description))
        alike = max((difflib.SequenceMatcher(None, word, p).ratio() for p in parts), default=0.0)
        total += int(alike * 10) * weight if alike >= ALIKE else 0
    return total


def _told(v: Variable) -> str:
    return " ".join(str(v.attributes[k]) for k in ("standard_name", "long_name") if k in v.attributes)


def rasters_of(variables: dict[str, Variable]) -> list[Variable]:
    """Variables with at least two dimensions of numbers."""
    return [v for v in variables.values() if 2 <= len(v.shape) <= 3 and v.kind != "|S1" and min(v.shape) > 0]


def named(variables: dict[str, Variable], *parts: str) -> Variable | None:
    """The first raster whose name holds one of ``parts``."""
    return next((v for v in rasters_of(variables) if any(p in v.name for p in parts)), None)


def opened(file: pa.NativeFile, path: str, whole: Callable[[str], bytes], variable: str | None = None) -> Raster:
    """The last two dimensions are y and x and the first the bands, unless a dimension's name tells of bands or wavelengths."""
    about, variables = header(file)
    found = rasters_of(variables)
    if variable is not None:
        found = [v for v in found if v.name == variable.strip("/")]
    if not found:
        raise ValueError(f"{path}: no variable {variable or 'of two dimensions'}")
    v = max(found, key=lambda v: score(v.name, _told(v)))
    band = next((i for i, d in enumerate(v.dims) if re.search(r"band|wave", d.lower())), 0) if len(v.shape) == 3 else None
    y, x = [i for i in range(len(v.shape)) if i != band]
    bands, step = (1, 0) if band is None else (v.shape[band], v.steps[band])
    ignore = next(((float(np.ravel(v.attributes[k])[0]),) for k in NODATA if k in v.attributes and not isinstance(v.attributes[k], str)), ())
    told = next((variables[n] for n in WAVELENGTHS if n in variables), None)
    waves: tuple[float, ...] = ()
    if told is not None and told.shape == (bands,):
        raw = file.read_at((bands - 1) * told.steps[0] + np.dtype(told.kind).itemsize, told.offset)
        waves = tuple(float(w) for w in np.ndarray((bands,), told.kind, raw, 0, told.steps))
    gt = about.get("geotransform")
    if isinstance(gt, str):
        parts = [p for p in gt.strip().strip("{}").split(",") if p.strip()]
        try:
            gt = [float(p) for p in parts]
        except ValueError:
            gt = None
    scale, shift = (float(np.ravel(v.attributes.get(k, d))[0]) for k, d in (("scale_factor", 1), ("add_offset", 0)))
    unit = told.attributes.get("units") if told is not None else None
    return Raster(
        path, "netcdf", v.shape[x], v.shape[y], bands, v.kind, v.offset, (v.steps[y], v.steps[x], step), gt=tuple(float(g) for g in gt) if gt is not None and len(gt) == 6 else None,
        projection=about.get("spatial_ref"), ignore=ignore, scale=scale, shift=shift, names=(), wavelengths=waves, unit=unit or ("nm" if waves else None), tags={"variable": v.name},
    )


def read_variables(spark: SparkSession, path: str) -> DataFrame:
    """(path, variable, shape, description, score) of the rasters in each file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name in pdf["path"]:
                found, place = store(name)
                with found.open_input_file(place) as file:
                    try:
                        variables = header(file)[1]
                    except NotThisFormat:
                        continue
                rows = [(name, v.name, list(v.shape), _told(v), score(v.name, _told(v))) for v in rasters_of(variables)]
                yield pd.DataFrame(rows, columns=["path", "variable", "shape", "description", "score"])

    return data_files(spark, path).mapInPandas(run, "path string, variable string, shape array<long>, description string, score long")


def layout(raster: Raster, interleave: str, variable: str = "reflectance") -> Layout:
    """A file of version 5 with one variable and, where they are known, its wavelengths."""
    codes = {np.dtype(v): k for k, v in TYPES.items()}
    kind = np.dtype(raster.kind).newbyteorder(">")
    order = {"bsq": ("band", "y", "x"), "bil": ("y", "band", "x"), "bip": ("y", "x", "band")}[interleave]
    size = {"band": raster.bands, "y": raster.height, "x": raster.width}
    word, long = lambda n: struct.pack(">I", n), lambda n: struct.pack(">Q", n)
    padded = lambda b: b + b"\0" * (-len(b) % 4)
    text = lambda s: long(len(s.encode())) + padded(s.encode())

    def attribute(name: str, value: str | np.ndarray) -> bytes:
        if isinstance(value, str):
            return text(name) + word(2) + text(value)
        return text(name) + word(codes[value.dtype]) + long(value.size) + padded(value.tobytes())

    def listed(mark: int, items: list[bytes]) -> bytes:
        return word(mark if items else 0) + long(len(items)) + b"".join(items)

    about = [attribute("geotransform", np.array(raster.gt, ">f8"))] if raster.gt is not None else []
    about += [attribute("spatial_ref", raster.projection)] if raster.projection else []
    own = [attribute("_FillValue", np.array(raster.ignore[:1]).astype(kind))] if raster.ignore else []
    waves = np.array(raster.wavelengths, ">f8")
    length = raster.width * raster.height * raster.bands * kind.itemsize

    def head(start: int) -> bytes:
        dims = listed(10, [text(d) + long(size[d]) for d in order])
        variables = [text(variable) + long(3) + b"".join(long(i) for i in range(3)) + listed(12, own) + word(codes[kind]) + long(-(-length // 4) * 4) + long(start + -(-waves.nbytes // 8) * 8)]
        if waves.size:
            unit = [attribute("units", raster.unit)] if raster.unit else []
            variables.append(text("wavelengths") + long(1) + long(order.index("band")) + listed(12, unit) + word(codes[waves.dtype]) + long(waves.nbytes) + long(start))
        return b"CDF\x05" + long(0) + dims + listed(12, about) + listed(11, variables)

    start = -(-len(head(0)) // 8) * 8
    whole = head(start).ljust(start, b"\0") + waves.tobytes().ljust(-(-waves.nbytes // 8) * 8, b"\0")
    steps = steps_of(interleave, raster.width, raster.height, raster.bands, kind.itemsize)
    return Layout(moved(replace(raster, kind=kind.str, steps=steps), len(whole)), whole)
