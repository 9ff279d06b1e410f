"""FITS files: images as rasters and as spectra, binary tables as rows.

A header is cards of 80 characters in blocks of 2880; values are big-endian. The first axis runs fastest and is x, the
second y (in the order of the file), the third the bands; ``axes`` chooses others. Axes of one value are left out.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.sources.envi import store
from lumenfold.sources.rasters import Layout, NotThisFormat, Raster, data_files

CARDS = 2880
# Types of images by BITPIX, and of table columns by their letter.
IMAGES = {8: "u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}
COLUMNS = {"L": ("S1", T.BooleanType()), "B": ("u1", T.LongType()), "I": (">i2", T.LongType()), "J": (">i4", T.LongType()), "K": (">i8", T.LongType()), "E": (">f4", T.DoubleType()), "D": (">f8", T.DoubleType()), "A": ("S", T.StringType())}


def _value(text: str):
    text = text.strip()
    if text.startswith("'"):
        return re.match(r"'((?:[^']|'')*)", text)[1].replace("''", "'").rstrip()
    text = text.split("/")[0].strip()
    if text in ("T", "F"):
        return text == "T"
    for kind in (int, float):
        try:
            return kind(text.replace("D", "E") if kind is float else text)
        except ValueError:
            continue
    return text or None


def units(file: pa.NativeFile) -> list[tuple[dict, int, int]]:
    """(header, offset of the values, their bytes) of each unit of a file; headers only are read."""
    size, at, out = file.size(), 0, []
    while at < size:
        head: dict = {}
        while True:
            block = file.read_at(CARDS, at)
            if len(block) < CARDS:
                raise ValueError("the header has no end")
            at += CARDS
            cards = [block[i : i + 80].decode("ascii", "replace") for i in range(0, CARDS, 80)]
            for card in cards:
                if card[8:10] == "= ":
                    head.setdefault(card[:8].strip(), _value(card[10:]))
            if any(c.rstrip() == "END" for c in cards):
                break
        shape = [head.get(f"NAXIS{i}", 0) for i in range(1, head.get("NAXIS", 0) + 1)]
        length = abs(head.get("BITPIX", 8)) // 8 * head.get("GCOUNT", 1) * (head.get("PCOUNT", 0) + int(np.prod(shape, dtype=object))) if shape else 0
        out.append((head, at, length))
        at += -(-length // CARDS) * CARDS
    return out


def _unit(file: pa.NativeFile, hdu: int | None, image: bool) -> tuple[dict, int, int]:
    if file.read_at(9, 0) != b"SIMPLE  =":
        raise NotThisFormat("no SIMPLE card")
    found = units(file)
    fits = lambda h: (h.get("XTENSION", "IMAGE") == "IMAGE") == image and (h.get("NAXIS", 0) > 0 if image else h.get("XTENSION") == "BINTABLE")
    chosen = [u for i, u in enumerate(found) if fits(u[0]) and hdu in (None, i)]
    if not chosen:
        raise ValueError("no such image" if image else "no such table")
    return chosen[0]


def opened(file: pa.NativeFile, path: str, whole: Callable[[str], bytes], hdu: int | None = None, axes: Sequence[int] | None = None) -> Raster:
    """``axes`` are the numbers (from 1) of x, y and, where there is one, the bands."""
    head, offset, _ = _unit(file, hdu, image=True)
    shape = [head[f"NAXIS{i}"] for i in range(1, head["NAXIS"] + 1)]
    kind = np.dtype(IMAGES[head["BITPIX"]])
    step = [int(kind.itemsize * np.prod(shape[:i], dtype=object)) for i in range(len(shape))]
    if axes is None:
        long = [i for i, n in enumerate(shape) if n > 1]
        if len(long) > 3:
            raise ValueError(f"{len(long)} axes: choose x, y and bands")
        chosen = (long if len(long) == 3 else [i for i in range(len(shape))][:3])
    else:
        chosen = [a - 1 for a in axes]
        if len(set(chosen)) < len(chosen) or not all(0 <= a < len(shape) for a in chosen) or len(chosen) not in (2, 3):
            raise ValueError(f"axes {list(axes)} of {len(shape)}")
        if any(n > 1 for i, n in enumerate(shape) if i not in chosen):
            raise ValueError("an axis that isn't chosen has more than one value")
    of = lambda k: (shape[chosen[k]], step[chosen[k]]) if k < len(chosen) else (1, 0)
    (w, sample), (h, line), (n, band) = of(0), of(1), of(2)
    gt = None
    if {"CRVAL1", "CRPIX1", "CRVAL2", "CRPIX2"} <= set(head) and axes is None:
        dx, dy = head.get("CDELT1", head.get("CD1_1", 1.0)), head.get("CDELT2", head.get("CD2_2", 1.0))
        gt = tuple(float(v) for v in (head["CRVAL1"] - (head["CRPIX1"] - 0.5) * dx, dx, 0, head["CRVAL2"] - (head["CRPIX2"] - 0.5) * dy, 0, dy))
    waves = tuple(float(head["CRVAL3"] + (b + 1 - head.get("CRPIX3", 1)) * head.get("CDELT3", 1)) for b in range(n)) if "CRVAL3" in head and axes is None and n > 1 else ()
    ignore = (float(head["BLANK"]),) if "BLANK" in head and kind.kind != "f" else ()
    scale, shift = float(head.get("BSCALE", 1)), float(head.get("BZERO", 0))
    unsigned = scale == 1 and abs(shift) == 2.0 ** (8 * kind.itemsize - 1) and kind.kind != "f"  # how the format writes the other kind of integers
    return Raster(path, "fits", w, h, n, kind.str, offset, (line, sample, band), gt=gt, ignore=ignore, scale=scale, shift=shift, scaled=unsigned, wavelengths=waves, unit=head.get("CUNIT3"))


def _card(key: str, value) -> str:
    text = ("T" if value else "F") if isinstance(value, bool) else repr(value).upper() if isinstance(value, float) else str(value)
    return (f"{key:<8}= '{value:<8}'" if isinstance(value, str) else f"{key:<8}= {text:>20}").ljust(80)


def layout(raster: Raster, interleave: str) -> Layout:
    kinds = {np.dtype(v): k for k, v in IMAGES.items()}
    kind = np.dtype(raster.kind).newbyteorder(">")
    if kind not in kinds or interleave != "bsq":
        raise ValueError(f"the format has no type {raster.kind} in order {interleave}")
    shape = [raster.width, raster.height, raster.bands]
    cards = {"SIMPLE": True, "BITPIX": kinds[kind], "NAXIS": 3} | {f"NAXIS{i}": n for i, n in enumerate(shape, 1)}
    if raster.ignore and kind.kind != "f":
        cards["BLANK"] = int(raster.ignore[0])
    if raster.gt is not None:
        g = raster.gt
        cards |= {"CRPIX1": 0.5, "CRVAL1": float(g[0]), "CDELT1": float(g[1]), "CRPIX2": 0.5, "CRVAL2": float(g[3]), "CDELT2": float(g[5])}
    w = raster.wavelengths
    if len(w) > 1 and np.allclose(np.diff(w), w[1] - w[0], rtol=1e-9):
        cards |= {"CRPIX3": 1.0, "CRVAL3": float(w[0]), "CDELT3": float(w[1] - w[0])} | ({"CUNIT3": raster.unit} if raster.unit else {})
    text = "".join(_card(k, v) for k, v in cards.items()) + "END".ljust(80)
    head = text.ljust(-(-len(text) // CARDS) * CARDS).encode()
    length = raster.width * raster.height * raster.bands * kind.itemsize
    return Layout(replace(raster, offset=len(head), ignore=() if kind.kind == "f" else raster.ignore), head, b"\0" * (-length % CARDS))  # fractions that are missing are NaN


def read_spectra(spark: SparkSession, path: str, varying: int = 0, x_axis: int = 0, suffix: str = "") -> DataFrame:
    """(path, spec_id, name, wavelengths, values): an image of two axes as spectra.

    With ``varying`` 0 each column of the image is a series, with 1 each line; the series number ``x_axis`` holds the
    wavelengths of all others, which are named by the file, the suffix and a number. A file is read whole, as its
    spectra share their wavelengths.
    """
    if varying not in (0, 1):
        raise ValueError("the axis is 0 or 1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch["path"].to_pylist():
                found, place = store(name)
                with found.open_input_file(place) as file:
                    raster = opened(file, name, lambda _: b"")
                    if raster.bands > 1:
                        raise ValueError(f"{name}: spectra have two axes")
                    values = raster.read(file, 0, raster.height)[:, :, 0]
                series = values.T if varying == 0 else values
                if not 0 <= x_axis < len(series):
                    raise ValueError(f"{name}: no series {x_axis} of {len(series)}")
                own = re.sub(r"\.[^.]*$", "", name.rsplit("/", 1)[-1]) + (f"_{suffix}" if suffix else "")
                rest = [i for i in range(len(series)) if i != x_axis]
                lists = lambda rows: pa.array([[None if np.isnan(v) else float(v) for v in r] for r in rows], pa.list_(pa.float64()))
                yield pa.record_batch([pa.array([name] * len(rest)), pa.array(range(len(rest)), pa.int64()), pa.array([f"{own}_{i}" for i in range(len(rest))]), lists([series[x_axis]] * len(rest)), lists(series[rest])], names=["path", "spec_id", "name", "wavelengths", "values"])

    return data_files(spark, path).mapInArrow(run, "path string, spec_id long, name string, wavelengths array<double>, values array<double>")


def _fields(head: dict) -> list[tuple[str, int, str, int, bool]]:
    """(name, values, letter, bytes, whether it holds fractions) of each column."""
    out = []
    for i in range(1, head["TFIELDS"] + 1):
        count, letter = re.match(r"(\d*)([A-Z])", head[f"TFORM{i}"]).groups()
        if letter not in COLUMNS:
            raise ValueError(f"column {i} has a type that isn't read here: {head[f'TFORM{i}']}")
        n = int(count or 1)
        size = n if letter == "A" else n * np.dtype(COLUMNS[letter][0]).itemsize
        fractions = letter in "ED" or float(head.get(f"TSCAL{i}", 1)) != 1 or float(head.get(f"TZERO{i}", 0)) % 1 != 0
        out.append((head.get(f"TTYPE{i}", f"col{i}"), n, letter, size, fractions and letter not in "AL"))
    return out


def read_table(spark: SparkSession, path: str, hdu: int | None = None, rows: int = 100_000) -> DataFrame:
    """The rows of binary tables below a path (all of one form), with ``path`` and ``row``; blocks of rows are tasks.

    Columns of several values are arrays. TSCAL, TZERO and TNULL hold; a NaN is NULL.
    """
    files = data_files(spark, path)
    at = files.agg(F.min("path")).first()[0]
    if at is None:
        return spark.createDataFrame([], "path string, row long")
    found, place = store(at)
    with found.open_input_file(place) as file:
        form = _fields(_unit(file, hdu, image=False)[0])
    schema = T.StructType().add("path", "string").add("row", "long")
    for name, n, letter, _, fractions in form:
        kind = T.DoubleType() if fractions else COLUMNS[letter][1]
        schema.add(name, kind if n == 1 or letter == "A" else T.ArrayType(kind))

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch["path"].to_pylist():
                found, place = store(name)
                with found.open_input_file(place) as file:
                    count = _unit(file, hdu, image=False)[0]["NAXIS2"]
                firsts = list(range(0, count, rows))
                yield pa.record_batch([pa.array([name] * len(firsts), pa.string()), pa.array(firsts, pa.int64())], names=["path", "first"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task in batch.to_pylist():
                found, place = store(task["path"])
                with found.open_input_file(place) as file:
                    head, offset, _ = _unit(file, hdu, image=False)
                    count = min(rows, head["NAXIS2"] - task["first"])
                    if _fields(head) != form:
                        raise ValueError(f"{task['path']}: a table of another form")
                    data = file.read_at(count * head["NAXIS1"], offset + task["first"] * head["NAXIS1"])
                columns, place = [pa.array([task["path"]] * count), pa.array(np.arange(task["first"], task["first"] + count))], 0
                for i, (_, n, letter, size, fractions) in enumerate(form, 1):
                    kind = np.dtype(f"S{n}") if letter == "A" else np.dtype(COLUMNS[letter][0])
                    shape, steps = ((count,), (head["NAXIS1"],)) if letter == "A" else ((count, n), (head["NAXIS1"], kind.itemsize))
                    raw = np.ndarray(shape, kind, data, place, steps) if size else np.zeros(shape, kind)
                    columns.append(_column(raw, letter, n, fractions, head, i))
                    place += size
                yield pa.record_batch(columns, names=[f.name for f in schema])

    tasks = files.mapInArrow(plan, "path string, first long")
    return tasks.repartition(max(1, min(50_000, tasks.count()))).mapInArrow(run, schema)


def _column(raw: np.ndarray, letter: str, n: int, fractions: bool, head: dict, i: int) -> pa.Array:
    if letter == "A":
        return pa.array([v.split(b"\0")[0].decode("ascii", "replace").rstrip() for v in raw.tolist()], pa.string())
    if letter == "L":
        flat = pa.array([{b"T": True, b"F": False}.get(v) for v in raw.ravel().tolist()], pa.bool_())
    else:
        missing = np.isnan(raw) if raw.dtype.kind == "f" else raw == head[f"TNULL{i}"] if f"TNULL{i}" in head else np.zeros(raw.shape, bool)
        scale, shift = head.get(f"TSCAL{i}", 1), head.get(f"TZERO{i}", 0)
        values = raw.astype(np.float64) * scale + shift if fractions else raw.astype(np.int64) + int(shift)
        flat = pa.array(values.ravel(), mask=missing.ravel())
    return flat if n == 1 else pa.ListArray.from_arrays(pa.array(np.arange(len(raw) + 1, dtype=np.int32) * n), flat)
