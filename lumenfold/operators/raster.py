"""Cubes as rows of pixels: reading single values, slices, masks and simple resampling.

A packed cube has a row (…, y, x, spectrum) for each pixel; ``long`` gives a row for each band. Band-wise aggregates
use the long form; everything else stays packed, where an expression over the array needs no shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.registry import finite
from lumenfold.functions.units import LENGTHS


def long(cube: DataFrame, spectrum: str = "spectrum") -> DataFrame:
    """A row (…, band, value) for each band of each pixel."""
    keys = [c for c in cube.columns if c != spectrum]
    return cube.select(*keys, F.posexplode(spectrum).alias("band", "value"))


def packed(rows: DataFrame, keys: Sequence[str] = ("y", "x")) -> DataFrame:
    pairs = F.array_sort(F.collect_list(F.struct("band", "value")))  # a pixel has as many as there are bands
    return rows.groupBy(*keys).agg(F.transform(pairs, lambda p: p.value).alias("spectrum"))


def near(x: Column, value: float) -> Column:
    """Equal to an ignore value up to rounding."""
    return F.abs(x - value) <= 1e-8 + 1e-5 * abs(value)


def mask_values(spectrum: Column, ignore: float | None = None, good: Sequence[bool] | None = None) -> Column:
    """A spectrum with NULL where it is the ignore value, not finite, or in a bad band."""
    out = F.transform(spectrum, finite)
    if ignore is not None:
        out = F.transform(out, lambda v: F.when(~near(v, ignore), v))
    if good is not None:
        out = F.zip_with(out, F.array(*map(F.lit, good)), lambda v, g: F.when(g, v))
    return out


def window(cube: DataFrame, x: int, y: int, dx: int, dy: int) -> DataFrame:
    return cube.where(F.col("x").between(x, x + dx - 1) & F.col("y").between(y, y + dy - 1))


def band_slice(cube: DataFrame, band: int, bands: int) -> DataFrame:
    return cube.withColumn("spectrum", F.slice("spectrum", band + 1, bands))


def one_band(cube: DataFrame, band: int) -> DataFrame:
    return cube.withColumn("value", F.get("spectrum", F.lit(band))).drop("spectrum")


def some_bands(cube: DataFrame, bands: Sequence[int]) -> DataFrame:
    return cube.withColumn("spectrum", F.array(*(F.get("spectrum", F.lit(b)) for b in bands)))


def in_bounds(x: Column, y: Column, width: int, height: int) -> Column:
    return (x >= 0) & (x < width) & (y >= 0) & (y < height)


def wavelength_indices(wavelengths: Sequence[float], low: float, high: float) -> list[int]:
    """Bands with low <= wavelength <= high."""
    return [i for i, w in enumerate(wavelengths) if low <= w <= high]


def wavelength_slice(cube: DataFrame, wavelengths: Sequence[float], low: float, high: float, unit: str | None = None, limits_unit: str | None = None) -> DataFrame:
    """The bands between two wavelengths, which may be in a unit of their own."""
    if unit and limits_unit:
        wavelengths = [w * LENGTHS[unit.lower()] / LENGTHS[limits_unit.lower()] for w in wavelengths]
    return some_bands(cube, wavelength_indices(wavelengths, low, high))


def nearest_band(bands: DataFrame, wanted: DataFrame, tolerance: float = 20.0) -> DataFrame:
    """(…wanted, band, wavelength): for each wanted ``target`` the nearest band within the tolerance, the first on ties.

    Bands meet targets by cells as wide as the tolerance, so this is an equi-join.
    """
    cell = lambda c: F.floor(F.col(c) / tolerance).cast("long")
    near_by = wanted.withColumn("_cell", F.explode(F.array(cell("target") - 1, cell("target"), cell("target") + 1)))
    met = near_by.join(bands.select("band", "wavelength").withColumn("_cell", cell("wavelength")), "_cell").drop("_cell")
    met = met.where(F.abs(F.col("wavelength") - F.col("target")) <= tolerance)
    best = F.min(F.struct(F.abs(F.col("wavelength") - F.col("target")).alias("d"), "band", "wavelength")).alias("best")
    return met.groupBy(*wanted.columns).agg(best).select(*wanted.columns, "best.band", "best.wavelength")


def downsample(band: DataFrame, factor: int, keys: Sequence[str] = ()) -> DataFrame:
    """Mean of each block of factor x factor pixels."""
    y, x = (F.floor(F.col(c) / factor).cast("int").alias(c) for c in ("y", "x"))
    return band.groupBy(*keys, y, x).agg(F.avg("value").alias("value"))


def downsample_gauss(band: DataFrame, factor: float, width: int, height: int, keys: Sequence[str] = ()) -> DataFrame:
    """(…keys, y, x, value): a band of int(width / factor) x int(height / factor) pixels, weighted over blocks that overlap.

    The weights are binomial, of 3 x 3 pixels up to a factor of 2, of 5 x 5 up to 4 and of 7 x 7 beyond, around the
    middle of the block that an output pixel covers; pixels that are missing or outside share their weight among the
    others. Each pixel goes to the few outputs that its weight reaches, and one aggregate ends it.
    """
    if factor < 1 or width < factor or height < factor:
        raise ValueError("the factor is from 1 to the size of the band")
    step = max(int(0.5 + width / int(width / factor)), int(0.5 + height / int(height / factor)))
    wide = 3 if step <= 2 else 5 if step <= 4 else 7
    weights = F.array(*(F.lit(float(math.comb(wide - 1, i))) for i in range(wide)))

    def reached(c: str, size: int) -> Column:
        """(output, weight) along an axis."""
        count = int(size / factor)
        ratio = size / count
        first = lambda i: (F.floor(0.5 + i * ratio) + F.floor((F.floor(0.5 + (i + 1) * ratio) - F.floor(0.5 + i * ratio)) / 2) - wide // 2).cast("int")
        low, high = F.greatest(F.lit(0), F.floor((F.col(c) - wide) / ratio).cast("int") - 1), F.least(F.lit(count - 1), F.floor((F.col(c) + wide) / ratio).cast("int") + 1)
        near = F.filter(F.sequence(low, F.greatest(low, high)), lambda i: (i < count) & (F.col(c) >= first(i)) & (F.col(c) < first(i) + wide))
        return F.transform(near, lambda i: F.struct(i.alias("i"), F.get(weights, F.col(c) - first(i)).alias("w")))

    inside = band.where(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1)).withColumn("value", finite(F.col("value")))
    rows = inside.select(*keys, "value", reached("y", height).alias("_y"), F.explode(reached("x", width)).alias("_x")).select(*keys, "value", "_x", F.explode("_y").alias("_y"))
    weight = F.col("_x.w") * F.col("_y.w")
    known = F.when(F.col("value").isNotNull(), weight)
    return rows.groupBy(*keys, F.col("_y.i").alias("y"), F.col("_x.i").alias("x")).agg(F.try_divide(F.sum(F.col("value") * weight), F.sum(known)).alias("value"))


def normalized(band: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(value - min) / (max - min) over finite values; zeros where all are equal."""
    clean = band.withColumn("value", finite(F.col("value")))
    limits = clean.groupBy(*keys).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    joined = clean.join(limits, list(keys)) if keys else attach(clean, limits)
    flat = F.col("hi") == F.col("lo")
    return joined.withColumn("value", F.when(flat, F.when(F.col("value").isNotNull(), 0.0)).otherwise((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")))).drop("lo", "hi")


def attach(rows: DataFrame, single: DataFrame) -> DataFrame:
    """``rows`` with the columns of a one-row frame, which is read once as literals."""
    found = single.first()
    return rows.select("*", *(F.lit(found[f.name]).cast(f.dataType).alias(f.name) for f in single.schema.fields))


def spectrum_at(cube: DataFrame, x: int, y: int, width: int = 1, height: int = 1, how: str = "mean") -> DataFrame:
    """(band, value): the spectrum of a pixel, or the mean or median over an odd window around it; not NULL-skipping."""
    if width % 2 == 0 or height % 2 == 0:
        raise ValueError("width and height must be odd")
    near_by = long(window(cube, x - width // 2, y - height // 2, width, height).select("spectrum"))
    value = F.avg("value") if how == "mean" else F.median("value")
    return near_by.groupBy("band").agg(F.when(F.count("value") == F.count(F.lit(1)), value).alias("value"))


def display_bands(bands: DataFrame, defaults: Sequence[int] | None = None, tolerance: float = 20.0) -> list[int]:
    """Default bands, else those nearest to red, green and blue, else the first three, else the first."""
    if defaults:
        return list(defaults)
    wanted = bands.sparkSession.createDataFrame([("red", 700.0), ("green", 530.0), ("blue", 470.0)], "channel string, target double")
    found = {r["channel"]: r["band"] for r in nearest_band(bands, wanted, tolerance).collect()}  # at most three rows
    if len(found) == 3:
        return [found[c] for c in ("red", "green", "blue")]
    first = [r["band"] for r in bands.select("band").orderBy("band").limit(3).collect()]
    return first if len(first) == 3 else first[:1]


def subset_bands(bands: DataFrame, low: float, high: float) -> DataFrame:
    """Bands between two stored wavelengths, numbered anew."""
    kept = bands.where(F.col("wavelength").between(low, high))
    return kept.withColumn("band", (F.row_number().over(Window.partitionBy("ds_id").orderBy("band")) - 1).cast("int"))


def exact_subset(bands: DataFrame, low: float, high: float) -> DataFrame:
    """Bands between two wavelengths that each dataset must have exactly, numbered anew, with ``first``, the band that
    is 0 now, and ``size``, how many there are. A dataset that lacks one of them raises."""
    own = Window.partitionBy("ds_id")
    at = lambda w: F.min(F.when(F.col("wavelength") == w, F.col("band"))).over(own)
    ends = bands.withColumn("_a", at(low)).withColumn("_b", at(high))
    lacks = F.col("_a").isNull() | F.col("_b").isNull()
    told = F.when(lacks, F.raise_error(F.concat(F.lit(f"no band at exactly {low} or {high} in dataset "), F.col("ds_id")))).otherwise(F.least("_a", "_b"))
    kept = ends.withColumn("first", told.cast("int")).withColumn("_b", F.greatest("_a", "_b")).where(F.col("band").between(F.col("first"), F.col("_b")))
    return kept.withColumn("size", (F.col("_b") - F.col("first") + 1).cast("int")).withColumn("band", (F.col("band") - F.col("first")).cast("int")).drop("_a", "_b")


def moved_display(shown: Column, first: Column, size: Column) -> Column:
    """Display bands of a subset: those of the whole less the first, or the first three if one of them isn't there."""
    moved = F.transform(shown, lambda b: (b - first).cast("int"))
    fits = (F.size(moved) > 0) & F.forall(moved, lambda b: (b >= 0) & (b < size))
    return F.when(fits, moved).otherwise(F.when(size > 0, F.sequence(F.lit(0), F.least(size, F.lit(3)) - 1)).otherwise(F.array().cast("array<int>")))


def band_mean(spectrum: Column) -> Column:
    """The mean over the bands that are there."""
    there = F.filter(F.transform(spectrum, finite), lambda v: v.isNotNull())
    return F.try_divide(F.aggregate(there, F.lit(0.0), lambda s, v: s + v), F.size(there).cast("double"))


def good_bands(spectrum: Column) -> Column:
    """How many bands are there."""
    return F.size(F.filter(F.transform(spectrum, finite), lambda v: v.isNotNull()))


def first_masked(spectrum: Column) -> Column:
    """The index of the first missing band, NULL if none is."""
    at = F.array_position(F.transform(spectrum, lambda v: finite(v).isNull()), True)
    return F.when(at > 0, at - 1).cast("int")


def in_spatial_bounds(gx: Column, gy: Column, gt: Sequence[float], width: int, height: int) -> Column:
    """Whether a place lies in the box of a raster's corners, the edges included; a rotation of the raster doesn't count."""
    (x0, x1), (y0, y1) = (sorted((gt[i], gt[i] + gt[j] * n)) for i, j, n in ((0, 1, width), (3, 5, height)))
    return gx.between(x0, x1) & gy.between(y0, y1)
