"""Matching spectra with references: resampling, spectral angles and spectral feature fitting.

A library is dealt into blocks of at most ``LIBRARY_ROWS`` references and ``LIBRARY_BYTES``; each pixel meets a block as
one array in its own row, so scoring needs no row for a pair. A block is broadcast, since its size is known; of several,
each is met by a scan of the pixels of its own, so that the pixels are never shuffled. The best reference of a pixel is
the least of an array.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.registry import finite
from lumenfold.functions.units import LENGTHS, to_nm
from lumenfold.operators.continuum import continuum_removed

LIBRARY_ROWS, LIBRARY_BYTES = 2000, 64 << 20


def resample(refs: DataFrame, grid: DataFrame, extrapolate: bool = False) -> DataFrame:
    """(ref_id, band, value): references (ref_id, wavelength, value) linearly interpolated on (band, wavelength).

    Outside a reference's range there is no row, or its last segment goes on if ``extrapolate``. Segments and bands meet
    by cells of the grid, so this is an equi-join.
    """
    order = Window.partitionBy("ref_id").orderBy("wavelength")
    lead = [F.lead(c).over(order).alias(n) for c, n in (("wavelength", "w1"), ("value", "v1"))]
    segments = refs.select("ref_id", F.col("wavelength").alias("w0"), F.col("value").alias("v0"), *lead, F.row_number().over(order).alias("i"), F.count(F.lit(1)).over(Window.partitionBy("ref_id")).alias("n"))
    low, high = F.col("wavelength") >= F.col("w0"), F.col("wavelength") < F.col("w1")
    if extrapolate:
        segments = segments.where("w1 IS NOT NULL")
        low, high = low | (F.col("i") == 1), high | (F.col("i") == F.col("n") - 1)
    else:
        high = high | (F.col("w1").isNull() & (F.col("wavelength") == F.col("w0")))
    # a segment meets the cells that it covers, a band its own; beyond its ends a first or last one covers all cells
    limits = grid.agg(F.min("wavelength"), F.max("wavelength"), F.count(F.lit(1))).first()  # one row
    lo, hi, n = limits if limits[2] else (0.0, 0.0, 1)
    width = max((hi - lo) / n, 1e-9)
    cell = lambda c: F.least(F.greatest(F.floor((c - lo) / width), F.lit(0)), F.lit(n)).cast("int")
    begin = F.when(F.lit(extrapolate) & (F.col("i") == 1), F.lit(lo)).otherwise(F.col("w0"))
    end = F.when(F.lit(extrapolate) & (F.col("i") == F.col("n") - 1), F.lit(hi)).otherwise(F.coalesce("w1", "w0"))
    covered = segments.where((begin <= hi) & (end >= lo)).withColumn("cell", F.explode(F.sequence(cell(begin), cell(end))))
    joined = covered.join(grid.withColumn("cell", cell(F.col("wavelength"))), "cell").where(low & high)
    value = F.when(F.col("wavelength") == F.col("w0"), F.col("v0")).otherwise(F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("wavelength") - F.col("w0")) / (F.col("w1") - F.col("w0")))
    return joined.select("ref_id", "band", value.alias("value"))


def arrays(resampled: DataFrame, bands: int) -> DataFrame:
    """(ref_id, ref): resampled references as arrays of ``bands`` values, NULL where there is none."""
    held = resampled.groupBy("ref_id").agg(F.map_from_entries(F.collect_list(F.struct("band", "value"))).alias("m"))
    return held.select("ref_id", F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.col("m")[b]).alias("ref"))


def with_library(pixels: DataFrame, refs: DataFrame) -> tuple[DataFrame, int]:
    """Each pixel beside each block of the library, in one row: ``library`` is an array of structs of the columns of
    ``refs``. Also the number of blocks."""
    wide = sum((F.coalesce(F.size(f.name), F.lit(0)) for f in refs.schema if f.dataType.typeName() == "array"), F.lit(1))
    rows, values = refs.agg(F.count(F.lit(1)), F.sum(F.greatest(wide, F.lit(1)))).first()
    blocks = max(1, -(-rows // LIBRARY_ROWS), -(-8 * (values or 0) // LIBRARY_BYTES))
    dealt = refs.withColumn("_block", F.pmod(F.xxhash64("ref_id"), F.lit(blocks)).cast("int"))
    out = None
    for b in range(blocks):  # each has about as many references as another
        library = dealt.where(F.col("_block") == b).groupBy("_block").agg(F.collect_list(F.struct(*refs.columns)).alias("library"))
        met = pixels.withColumn("_block", F.lit(b)).join(F.broadcast(library), "_block").drop("_block")
        out = met if out is None else out.union(met)
    return out, blocks


def sums(t: Column, r: Column) -> tuple[Column, Column, Column, Column]:
    """t·r, t·t, r·r and the number of bands where both are there."""
    both = F.filter(F.zip_with(t, r, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda p: p.a.isNotNull() & p.b.isNotNull())
    add = lambda f: F.aggregate(both, F.lit(0.0), lambda s, p: s + f(p))
    return add(lambda p: p.a * p.b), add(lambda p: p.a * p.a), add(lambda p: p.b * p.b), F.size(both)


def degrees_between(tr: Column, tt: Column, rr: Column) -> Column:
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), tr / (F.sqrt(tt) * F.sqrt(rr))))))


def angle_of_spectrum(t: Column, r: Column) -> Column:
    """The spectrum mode: fewer than three common bands give NULL, a zero norm 90 degrees."""
    tr, tt, rr, n = sums(F.transform(t, finite), F.transform(r, finite))
    return F.when(n >= 3, F.when((tt == 0) | (rr == 0), 90.0).otherwise(degrees_between(tr, tt, rr)))


def angle_of_pixel(t: Column, r: Column) -> Column:
    """The image mode of one pair of arrays: missing values count as 0, norms are taken over the bands that the
    reference has, a zero norm gives NULL."""
    zero = lambda c: F.transform(c, lambda v: F.coalesce(finite(v), F.lit(0.0)))
    seen = F.zip_with(zero(t), F.transform(r, finite), lambda v, w: F.when(w.isNotNull(), v).otherwise(0.0))
    tr, tt, rr, _ = sums(seen, zero(r))
    return F.when((tt > 0) & (rr > 0), degrees_between(tr, tt, rr))


def dotted(a: Column, b: Column) -> Column:
    """The sum of products of arrays without missing values."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _prepared(pixels: DataFrame, refs: DataFrame, spectrum: str) -> tuple[DataFrame, int]:
    """Pixels with ``t`` (missing values as 0), ``tt`` and the library with ``r``, ``rr``, ``whole`` and ``good``: what
    a pair needs is computed once for a pixel and once for a reference."""
    zero = lambda c: F.transform(c, lambda v: F.coalesce(finite(v), F.lit(0.0)))
    good = F.transform("ref", lambda v: F.when(finite(v).isNull(), 0.0).otherwise(1.0))
    ready = refs.select("ref_id", "ref", zero(F.col("ref")).alias("r"), good.alias("good"))
    ready = ready.select("ref_id", "ref", "r", "good", dotted(F.col("r"), F.col("r")).alias("rr"), (~F.array_contains("good", F.lit(0.0))).alias("whole"))
    own = pixels.withColumn("_t", zero(F.col(spectrum))).withColumn("_tt", dotted(F.col("_t"), F.col("_t")))
    return with_library(own, ready)


def _pixel_angle(r: Column) -> Column:
    """The image mode: missing values count as 0, norms are taken over the bands that the reference has, a zero norm gives NULL."""
    tt = F.when(r["whole"], F.col("_tt")).otherwise(dotted(F.transform("_t", lambda v: v * v), r["good"]))
    return F.when((tt > 0) & (r["rr"] > 0), degrees_between(dotted(F.col("_t"), r["r"]), tt, r["rr"]))


def sam(pixels: DataFrame, refs: DataFrame, mode: str = "image", threshold: float = 5.0, spectrum: str = "spectrum") -> DataFrame:
    """(…keys, ref_id, score, is_match) for each pixel and reference (ref_id, ref on the pixels' bands, NULL where bad)."""
    keys = [c for c in pixels.columns if c != spectrum]
    joined, _ = _prepared(pixels, refs, spectrum)
    score = _pixel_angle if mode == "image" else lambda r: angle_of_spectrum(F.col(spectrum), r["ref"])
    rows = joined.select(*keys, F.inline(F.transform("library", lambda r: F.struct(r["ref_id"].alias("ref_id"), score(r).alias("score")))))
    return rows.withColumn("is_match", F.col("score") < threshold if mode == "image" else F.col("score") <= threshold)


def best_angle(pixels: DataFrame, refs: DataFrame, spectrum: str = "spectrum") -> DataFrame:
    """(…keys, ref_id, score): the reference with the least angle of each pixel in the image mode, the smaller id on
    ties; pixels without an angle are left out. No row is made for a pair."""
    keys = [c for c in pixels.columns if c != spectrum]
    joined, blocks = _prepared(pixels, refs, spectrum)
    found = F.transform("library", lambda r: F.struct(_pixel_angle(r).alias("score"), r["ref_id"].alias("ref_id")))
    rows = joined.select(*keys, F.array_min(F.filter(found, lambda x: x["score"].isNotNull())).alias("best")).where("best IS NOT NULL")
    if blocks > 1:
        rows = rows.groupBy(*keys).agg(F.min("best").alias("best"))
    return rows.select(*keys, "best.ref_id", "best.score")


def on_target_bands(refs: DataFrame, wavelengths: Sequence[float], unit: str = "nm", good: Sequence[bool] | None = None, low: float | None = None, high: float | None = None) -> tuple[DataFrame, list[int]]:
    """References (ref_id, unit, wavelengths, values, good) as (ref_id, ref) on a target's bands, and those bands' indices.

    Wavelengths of either side are taken to nanometres, references are interpolated within their range, and bands that
    are bad on either side (of a reference: where one of the two values around is) are NULL. Bands outside low to high
    (in the target's unit) are left out.
    """
    factor = LENGTHS[unit.lower()]
    kept = [i for i, w in enumerate(wavelengths) if (low is None or w >= low) and (high is None or w <= high)]
    grid = refs.sparkSession.createDataFrame([(n, float(wavelengths[i]) * factor) for n, i in enumerate(kept) if good is None or good[i]], "band int, wavelength double")
    values = F.arrays_zip("wavelengths", "values", "good")
    rows = refs.select("ref_id", "unit", F.explode(values).alias("v")).select("ref_id", to_nm(F.col("v.wavelengths"), F.col("unit")).alias("wavelength"), F.when(F.coalesce(F.col("v.good"), F.lit(True)), finite(F.col("v.values"))).alias("value"))
    return arrays(resample(rows, grid), len(kept)), kept


def sff(pixels: DataFrame, refs: DataFrame, wavelengths: Sequence[float], mode: str = "image", max_rms: float = 0.03, spectrum: str = "spectrum", good: Sequence[bool] | None = None) -> DataFrame:
    """(…keys, ref_id, scale, score, is_match): continuum-removed features fitted by one scale; the score is the RMS.

    Bands that aren't ``good`` are left out of the targets' continua and of the fit, but not of the references' continua.
    ``spectrum`` mode sums the residuals over all bands of the target and divides by those of the reference, ``image``
    mode uses the reference's bands for both.
    """
    keys = [c for c in pixels.columns if c != spectrum]
    flat = lambda c: F.transform(continuum_removed(c, wavelengths), lambda v: 1 - v)
    bad = F.array(*(F.lit(not g) for g in good)) if good is not None else None
    seen = lambda c: c if bad is None else F.zip_with(c, bad, lambda v, b: F.when(~b, v))
    library = refs.select("ref_id", seen(flat(F.col("ref"))).alias("ref"))
    targets = pixels.withColumn(spectrum, F.transform(flat(seen(F.col(spectrum))), lambda v: F.coalesce(v, F.lit(0.0))))
    rows = with_library(targets, library)[0].select(*keys, F.col(spectrum).alias("t"), F.inline("library"))
    pair = F.zip_with("t", "ref", lambda a, b: F.struct(a.alias("a"), F.coalesce(b, F.lit(0.0)).alias("b"), b.isNotNull().alias("g")))
    once = lambda c, f: F.get(F.transform(F.array(c), f), F.lit(0))  # noqa: E731  # a filter on the score would repeat named columns for every band
    add = lambda pairs, f: F.aggregate(pairs, F.lit(0.0), lambda s, p: s + f(p))
    in_sum = (lambda p: F.lit(True)) if mode == "spectrum" else (lambda p: p.g)

    def fitted(pairs: Column, scale: Column) -> Column:
        error = add(pairs, lambda p: F.when(in_sum(p), (p.a - scale * p.b) * (p.a - scale * p.b)).otherwise(0.0))
        return F.struct(scale.alias("scale"), F.sqrt(F.try_divide(error, F.size(F.filter(pairs, lambda p: p.g)).cast("double"))).alias("score"))

    scale_of = lambda pairs: F.try_divide(add(pairs, lambda p: p.a * p.b), add(pairs, lambda p: p.b * p.b))
    rows = rows.withColumn("fit", once(pair, lambda pairs: once(scale_of(pairs), lambda scale: fitted(pairs, scale))))
    out = rows.select(*keys, "ref_id", "fit.scale", "fit.score")
    return out.withColumn("is_match", F.col("score") < max_rms if mode == "image" else F.col("score") <= max_rms)


def sff_on_grid(
    pixels: DataFrame, refs: DataFrame, wavelengths: Sequence[float], unit: str = "nm", good: Sequence[bool] | None = None, low: float | None = None, high: float | None = None,
    mode: str = "image", max_rms: float = 0.03, spectrum: str = "spectrum",
) -> DataFrame:
    """From inputs to matches: references (ref_id, unit, wavelengths, values, good) of grids of their own, targets with
    all bands of ``wavelengths``, of which those that aren't ``good`` or lie outside low to high (in ``unit``) don't count."""
    on_target, kept = on_target_bands(refs, wavelengths, unit, None, low, high)
    every = len(kept) == len(wavelengths)
    targets = pixels if every else pixels.withColumn(spectrum, F.array(*(F.get(spectrum, F.lit(b)) for b in kept)))
    return sff(targets, on_target, [float(wavelengths[b]) * LENGTHS[unit.lower()] for b in kept], mode, max_rms, spectrum, None if good is None else [bool(good[b]) for b in kept])


def best_match(matches: DataFrame, keys: Sequence[str] = ("y", "x")) -> DataFrame:
    """The reference with the least score of each pixel, the smaller id on ties."""
    best = F.min(F.struct("score", "ref_id")).alias("best")
    return matches.where("score IS NOT NULL").groupBy(*keys).agg(best).select(*keys, "best.ref_id", "best.score")


def as_cube(matches: DataFrame, value: str = "score", missing: float | None = None) -> DataFrame:
    """(y, x, spectrum): one band for each reference by its id, of an output of ``sam`` or ``sff`` (score, scale or
    is_match as 0 and 1); ``missing`` takes the place of NULL."""
    cell = F.col(value).cast("double")
    pairs = F.array_sort(F.collect_list(F.struct("ref_id", (cell if missing is None else F.coalesce(cell, F.lit(missing))).alias("v"))))  # as many as references
    return matches.groupBy("y", "x").agg(F.transform(pairs, lambda p: p.v).alias("spectrum"))


def cube_bands(refs: DataFrame) -> DataFrame:
    """(band, description) of such a cube from references (ref_id, name)."""
    order = Window.orderBy("ref_id")  # as few rows as bands of one image
    return refs.select((F.row_number().over(order) - 1).cast("int").alias("band"), F.concat(F.lit("Spec: "), "name").alias("description"))
