"""Queries of typed and saved results, listed points, exports, down-sampling and damaged files, each with its SQL."""

from __future__ import annotations

from uuid import uuid4

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.operators import raster, roi
from lumenfold.operators.bandmath import Image, compute
from lumenfold.plans.inputs import SQL, WAVELENGTHS, cube, image, references
from lumenfold.plans.more_queries import _points
from lumenfold.session import scratch
from lumenfold.sources import datasource, rasters, spectra_text
from lumenfold.sources.envi import put
from lumenfold.streaming import raster_stream

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, f"WITH {SQL}{sql}"
        return f

    return add


def _height(rows: DataFrame) -> int:
    return (rows.agg(F.max("y")).first()[0] or 0) + 1


_INTS = ", q AS (SELECT y, x, list_transform(s, lambda v: floor(v * 1000)::BIGINT) AS a FROM p)"


def _ints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube(spark, sf_dir).withColumn("spectrum", F.transform("spectrum", lambda v: F.floor(v * 1000).cast("double")))


@query(_INTS + " SELECT y, x, 'int32' AS dtype, list_sum(list_transform(a, lambda v: trunc(v * 1.5::DOUBLE)::BIGINT))::BIGINT AS total, a[3] * 2 > 100 AS large FROM q")
def bm_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An expression over integers gives integers, cut off toward zero."""
    own = Image("cube", _ints(spark, sf_dir), bands=64, dtype="int32")
    found = compute("a * 1.5", {"a": own})
    flags = compute("(a * 2) > 100", {"a": own}).typed().select("y", "x", (F.get("spectrum", F.lit(2)) == 1).alias("large"))
    total = F.aggregate("spectrum", F.lit(0).cast("long"), lambda s, v: s + v)
    return found.typed().select("y", "x", F.lit(found.dtype).alias("dtype"), total.alias("total")).join(flags, ["y", "x"])


@query(_INTS + " SELECT y, x, list_sum(list_transform(range(64), lambda b: (b + 1) * (a[b + 1] * 2 + 1)))::DOUBLE AS total, 'nm' AS unit, 45760.0::DOUBLE AS waves FROM q")
def bm_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An expression saved as one raster with the wavelengths of its source, and read back."""
    rows = _ints(spark, sf_dir)
    header = {"samples": 25, "lines": _height(rows), "bands": 64, "wavelength": WAVELENGTHS, "wavelength units": "nm"}
    at = f"{scratch(spark)}/result-{uuid4().hex}"
    compute("a * 2 + 1", {"a": Image("cube", rows, bands=64, dtype="int16", header=header)}).save(f"{at}/result.img")
    told = rasters.raster_bands(spark, at).groupBy().agg(F.first("unit").alias("unit"), F.sum("wavelength").alias("waves"))
    back = rasters.read_rasters(spark, at).where(F.get("spectrum", F.lit(0)).isNotNull())
    total = F.aggregate(F.transform("spectrum", lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v)
    return raster.attach(back.select("y", "x", total.alias("total")), told)


_LISTED = ", pts AS (SELECT user_id % 4 AS roi_id, (event_id * 7 % 30)::INT AS x, (event_id * 3 % 25)::INT AS y FROM events), h AS (SELECT y, x, vec_id, band, CASE WHEN v <= 0.36 THEN v END AS v FROM l)"


def _holed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cube without its large values."""
    return cube(spark, sf_dir).withColumn("spectrum", F.transform("spectrum", lambda v: F.when(v <= 0.36, v)))


@query(_LISTED + " SELECT roi_id::BIGINT AS roi_id, band, CASE WHEN count(*) = count(v) THEN round(avg(v), 6) END AS mean, CASE WHEN count(*) = count(v) THEN round(median(v), 6) END AS median FROM pts JOIN h USING (x, y) GROUP BY roi_id, band")
def point_list_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and median over listed points, where one missing value is enough for a missing band."""
    rows, points = _holed(spark, sf_dir), _points(spark, sf_dir)
    mean, median = (roi.points_spectrum(rows, points, how).select("roi_id", "band", F.round("value", 6).alias(how)) for how in ("mean", "median"))
    return mean.join(median, ["roi_id", "band"])


@query(
    """, hh AS (SELECT max(y) + 1 AS h FROM i), z AS (SELECT h, (h / 3)::INT AS z0, floor(h / 3.0::DOUBLE)::INT AS oh FROM hh), o AS (SELECT yy.i AS oy, xx.i AS ox, h, oh FROM z, range((SELECT oh FROM z)) yy(i), range(33) xx(i)),
    s AS (SELECT oy, ox, floor(0.5 + oy * (h / oh::DOUBLE)) + floor((floor(0.5 + (oy + 1) * (h / oh::DOUBLE)) - floor(0.5 + oy * (h / oh::DOUBLE))) / 2) - 2 AS y0,
      floor(0.5 + ox * (100 / 33.0::DOUBLE)) + floor((floor(0.5 + (ox + 1) * (100 / 33.0::DOUBLE)) - floor(0.5 + ox * (100 / 33.0::DOUBLE))) / 2) - 2 AS x0 FROM o),
    k AS (SELECT unnest(range(5)) AS d, unnest([1, 4, 6, 4, 1]) AS w)
    SELECT oy::INT AS y, ox::INT AS x, round(sum(value * a.w * b.w) / sum(a.w * b.w), 10) AS value FROM s, k a, k b JOIN i ON i.y = y0 + a.d AND i.x = x0 + b.d GROUP BY oy, ox"""
)
def downsample_gauss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A band at a third of its size with binomial weights over blocks that overlap."""
    band = image(spark, sf_dir)
    return raster.downsample_gauss(band, 3, 100, _height(band)).select("y", "x", F.round("value", 10).alias("value"))


@query(
    """, e AS (SELECT ref_id AS k, CASE WHEN ref_id % 3 = 0 THEN NULL ELSE 1 END AS waved, ref[1:(64 - ref_id)::INT] AS v FROM r), n AS (SELECT max(len(v)) AS n FROM e),
    c AS (SELECT k, b.i AS i, CASE WHEN b.i >= len(v) THEN '9999' || chr(9) || '9999' ELSE CASE WHEN waved IS NULL THEN b.i::VARCHAR ELSE (400 + 10 * b.i)::DOUBLE::VARCHAR END || chr(9) || CASE WHEN round(v[b.i + 1], 4) > 0.2 THEN 'NaN' ELSE round(v[b.i + 1], 4)::VARCHAR END END AS t FROM e, range((SELECT n FROM n)) b(i))
    SELECT 0 AS row, string_agg(CASE WHEN waved IS NULL THEN 'Band' ELSE 'Wavelength (nm)' END || chr(9) || 'same', chr(9) ORDER BY -k) AS text FROM e UNION ALL SELECT (i + 1)::INT, string_agg(t, chr(9) ORDER BY -k) FROM c GROUP BY i"""
)
def spectra_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectra of equal names and different lengths as the columns of a text, in a given order."""
    k = F.col("ref_id")
    waves = F.array(*map(F.lit, WAVELENGTHS))
    cut = F.slice("ref", 1, (64 - k).cast("int"))
    # as SQL has it: a small negative value becomes -0.0, which is another text; a zero of either sign is 0.0
    rounded = lambda v: F.signum(v + 0.0) * F.round(F.abs(v), 4)
    values = F.transform(cut, lambda v: F.when(rounded(v) <= 0.2, rounded(v)))
    rows = references(spark, sf_dir).select((-k).alias("position"), F.lit("same").alias("name"), F.lit("nm").alias("unit"), F.when(k % 3 != 0, waves).alias("wavelengths"), values.alias("values"))
    return spectra_text.export_spectra(rows)


@query(" SELECT y, x, round(2 * list_sum(s) + 64, 4) AS total, 2::BIGINT AS damaged FROM p")
def damaged_rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of a good raster, one that is cut short and one without a header, evaluated as a batch."""
    rows = cube(spark, sf_dir)
    at = f"{scratch(spark)}/folder-{uuid4().hex}"
    datasource.write_file(rows, f"{at}/in/good.img", "envi", width=25, height=_height(rows), bands=64, kind="f8")
    put(f"{at}/in/short.hdr", b"ENVI\nsamples = 9\nlines = 9\nbands = 2\ndata type = 4\ninterleave = bsq\n")
    put(f"{at}/in/short.img", np.zeros(100, "<f4").tobytes())
    put(f"{at}/in/bare.img", b"no header")
    raster_stream.evaluate_folder(spark, "c * 2 + 1", f"{at}/in", f"{at}/out", size=1 << 20)
    pixels, errors = raster_stream.results(spark, f"{at}/out")
    total = F.round(F.aggregate("spectrum", F.lit(0.0), lambda s, v: s + v), 4).alias("total")
    return raster.attach(pixels.where(F.get("spectrum", F.lit(0)).isNotNull()).select("y", "x", total), errors.groupBy().agg(F.count(F.lit(1)).alias("damaged")))
