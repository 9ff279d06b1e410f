"""Queries of matching, continuum removal and components over the driver's tables, each with its SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions.registry import dot
from lumenfold.operators import continuum, matching, pca, raster
from lumenfold.plans.inputs import BANDS, GOOD, SQL, WAVELENGTHS, cube, references

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = f"WITH {SQL} {sql}"
        return f

    return add


r6 = lambda c: F.round(F.col(c), 6).alias(c)


@query("SELECT y, x, round(sqrt(list_sum(list_transform(s, lambda v: v * v))), 6) AS norm FROM p")
def l2_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube(spark, sf_dir).select("y", "x", F.round(F.sqrt(dot(F.col("spectrum"), F.col("spectrum"))), 6).alias("norm"))


_GRID = "grid AS (SELECT b::INT AS band, 405.0::DOUBLE + 10 * b AS wavelength FROM range(64) g(b))"
_SEGMENTS = ", c AS (SELECT ref_id, 400.0::DOUBLE + 20 * k AS w0, ref[2 * k + 1] AS v0, 420.0::DOUBLE + 20 * k AS w1, CASE WHEN k < 31 THEN ref[2 * k + 3] END AS v1 FROM r, range(32) q(k)), "


@query(_SEGMENTS + _GRID + " SELECT ref_id, band, round(v0 + (v1 - v0) * (wavelength - w0) / (w1 - w0), 6) AS value FROM c JOIN grid ON wavelength >= w0 AND wavelength < w1 AND v1 IS NOT NULL")
def resample_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References known at every second band, on a grid between the bands."""
    coarse = references(spark, sf_dir).select("ref_id", F.posexplode("ref").alias("b", "value")).where("b % 2 = 0").select("ref_id", (400.0 + 10 * F.col("b")).alias("wavelength"), "value")
    grid = spark.range(BANDS).select(F.col("id").cast("int").alias("band"), (405.0 + 10 * F.col("id")).alias("wavelength"))
    return matching.resample(coarse, grid).select("ref_id", "band", r6("value"))


_DOTS = """, m AS (SELECT y, x, vec_id, ref_id, list_sum(list_transform(list_zip(s, ref), lambda t: t[1] * t[2])) AS tr, list_sum(list_transform(s, lambda v: v * v)) AS tt,
   list_sum(list_transform(ref, lambda v: v * v)) AS rr FROM p, r), a AS (SELECT *, degrees(acos(greatest(-1, least(1, tr / (sqrt(tt) * sqrt(rr)))))) AS score FROM m) """


@query(_DOTS + "SELECT y, x, ref_id, round(score, 3) AS score, score < 75 AS is_match FROM a")
def sam_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matching.sam(cube(spark, sf_dir), references(spark, sf_dir), threshold=75.0)
    return found.select("y", "x", "ref_id", F.round("score", 3).alias("score"), "is_match")


@query(_DOTS + "SELECT vec_id, ref_id, round(score, 3) AS score FROM a WHERE score <= 90")
def sam_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every target spectrum against the library, matches up to a threshold."""
    targets = cube(spark, sf_dir, "vec_id").select("vec_id", "spectrum")
    found = matching.sam(targets, references(spark, sf_dir), mode="spectrum", threshold=90.0).where("is_match")
    return found.select("vec_id", "ref_id", F.round("score", 3).alias("score"))


@query(_DOTS + "SELECT y, x, arg_min(ref_id, score) AS ref_id, round(min(score), 3) AS score FROM a GROUP BY y, x")
def sam_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matching.best_angle(cube(spark, sf_dir), references(spark, sf_dir))
    return found.select("y", "x", "ref_id", F.round("score", 3).alias("score"))


_GOOD_DOTS = """, g AS (SELECT ref_id, list_transform(range(64), lambda b: CASE WHEN b % 16 = 15 OR (b < 6 AND ref_id % 2 = 1) THEN 0.0 ELSE 1.0 END) AS g, ref FROM r),
   m AS (SELECT vec_id, ref_id, list_sum(list_transform(list_zip(s, ref, g), lambda t: t[1] * t[2] * t[3])) AS tr, list_sum(list_transform(list_zip(s, g), lambda t: t[1] * t[1] * t[2])) AS tt,
   list_sum(list_transform(list_zip(ref, g), lambda t: t[1] * t[1] * t[2])) AS rr FROM p, g), a AS (SELECT *, degrees(acos(greatest(-1, least(1, tr / (sqrt(tt) * sqrt(rr)))))) AS score FROM m) """


@query(_GOOD_DOTS + "SELECT vec_id, ref_id, round(score, 3) AS score, score < 75 AS is_match FROM a")
def sam_image_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bad bands of the target, and references that lack their first bands: norms cover the bands that are there."""
    lacking = F.transform("ref", lambda v, i: F.when((i < 6) & (F.col("ref_id") % 2 == 1), F.lit(None)).otherwise(v))
    refs = references(spark, sf_dir).withColumn("ref", raster.mask_values(lacking, None, GOOD))
    return matching.sam(cube(spark, sf_dir, "vec_id").select("vec_id", "spectrum"), refs, threshold=75.0).select("vec_id", "ref_id", F.round("score", 3).alias("score"), "is_match")


@query(
    _SEGMENTS
    + _GRID
    + """, v AS (SELECT ref_id, band, v0 + (v1 - v0) * (wavelength - w0) / (w1 - w0) AS rv FROM c JOIN grid ON wavelength >= w0 AND wavelength < w1 AND v1 IS NOT NULL WHERE wavelength BETWEEN 450 AND 1000 AND band % 7 <> 3),
    m AS (SELECT vec_id, ref_id, sum(rv * s[band + 1]) AS tr, sum(s[band + 1] * s[band + 1]) AS tt, sum(rv * rv) AS rr FROM v, p GROUP BY vec_id, ref_id)
    SELECT vec_id, ref_id, round(degrees(acos(greatest(-1, least(1, tr / (sqrt(tt) * sqrt(rr)))))), 3) AS score FROM m"""
)
def sam_other_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References in micrometres on a grid of their own, against the targets' bands, read as 405, 415, … nm, from 450 to
    1000 nm and without some bad bands."""
    coarse = F.filter("ref", lambda v, i: i % 2 == 0)
    at = F.transform(coarse, lambda v, i: (400.0 + 20 * i) / 1000.0)
    refs = references(spark, sf_dir).select("ref_id", F.lit("um").alias("unit"), at.alias("wavelengths"), coarse.alias("values"), F.transform(coarse, lambda v: F.lit(True)).alias("good"))
    found, kept = matching.on_target_bands(refs, [405.0 + 10 * b for b in range(BANDS)], "nm", [b % 7 != 3 for b in range(BANDS)], 450.0, 1000.0)
    targets = raster.some_bands(cube(spark, sf_dir, "vec_id").select("vec_id", "spectrum"), kept)
    return matching.sam(targets, found, mode="image").select("vec_id", "ref_id", F.round("score", 3).alias("score"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(list_zip(s, range(64)), lambda t: CASE WHEN t[2] % 16 = 15 THEN 0 ELSE t[1] * t[1] END))), 6) AS norm FROM p")
def l2_norm_good(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The norm over good bands."""
    masked = cube(spark, sf_dir, "vec_id").withColumn("spectrum", raster.mask_values(F.col("spectrum"), None, GOOD))
    return masked.select("vec_id", F.round(F.sqrt(dot(F.col("spectrum"), F.col("spectrum"))), 6).alias("norm"))


_EXTRA = ", c AS (SELECT ref_id, k, 400.0::DOUBLE + 20 * k AS w0, ref[2 * k + 1] AS v0, 420.0::DOUBLE + 20 * k AS w1, ref[2 * k + 3] AS v1 FROM r, range(31) q(k)), wide AS (SELECT b::INT AS band, 355.0::DOUBLE + 10 * b AS wavelength FROM range(75) g(b))"


@query(_EXTRA + " SELECT ref_id, band, round(v0 + (v1 - v0) * (wavelength - w0) / (w1 - w0), 6) AS value FROM c JOIN wide ON (wavelength >= w0 OR k = 0) AND (wavelength < w1 OR k = 30)")
def resample_extrapolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References beyond both ends of their range: the first and last segments go on."""
    coarse = references(spark, sf_dir).select("ref_id", F.posexplode("ref").alias("b", "value")).where("b % 2 = 0").select("ref_id", (400.0 + 10 * F.col("b")).alias("wavelength"), "value")
    grid = spark.range(75).select(F.col("id").cast("int").alias("band"), (355.0 + 10 * F.col("id")).alias("wavelength"))
    return matching.resample(coarse, grid, extrapolate=True).select("ref_id", "band", r6("value"))


N = BANDS


def _hull(source: str, key: str) -> str:
    """CTEs h{n}: (key, band, removed) of a source with (key, band, v), v > 0: the hull is the highest chord at a band."""
    return f"""SELECT {key}, j.band, j.v / max(CASE WHEN i.band = k.band THEN j.v ELSE i.v + (k.v - i.v) * (j.band - i.band) / (k.band - i.band)::DOUBLE END) AS removed
      FROM {source} j JOIN {source} i USING ({key}) JOIN {source} k USING ({key}) WHERE i.band <= j.band AND k.band >= j.band AND (i.band < k.band OR i.band = j.band) GROUP BY {key}, j.band, j.v"""


_SHORT = f", t AS (SELECT vec_id, y, x, band, v + 1.5 AS v FROM l WHERE band < {N}), ht AS ({_hull('t', 'vec_id')})"
_REFS = f", rs AS (SELECT ref_id, n.band::INT AS band, ref[n.band + 1] + 1.5 AS v FROM r, range({N}) n(band)), hr AS ({_hull('rs', 'ref_id')})"
_FIT = (
    _SHORT
    + _REFS
    + f""", f AS (SELECT vec_id, ref_id, list(1 - ht.removed ORDER BY band) AS t, list(1 - hr.removed ORDER BY band) AS r FROM ht JOIN hr USING (band) GROUP BY vec_id, ref_id),
    g AS (SELECT *, list_sum(list_transform(list_zip(t, r), lambda z: z[1] * z[2])) / nullif(list_sum(list_transform(r, lambda z: z * z)), 0) AS scale FROM f),
    o AS (SELECT *, sqrt(list_sum(list_transform(list_zip(t, list_transform(r, lambda z: z * scale)), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) / {N}) AS score FROM g) """
)


def _positive(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.transform(column, lambda v: v + 1.5))


@query(_SHORT + " SELECT y, x, ht.band, round(removed, 6) AS value FROM ht JOIN (SELECT DISTINCT vec_id, y, x FROM t) USING (vec_id)")
def continuum_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = continuum.remove_continuum(_positive(cube(spark, sf_dir), "spectrum"), WAVELENGTHS)
    return raster.long(found).select("y", "x", "band", r6("value"))


@query(_FIT + "SELECT vec_id, ref_id, round(scale, 4) AS scale, round(score, 5) AS score FROM o")
def sff_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels, refs = _positive(cube(spark, sf_dir, "vec_id").select("vec_id", "spectrum"), "spectrum"), _positive(references(spark, sf_dir), "ref")
    return matching.sff(pixels, refs, WAVELENGTHS).select("vec_id", "ref_id", F.round("scale", 4).alias("scale"), F.round("score", 5).alias("score"))


@query(_FIT + "SELECT vec_id, ref_id, round(score, 5) AS score FROM o WHERE score <= 0.06")
def sff_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels, refs = _positive(cube(spark, sf_dir, "vec_id").select("vec_id", "spectrum"), "spectrum"), _positive(references(spark, sf_dir), "ref")
    found = matching.sff(pixels, refs, WAVELENGTHS, mode="spectrum", max_rms=0.06).where("is_match")
    return found.select("vec_id", "ref_id", F.round("score", 5).alias("score"))


def _masked_fit(refs: str, good: str) -> str:
    """CTEs of a fit with bad bands: targets ``good``, references from a CTE rs (ref_id, band, v) of their own good bands."""
    return (
        f", t AS (SELECT vec_id, y, x, band, v + 1.5 AS v FROM l WHERE {good}), ht AS ({_hull('t', 'vec_id')}), rs AS ({refs}), hr AS ({_hull('rs', 'ref_id')}),"
        " f AS (SELECT vec_id, k.ref_id, 1 - ht.removed AS t, 1 - hr.removed AS r FROM ht JOIN (SELECT DISTINCT ref_id FROM rs) k ON true LEFT JOIN hr ON hr.ref_id = k.ref_id AND hr.band = ht.band),"
        " g AS (SELECT vec_id, ref_id, sum(t * r) / nullif(sum(r * r), 0) AS scale, count(r) AS n FROM f GROUP BY vec_id, ref_id),"
        " o AS (SELECT vec_id, ref_id, any_value(scale) AS scale, sqrt(sum(CASE WHEN r IS NOT NULL THEN (t - scale * r) ** 2 END) / any_value(n)) AS of_image, sqrt(sum((t - scale * coalesce(r, 0)) ** 2) / any_value(n)) AS of_spectrum FROM f JOIN g USING (vec_id, ref_id) GROUP BY vec_id, ref_id) "
    )


def _shifted(spark: SparkSession, sf_dir: str, step: int, unit: str, factor: float) -> DataFrame:
    """References of every ``step``-th band with their first three values bad where the id is odd."""
    every = F.filter("ref", lambda v, i: i % step == 0)
    at = F.transform(every, lambda v, i: (400.0 + 10 * step * i) * factor)
    good = F.transform(every, lambda v, i: (F.col("ref_id") % 2 == 0) | (i >= 3))
    return _positive(references(spark, sf_dir), "ref").select("ref_id", F.lit(unit).alias("unit"), at.alias("wavelengths"), every.alias("values"), good.alias("good"))


@query(_masked_fit("SELECT ref_id, b.i::INT AS band, ref[b.i + 1] + 1.5 AS v FROM r, range(64) b(i) WHERE ref_id % 2 = 0 OR b.i >= 3", "band % 16 <> 15") + "SELECT vec_id, ref_id, round(scale, 4) AS scale, round(of_image, 5) AS image, round(of_spectrum, 5) AS spectrum FROM o")
def sff_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bad bands of targets and references in both modes, whose errors differ by the bands that a reference lacks."""
    pixels, refs = _positive(cube(spark, sf_dir, "vec_id").select("vec_id", "spectrum"), "spectrum"), _shifted(spark, sf_dir, 1, "nm", 1.0)
    image, one = (matching.sff_on_grid(pixels, refs, WAVELENGTHS, "nm", GOOD, mode=mode) for mode in ("image", "spectrum"))
    found = image.select("vec_id", "ref_id", F.round("scale", 4).alias("scale"), F.round("score", 5).alias("image"))
    return found.join(one.select("vec_id", "ref_id", F.round("score", 5).alias("spectrum")), ["vec_id", "ref_id"])


_BETWEEN = """SELECT ref_id, band, v FROM (SELECT ref_id, b.i::INT AS band, CASE WHEN b.i % 2 = 0 THEN ref[b.i + 1] ELSE (ref[b.i] + ref[b.i + 2]) / 2 END + 1.5 AS v FROM r, range(5, 56) b(i)) WHERE ref_id % 2 = 0 OR band >= 6"""


@query(_masked_fit(_BETWEEN, "band BETWEEN 5 AND 55 AND band % 16 <> 15") + "SELECT vec_id, ref_id, round(scale, 4) AS scale, round(of_image, 5) AS score, of_image < 0.05 AS is_match FROM o")
def sff_other_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References in micrometres at every second band, between two wavelengths, with bad bands on both sides."""
    pixels = _positive(cube(spark, sf_dir, "vec_id").select("vec_id", "spectrum"), "spectrum")
    found = matching.sff_on_grid(pixels, _shifted(spark, sf_dir, 2, "um", 0.001), WAVELENGTHS, "nm", GOOD, 450.0, 950.0, max_rms=0.05)
    return found.select("vec_id", "ref_id", F.round("scale", 4).alias("scale"), F.round("score", 5).alias("score"), "is_match")


@query(_FIT + ", w AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY ref_id) AS k FROM o) SELECT y, x, count(*) AS n, round(sum(k * scale), 3) AS scales, round(sum(k * score), 4) AS scores, sum(k * (score < 0.06)::INT)::BIGINT AS matches FROM w JOIN (SELECT DISTINCT vec_id, y, x FROM p) USING (vec_id) GROUP BY y, x")
def sff_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scales, errors and matches as cubes with a band for each reference, all of them."""
    found = matching.sff(_positive(cube(spark, sf_dir), "spectrum"), _positive(references(spark, sf_dir), "ref"), WAVELENGTHS, max_rms=0.06)
    out, weighed = None, lambda d: F.round(F.aggregate(F.transform("spectrum", lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v), d)
    for value, name, digits in (("scale", "scales", 3), ("score", "scores", 4), ("is_match", "matches", 0)):
        own = matching.as_cube(found, value).select("y", "x", *([F.size("spectrum").cast("long").alias("n")] if out is None else []), weighed(digits).alias(name))
        out = own if out is None else out.join(own, ["y", "x"])
    return out.withColumn("matches", F.col("matches").cast("long"))


@query()
def pca_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four components of each pixel; eigenvectors are beyond SQL, the tests hold them against numpy."""
    rows = cube(spark, sf_dir)
    found = pca.transform(rows, pca.fit(rows, 4))
    return found.select("y", "x", *(F.round(F.get("spectrum", F.lit(i)), 4).alias(f"c{i}") for i in range(4)))


@query("SELECT round(sum(var), 5) AS total_variance FROM (SELECT var_samp(v) AS var FROM l GROUP BY band)")
def pca_explained_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variances of all components add up to that of the bands."""
    model = pca.fit(cube(spark, sf_dir), BANDS)
    return model.frame(spark).agg(F.round(F.sum("variance"), 5).alias("total_variance"))


@query(
    """, m AS (SELECT band, avg(v) AS m FROM l GROUP BY band), d AS (SELECT vec_id, band, v - m AS v FROM l JOIN m USING (band)),
    c AS (SELECT a.band AS i, b.band AS j, sum(a.v * b.v) / (count(*) - 1) AS c FROM d a JOIN d b USING (vec_id) GROUP BY a.band, b.band)
    SELECT 0 AS mixed, round(sum(CASE WHEN i = j THEN c END), 6) AS variances, round(sum(c * c), 6) AS squares, 1.0::DOUBLE AS ratios, 64.0::DOUBLE AS lengths, true AS falling FROM c"""
)
def pca_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The components of all pixels have no covariance with each other, and their variances and squares of these add up to
    those of the bands' covariances; loadings have length one, and variances fall."""
    rows = cube(spark, sf_dir)
    model = pca.fit(rows, BANDS)
    n, s, p, _ = pca.moments(pca.transform(rows, model))
    found = (p - np.outer(s, s) / n) / (n - 1)
    own, told = np.diag(found), model.frame(spark)
    mixed = int((np.abs(found - np.diag(own)) > 1e-9).sum() + (np.abs(own - model.variance) > 1e-9).sum())
    length = F.aggregate("loadings", F.lit(0.0), lambda t, v: t + v * v)
    falling = bool((np.diff(own) <= 1e-9).all())
    return told.agg(F.lit(mixed).alias("mixed"), F.round(F.sum("variance"), 6).alias("variances"), F.round(F.sum(F.col("variance") * F.col("variance")), 6).alias("squares"), F.round(F.sum("ratio"), 9).alias("ratios"), F.round(F.sum(length), 6).alias("lengths"), F.lit(falling).alias("falling"))
