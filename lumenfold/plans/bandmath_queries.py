"""Queries of band math over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions.registry import Registry
from lumenfold.operators.bandmath import Image, evaluate
from lumenfold.operators.raster import one_band
from lumenfold.plans.inputs import RAMP, SQL, cube, image, table

QUERIES, ORACLE = {}, {}


def _summary(df: DataFrame, *keys: str) -> DataFrame:
    """Sum and one value of each spectrum."""
    total = F.aggregate("spectrum", F.lit(0.0), lambda s, v: s + F.coalesce(v.cast("double"), F.lit(0.0)))
    return df.select(*(keys or ("y", "x")), F.round(total, 6).alias("total"), F.round(F.get("spectrum", F.lit(7)).cast("double"), 6).alias("v7"))


def _add(name: str, query, sql: str) -> None:
    QUERIES[name], ORACLE[name] = query, f"WITH {SQL} {sql}"


def _cube_query(name: str, expression: str, sql: str) -> None:
    """An expression over the cube c, its band b and the ramp s; ``sql`` gives a list from s, b3 and q."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = cube(spark, sf_dir)
        return _summary(evaluate(expression, {"c": Image("cube", c), "b": Image("band", one_band(c, 3)), "s": RAMP})[1])

    _add(name, run, f"SELECT y, x, round(list_sum(z), 6) AS total, round(z[8], 6)::DOUBLE AS v7 FROM (SELECT y, x, {sql} AS z FROM (SELECT *, s[4] AS b3 FROM p), ramp)")


_cube_query("bm_add", "c + c * 2", "list_transform(s, lambda v: v + v * 2)")
_cube_query("bm_sub_scalar_cube", "5 - c", "list_transform(s, lambda v: 5 - v)")
_cube_query("bm_mul", "c * 3 * c", "list_transform(s, lambda v: v * 3 * v)")
_cube_query("bm_div_masked", "1 / ((c > 0) * c)", "list_transform(s, lambda v: CASE WHEN v > 0 THEN 1 / v END)")
_cube_query("bm_pow", "(c * c) ** 0.5", "list_transform(s, lambda v: pow(v * v, 0.5))")
_cube_query("bm_root_of_negative", "c ** 0.5", "list_transform(s, lambda v: CASE WHEN v >= 0 THEN pow(v, 0.5) END)")
_cube_query("bm_neg", "-c ** 2", "list_transform(s, lambda v: v * v)")
_cube_query("bm_compare_mask", "c * (c >= 0.1)", "list_transform(s, lambda v: CASE WHEN v >= 0.1 THEN v ELSE 0.0 END)")
_cube_query("bm_precedence", "s * (s > 0.2) + c < 0.2", "list_transform(list_zip(s, q), lambda t: ((CASE WHEN t[2] > 0.2 THEN t[2] ELSE 0 END) + t[1] < 0.2)::INT::DOUBLE)")
_cube_query("bm_trig", "sin(c) + cos(c) * tan(c)", "list_transform(s, lambda v: sin(v) + cos(v) * tan(v))")
_cube_query("bm_arc", "arcsin(c * 4) + arccos(c * 2) + arctan(c)", "list_transform(s, lambda v: CASE WHEN abs(v * 4) <= 1 THEN asin(v * 4) + acos(v * 2) + atan(v) END)")
_cube_query("bm_arctan2", "arctan2(b, c)", "list_transform(s, lambda v: atan2(b3, v))")
_cube_query("bm_cube_band", "c * b - b", "list_transform(s, lambda v: v * b3 - b3)")
_cube_query("bm_cube_spectrum", "c / (s + 1)", "list_transform(list_zip(s, q), lambda t: t[1] / (t[2] + 1))")
_cube_query("bm_chained_compare", "0 < c < 1", "list_transform(s, lambda v: ((0 < v)::INT < 1)::INT::DOUBLE)")


def bm_ndvi(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cube(spark, sf_dir)
    found = evaluate("(nir - red) / (nir + red)", {"nir": Image("band", one_band(c, 40)), "red": Image("band", one_band(c, 20))})[1]
    return found.where("value > 0").select("y", "x", F.round("value", 6).alias("ndvi"))


_add("bm_ndvi", bm_ndvi, "SELECT y, x, round((s[41] - s[21]) / (s[41] + s[21]), 6) AS ndvi FROM p WHERE s[41] + s[21] <> 0 AND (s[41] - s[21]) / (s[41] + s[21]) > 0")


def bm_cube_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cube(spark, sf_dir)
    mirrored = c.withColumn("spectrum", F.reverse("spectrum"))
    return _summary(evaluate("a - z", {"a": Image("cube", c), "z": Image("cube", mirrored)})[1])


_add("bm_cube_cube", bm_cube_cube, "SELECT y, x, round(list_sum(z), 6) AS total, round(z[8], 6) AS v7 FROM (SELECT y, x, list_transform(list_zip(s, list_reverse(s)), lambda t: t[1] - t[2]) AS z FROM p)")


def bm_dotprod_cube_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluate("dotprod(s, c)", {"c": Image("cube", cube(spark, sf_dir)), "s": RAMP})[1]
    return found.select("y", "x", F.round("value", 6).alias("dot"))


_add("bm_dotprod_cube_spectrum", bm_dotprod_cube_spectrum, "SELECT y, x, round(list_sum(list_transform(list_zip(s, q), lambda t: t[1] * t[2])), 6) AS dot FROM p, ramp")


def bm_dotprod_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pixel's spectrum with itself."""
    c = cube(spark, sf_dir)
    found = evaluate("dotprod(c, c)", {"c": Image("cube", c)})[1]
    return found.select("y", "x", F.round("value", 5).alias("dot"))


_add("bm_dotprod_spectra", bm_dotprod_spectra, "SELECT y, x, round(list_sum(list_transform(s, lambda v: v * v)), 5) AS dot FROM p")


def bm_user_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    functions = Registry()
    functions.register("twice_plus", lambda a, b: 2 * a + b, arity=2)
    found = evaluate("twice_plus(c, s)", {"c": Image("cube", cube(spark, sf_dir)), "s": RAMP}, functions)[1]
    return _summary(found)


_add("bm_user_function", bm_user_function, "SELECT y, x, round(list_sum(z), 6) AS total, round(z[8], 6) AS v7 FROM (SELECT y, x, list_transform(list_zip(s, q), lambda t: 2 * t[1] + t[2]) AS z FROM p, ramp)")


def bm_spectral_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluate("spectral_angle(c, s)", {"c": Image("cube", cube(spark, sf_dir)), "s": RAMP})[1]
    return found.select("y", "x", F.round("value", 6).alias("angle"))


_add(
    "bm_spectral_angle",
    bm_spectral_angle,
    """SELECT y, x, round(acos(greatest(-1, least(1, list_sum(list_transform(list_zip(s, q), lambda t: t[1] * t[2])) / (sqrt(list_sum(list_transform(s, lambda v: v * v)))
       * sqrt(list_sum(list_transform(q, lambda v: v * v))))))), 6) AS angle FROM p, ramp""",
)


def bm_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch: each event type is a dataset of its own, with a cube of each label as another batch would be."""
    rows = cube(spark, sf_dir, "label")
    found = evaluate("c * 2 + 1", {"c": Image("cube", rows, ("label", "y", "x"))})[1]
    return _summary(found, "label", "y", "x")


_add("bm_batch", bm_batch, "SELECT label, y, x, round(list_sum(z), 6) AS total, round(z[8], 6) AS v7 FROM (SELECT label, y, x, list_transform(s, lambda v: v * 2 + 1) AS z FROM p)")


def bm_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluate("(e > 10) * e / (e + 1)", {"e": Image("band", image(spark, sf_dir))})[1]
    return found.select("y", "x", F.round("value", 6).alias("value"))


_add("bm_image", bm_image, "SELECT y, x, round(CASE WHEN value + 1 <> 0 THEN (value > 10)::INT * value / (value + 1) END, 6) AS value FROM i")


def bm_row_wise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of lineitem as pixels with four bands; totals for each batch."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("ds"), F.monotonically_increasing_id().alias("x"), F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax").cast("array<double>").alias("spectrum"))
    found = evaluate("c * s", {"c": Image("cube", rows, ("ds", "x")), "s": [1.0, 0.5, 2.0, 4.0]})[1]
    return found.groupBy("ds").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.get("spectrum", F.lit(1))), 1).alias("price"), F.round(F.sum(F.get("spectrum", F.lit(3))), 3).alias("tax"))


_add("bm_row_wise", bm_row_wise, "SELECT l_returnflag AS ds, count(*) AS n, round(sum(l_extendedprice * 0.5::DOUBLE), 1) AS price, round(sum(l_tax * 4.0::DOUBLE), 3) AS tax FROM lineitem GROUP BY 1")
