"""Queries of slices, aggregates, regions, stretches and geometry over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions import text, units
from lumenfold.operators import geo, raster, roi, stats, stretch
from lumenfold.plans.inputs import BANDS, GOOD, SQL, WAVELENGTHS, bands, cube, image, table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None, with_inputs: bool = True):
    """Registers a function under its name; ``sql`` follows the shared inputs."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = f"WITH {SQL} {sql}" if with_inputs else sql
        return f

    return add


r6 = lambda c: F.round(F.col(c), 6).alias(c)


@query("SELECT band, round(min(v), 6) AS min_value, round(max(v), 6) AS max_value FROM l GROUP BY band")
def band_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.band_stats(cube(spark, sf_dir), bands=BANDS).select("band", r6("min_value"), r6("max_value"))


@query("SELECT y, x, round((value - (SELECT min(value) FROM i)) / ((SELECT max(value) FROM i) - (SELECT min(value) FROM i)), 6) AS value FROM i")
def band_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.normalized(image(spark, sf_dir)).select("y", "x", r6("value"))


@query("SELECT y, x, round(list_sum(s[11:21]), 6) AS total, len(s[11:21])::INT AS n FROM p")
def wavelength_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = raster.wavelength_slice(cube(spark, sf_dir), WAVELENGTHS, 500.0, 600.0)
    return found.select("y", "x", F.round(F.aggregate("spectrum", F.lit(0.0), lambda a, v: a + v), 6).alias("total"), F.size("spectrum").alias("n"))


@query(
    """SELECT target, arg_min(band, d)::INT AS band, min(wavelength) FILTER (WHERE d = m) AS wavelength FROM (SELECT *, min(d) OVER (PARTITION BY target) AS m FROM
       (SELECT t.target, n.band, 400.0::DOUBLE + 10 * n.band AS wavelength, abs(400.0::DOUBLE + 10 * n.band - t.target) + n.band / 1e9 AS d FROM range(64) n(band),
        (SELECT DISTINCT 380.0::DOUBLE + user_id % 700 AS target FROM events) t) WHERE d <= 20.5 AND abs(wavelength - target) <= 20) GROUP BY target"""
)
def nearest_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "events").select((F.lit(380.0) + F.col("user_id") % 700).alias("target")).distinct()
    return raster.nearest_band(bands(spark), wanted)


@query(
    """SELECT event_id, round(CASE event_id % 6 WHEN 0 THEN v WHEN 1 THEN v * 1000 WHEN 2 THEN 1e7 / v WHEN 3 THEN 299792458 / v WHEN 4 THEN v * 0.1 ELSE v * 1e9 END, 6) AS nm
       FROM (SELECT event_id, abs(value) + 1 AS v FROM events)""",
    with_inputs=False,
)
def unit_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ("nm", "um", "1/cm", "GHz", "angstroms", "m")))
    rows = table(spark, sf_dir, "events").select("event_id", (F.abs("value") + 1).alias("v"), F.get(names, (F.col("event_id") % 6).cast("int")).alias("unit"))
    return rows.select("event_id", F.round(units.to_nm(F.col("v"), F.col("unit")), 6).alias("nm"))


@query("SELECT band, round(v, 6) AS value FROM l WHERE x = 3 AND y = 4")
def spectrum_at_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.spectrum_at(cube(spark, sf_dir), 3, 4).select("band", r6("value"))


@query("SELECT band, round(avg(v), 6) AS value FROM l WHERE x BETWEEN 4 AND 8 AND y BETWEEN 5 AND 7 GROUP BY band")
def window_mean_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.spectrum_at(cube(spark, sf_dir), 6, 6, 5, 3).select("band", r6("value"))


@query("SELECT band, round(median(v), 6) AS value FROM l WHERE x BETWEEN 4 AND 8 AND y BETWEEN 5 AND 7 GROUP BY band")
def window_median_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.spectrum_at(cube(spark, sf_dir), 6, 6, 5, 3, "median").select("band", r6("value"))


@query("SELECT y, x, band, round(v, 6) AS value FROM l WHERE x BETWEEN 2 AND 6 AND y BETWEEN 1 AND 3 AND band BETWEEN 10 AND 14")
def cube_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = raster.long(raster.band_slice(raster.window(cube(spark, sf_dir), 2, 1, 5, 3), 10, 5))
    return found.select("y", "x", (F.col("band") + 10).alias("band"), r6("value"))


@query("SELECT y, x, band, round(CASE WHEN band % 16 <> 15 AND abs(v - 0.1) > 1e-8 + 1e-5 * 0.1 THEN v END, 6) AS value FROM l")
def mask_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pixel of the table, whatever its label."""
    masked = cube(spark, sf_dir).withColumn("spectrum", raster.mask_values(F.col("spectrum"), 0.1, GOOD))
    return raster.long(masked).select("y", "x", "band", r6("value"))


@query("SELECT (y // 4)::INT AS y, (x // 4)::INT AS x, round(avg(value), 6) AS value FROM i GROUP BY 1, 2")
def downsample_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.downsample(image(spark, sf_dir), 4).select("y", "x", r6("value"))


@query("SELECT count(*) AS n FROM i WHERE x >= 0 AND x < 50 AND y >= 0 AND y < 40")
def in_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return image(spark, sf_dir).where(raster.in_bounds(F.col("x"), F.col("y"), 50, 40)).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT (band - 4)::INT AS band, 400.0::DOUBLE + 10 * band AS wavelength, round(avg(v), 6) AS mean FROM l WHERE band BETWEEN 4 AND 9 GROUP BY band")
def metadata_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = raster.subset_bands(bands(spark), 440.0, 490.0).select("band", "wavelength")
    rows = raster.long(raster.wavelength_slice(cube(spark, sf_dir), WAVELENGTHS, 440.0, 490.0)).groupBy("band").agg(F.round(F.avg("value"), 6).alias("mean"))
    return rows.join(kept, "band").select("band", "wavelength", "mean")


def _rois(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two regions of the cube's pixels, each of overlapping rectangles and a point."""
    grid = cube(spark, sf_dir).select("x", "y")
    part = lambda i, *r: grid.where(roi.rectangle(F.col("x"), F.col("y"), *r)).select(F.lit(i).cast("long").alias("roi_id"), "x", "y")
    return roi.pixels_of(part(1, 2, 2, 6, 5), part(1, 4, 3, 9, 7), part(2, 20, 10, 15, 15), part(2, 0, 0, 1, 1))


_ROI = """, roi AS (SELECT DISTINCT * FROM (SELECT 1::BIGINT AS roi_id, x, y FROM p WHERE (x >= 2 AND x < 6 AND y >= 2 AND y < 5) OR (x >= 4 AND x < 9 AND y >= 3 AND y < 7)
  UNION ALL SELECT 2::BIGINT, x, y FROM p WHERE (x >= 15 AND x < 20 AND y >= 10 AND y < 15) OR (x = 0 AND y = 0))) """


@query(_ROI + "SELECT roi_id, x, y FROM roi")
def roi_union_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rois(spark, sf_dir)


@query(_ROI + "SELECT roi_id, band, round(avg(v), 6) AS value FROM l JOIN roi USING (x, y) GROUP BY roi_id, band")
def roi_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roi.roi_spectrum(cube(spark, sf_dir), _rois(spark, sf_dir)).select("roi_id", "band", r6("value"))


@query(_ROI + "SELECT roi_id, band, round(median(v), 6) AS value FROM l JOIN roi USING (x, y) GROUP BY roi_id, band")
def roi_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roi.roi_spectrum(cube(spark, sf_dir), _rois(spark, sf_dir), "median").select("roi_id", "band", r6("value"))


@query(_ROI + "SELECT roi_id, min(x) AS x_min, min(y) AS y_min, max(x) - min(x) + 1 AS width, max(y) - min(y) + 1 AS height FROM roi GROUP BY roi_id")
def roi_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roi.bounding_boxes(_rois(spark, sf_dir))


@query(
    _ROI
    + """, runs AS (SELECT roi_id, y, min(x) AS x_min, max(x) AS x_max FROM (SELECT *, x - row_number() OVER (PARTITION BY roi_id, y ORDER BY x) AS g FROM roi) GROUP BY roi_id, y, g)
    SELECT roi_id, x_min, x_max, min(y) AS y_min, max(y) AS y_max FROM (SELECT *, y - row_number() OVER (PARTITION BY roi_id, x_min, x_max ORDER BY y) AS g FROM runs) GROUP BY roi_id, x_min, x_max, g"""
)
def roi_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roi.rectangles(_rois(spark, sf_dir))


@query("SELECT x, y FROM i WHERE x >= 10 AND x < 40 AND y >= 2 AND y < 9 INTERSECT SELECT x, y FROM i WHERE value > 50")
def roi_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = image(spark, sf_dir)
    return roi.intersection(rows.where(roi.rectangle(F.col("x"), F.col("y"), 10, 2, 40, 9)), rows.where("value > 50"))


@query("SELECT x, y FROM i WHERE x >= 10 AND x < 40 AND y >= 2 AND y < 9 EXCEPT SELECT x, y FROM i WHERE value > 50")
def roi_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = image(spark, sf_dir)
    return roi.difference(rows.where(roi.rectangle(F.col("x"), F.col("y"), 10, 2, 40, 9)), rows.where("value > 50"))


_LASSO = [(-0.1, -0.15), (0.2, -0.1), (0.15, 0.2), (-0.05, 0.1)]


def _crossings(x: str, y: str) -> str:
    edges = zip(_LASSO, [*_LASSO[1:], _LASSO[0]], strict=True)
    return " + ".join(f"((({y} < {ya}) <> ({y} < {yb})) AND {x} < ({xb - xa}) * ({y} - ({ya})) / ({yb - ya}) + ({xa}))::INT" for (xa, ya), (xb, yb) in edges if ya != yb)


@query(f"SELECT y, x FROM p WHERE ({_crossings('s[6]', 's[31]')}) % 2 = 1")
def scatter_lasso(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = roi.inside_polygon(F.get("spectrum", F.lit(5)), F.get("spectrum", F.lit(30)), _LASSO)
    return cube(spark, sf_dir).where(inside).select("y", "x")


@query(
    """SELECT least(floor((s[6] + 0.5) / (1.0 / 32)), 31)::INT AS col, least(floor((s[31] + 0.5) / (1.0 / 32)), 31)::INT AS row, count(*) AS n FROM p
       WHERE s[6] BETWEEN -0.5 AND 0.5 AND s[31] BETWEEN -0.5 AND 0.5 GROUP BY 1, 2"""
)
def scatter_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = cube(spark, sf_dir).select(F.get("spectrum", F.lit(5)).alias("px"), F.get("spectrum", F.lit(30)).alias("py"))
    return stats.density(points, 32, 32, (-0.5, 0.5, -0.5, 0.5))


def _unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.normalized(image(spark, sf_dir))


_UNIT = ", u AS (SELECT event_id, y, x, (value - (SELECT min(value) FROM i)) / ((SELECT max(value) FROM i) - (SELECT min(value) FROM i)) AS v FROM i)"
_HIST = _UNIT + ", h AS (SELECT b::INT AS bin, coalesce(n, 0)::BIGINT AS n FROM range(512) k(b) LEFT JOIN (SELECT least(floor(v / (1.0::DOUBLE / 512)), 511)::INT AS bin, count(*) AS n FROM u GROUP BY 1) c ON c.bin = k.b)"


@query(_HIST + " SELECT bin, n FROM h")
def histogram512(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(_unit(spark, sf_dir))


@query(
    _HIST
    + """ SELECT min(bin) FILTER (WHERE below >= t) AS low_bin, max(bin) FILTER (WHERE above >= t) AS high_bin FROM
      (SELECT bin, sum(n) OVER (ORDER BY bin) AS below, sum(n) OVER (ORDER BY bin DESC) AS above, (sum(n) OVER ()) * 0.05 / 2 AS t FROM h)"""
)
def percent_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.percent_clip(stats.histogram(_unit(spark, sf_dir)), 0.05)


@query(_UNIT + " SELECT y, x, round(greatest(0, least(1, (v - 0.2) * (1.0 / (0.8::DOUBLE - 0.2::DOUBLE)))), 6) AS value FROM u")
def stretch_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unit(spark, sf_dir).select("y", "x", F.round(stretch.linear(F.col("value"), 0.2, 0.8), 6).alias("value"))


@query(_UNIT + " SELECT y, x, round(greatest(0, least(1, (sqrt(v) - 0.1) * (1.0 / (0.9::DOUBLE - 0.1::DOUBLE)))), 6) AS value FROM u")
def stretch_sqrt(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = stretch.composite(stretch.square_root, lambda v: stretch.linear(v, 0.1, 0.9))
    return _unit(spark, sf_dir).select("y", "x", F.round(both(F.col("value")), 6).alias("value"))


@query(_UNIT + " SELECT y, x, round(log2(v + 1), 6) AS value FROM u")
def stretch_log2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unit(spark, sf_dir).select("y", "x", F.round(stretch.log2_plus_one(F.col("value")), 6).alias("value"))


@query(
    _HIST
    + """, c AS (SELECT bin, sum(n) OVER (ORDER BY bin) / sum(n) OVER () AS cdf FROM h), g AS (SELECT bin, cdf, lead(cdf) OVER (ORDER BY bin) AS nx FROM c)
      SELECT y, x, round(cdf + (v * 512 - bin) * coalesce(nx - cdf, 0), 6) AS value FROM u JOIN g ON g.bin = least(floor(v * 512), 511)"""
)
def stretch_equalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _unit(spark, sf_dir)
    return stretch.equalize(rows, stats.histogram(rows)).select("y", "x", r6("value"))


@query(_HIST + " SELECT bin, round(sqrt(bin / 512.0::DOUBLE), 6) AS edge, n FROM h")
def conditioned_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stretch.conditioned_edges(stats.histogram(_unit(spark, sf_dir)), stretch.square_root).select("bin", r6("edge"), "n")


@query(
    """SELECT y, x, 4278190080::BIGINT | (floor(greatest(0, least(1, s[31] + 0.5)) * 255)::BIGINT << 16) | (floor(greatest(0, least(1, s[14] + 0.5)) * 255)::BIGINT << 8)
       | floor(greatest(0, least(1, s[8] + 0.5)) * 255)::BIGINT AS rgb FROM p"""
)
def rgb_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = lambda b: stretch.channel(F.get("spectrum", F.lit(b)) + 0.5)
    return cube(spark, sf_dir).select("y", "x", stretch.rgb(c(30), c(13), c(7)).alias("rgb"))


@query("SELECT band AS channel, round(avg(min(v)) OVER (), 6) AS low, round(avg(max(v)) OVER (), 6) AS high FROM l WHERE band IN (7, 13, 30) GROUP BY band")
def linked_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = stats.band_stats(cube(spark, sf_dir), bands=BANDS).where("band IN (7, 13, 30)")
    found = stretch.linked_limits(limits.select(F.col("band").alias("channel"), F.col("min_value").alias("low"), F.col("max_value").alias("high")))
    return found.select("channel", r6("low"), r6("high"))


_GT = [400000.0, 30.0, 2.0, 5200000.0, 1.0, -30.0]


@query("SELECT event_id, 400000.0::DOUBLE + x * 30.0::DOUBLE + y * 2.0::DOUBLE AS gx, 5200000.0::DOUBLE + x * 1.0::DOUBLE + y * -30.0::DOUBLE AS gy FROM i")
def geo_affine(spark: SparkSession, sf_dir: str) -> DataFrame:
    gx, gy = geo.to_geo(F.col("x"), F.col("y"), _GT)
    return image(spark, sf_dir, "event_id").select("event_id", gx.alias("gx"), gy.alias("gy"))


@query(
    """SELECT event_id, trunc(((gx - 400000) * -30 - (gy - 5200000) * 2) / -902.0::DOUBLE + 0.5)::BIGINT AS px, trunc(((gy - 5200000) * 30 - (gx - 400000) * 1) / -902.0::DOUBLE + 0.5)::BIGINT AS py
       FROM (SELECT event_id, 400000.0::DOUBLE + x * 31.7::DOUBLE AS gx, 5200000.0::DOUBLE - y * 28.9::DOUBLE AS gy FROM i)"""
)
def geo_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = image(spark, sf_dir, "event_id").select("event_id", (400000.0 + F.col("x") * 31.7).alias("gx"), (5200000.0 - F.col("y") * 28.9).alias("gy"))
    px, py = geo.to_pixel(F.col("gx"), F.col("gy"), _GT)
    return rows.select("event_id", px.alias("px"), py.alias("py"))


def _boxes(spark: SparkSession, sf_dir: str, table_name: str, key: str, step: int) -> DataFrame:
    k = F.col(key)
    x0, y0 = (k * 37 % 1000).cast("double"), (k * 91 % 800).cast("double")
    return table(spark, sf_dir, table_name).select(k.cast("long").alias("ds_id"), x0.alias("x0"), (x0 + 5 + k % step).alias("x1"), y0.alias("y0"), (y0 + 3 + k % step).alias("y1"))


@query(
    """SELECT a.k AS a_id, b.k AS b_id FROM (SELECT s_suppkey::BIGINT AS k, s_suppkey * 37 % 1000 AS x0, s_suppkey * 91 % 800 AS y0, s_suppkey % 7 AS e FROM supplier) a,
       (SELECT c_custkey::BIGINT AS k, c_custkey * 37 % 1000 AS x0, c_custkey * 91 % 800 AS y0, c_custkey % 11 AS e FROM customer) b
       WHERE a.x0 <= b.x0 + 5 + b.e AND b.x0 <= a.x0 + 5 + a.e AND a.y0 <= b.y0 + 3 + b.e AND b.y0 <= a.y0 + 3 + a.e""",
    with_inputs=False,
)
def bbox_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.overlaps(_boxes(spark, sf_dir, "supplier", "s_suppkey", 7), _boxes(spark, sf_dir, "customer", "c_custkey", 11), 16.0)


@query()
def gcp_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A polynomial of order two through points that follow one, with residuals; the tests tell its coefficients."""
    rows = image(spark, sf_dir, "event_id").select("event_id", (F.col("x") / 100.0).alias("px"), (F.col("y") / 100.0).alias("py"))
    points = rows.select("*", (3.0 + 2.0 * F.col("px") - F.col("py") + 0.5 * F.col("px") * F.col("px")).alias("gx"), (1.0 - F.col("px") + 4.0 * F.col("py") * F.col("py")).alias("gy"))
    return geo.fit_points(points, 2)[1].select("event_id", F.round("gx_fit", 3).alias("gx_fit"), F.round("gy_fit", 3).alias("gy_fit"))


ORACLE["gcp_fit"] = f"WITH {SQL} SELECT event_id, round(3.0 + 2.0 * (x / 100.0::DOUBLE) - y / 100.0::DOUBLE + 0.5 * (x / 100.0::DOUBLE) * (x / 100.0::DOUBLE), 3) AS gx_fit, round(1.0 - x / 100.0::DOUBLE + 4.0 * (y / 100.0::DOUBLE) * (y / 100.0::DOUBLE), 3) AS gy_fit FROM i"


@query("SELECT (24 - x)::INT AS y, y AS x, round(s[4], 6) AS value FROM p")
def rotate_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter turn of the whole band; its height is the table's."""
    band = raster.one_band(cube(spark, sf_dir), 3)
    height = (band.agg(F.max("y")).first()[0] or 0) + 1
    return geo.rotate_nearest(band, 90.0, 1.0, 25, height).select("y", "x", r6("value"))


@query(
    """SELECT event_id, round((CASE WHEN event_id % 2 = 1 THEN -1 ELSE 1 END) * (event_id % 180 + (event_id % 60) / 60.0::DOUBLE + (event_id % 50) / 3600.0::DOUBLE), 6) AS degrees FROM events""",
    with_inputs=False,
)
def dms_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    written = F.concat_ws("", (i % 180).cast("string"), F.lit("° "), (i % 60).cast("string"), F.lit("' "), (i % 50).cast("string"), F.lit('" '), F.when(i % 2 == 1, "W").otherwise("N"))
    return table(spark, sf_dir, "events").select("event_id", F.round(text.parse_dms(written), 6).alias("degrees"))


@query("SELECT c_custkey, regexp_replace(trim(regexp_replace(c_name || ' # ' || c_mktsegment || chr(10) || '/x  y' || CASE WHEN c_custkey % 3 = 0 THEN ' !' ELSE chr(9) END, '\\s+', ' ', 'g')), '[^A-Za-z0-9 ._-]', '', 'g') AS file FROM customer", with_inputs=False)
def filenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", text.make_filename(F.concat("c_name", F.lit(" # "), "c_mktsegment", F.lit("\n/x  y"), F.when(F.col("c_custkey") % 3 == 0, " !").otherwise("\t"))).alias("file"))


@query(
    """SELECT d AS delimiter, round(avg(length(html) - length(replace(html, d, ''))), 6) AS per_line FROM pages, (SELECT unnest([',', chr(9), ';', ' ']) AS d) GROUP BY d""",
    with_inputs=False,
)
def delimiter_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.delimiter_scores(table(spark, sf_dir, "pages"), column="html").select("delimiter", r6("per_line"))


@query("SELECT base, max(name) FILTER (WHERE best) AS name FROM (SELECT base, name, row_number() OVER (PARTITION BY base ORDER BY ext DESC, name) = 1 AS best FROM (SELECT 'scene' || (p_partkey // 3) AS base, 'scene' || (p_partkey // 3) || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '.hdr' ELSE '.img' END AS name, (p_partkey % 3 > 0)::INT AS ext FROM part)) GROUP BY base", with_inputs=False)
def batch_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of one base name count once, one with an extension first."""
    from lumenfold.sources.folder import one_of_each

    names = table(spark, sf_dir, "part").selectExpr("concat('scene', p_partkey div 3, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '.hdr' ELSE '.img' END) AS name")
    return one_of_each(names)
