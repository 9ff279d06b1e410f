"""Queries that write libraries, regions, control points, selections, reports and grids as files and read them back."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.operators import matching
from lumenfold.operators.bandmath import evaluate
from lumenfold.plans.inputs import BANDS, SQL, WAVELENGTHS, cube, image, references, table
from lumenfold.plans.spectral_queries import _DOTS, _GRID, _SEGMENTS
from lumenfold.session import scratch
from lumenfold.sources import ascii_grid, datasource, envi, folder, gcp, geojson, spectra_text

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, f"WITH {SQL}{sql}"
        return f

    return add


def _at(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/{name}-{uuid4().hex}"


@query(" SELECT vec_id AS spec_id, 'vector ' || vec_id AS name, 64 AS size, round(list_sum(list_transform(range(64), lambda b: s[b + 1] * (b + 1))), 4) AS total, 45760.0::DOUBLE AS waves FROM p")
def library_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A spectral library of all vectors, written by many tasks and read back with its names and wavelengths."""
    rows = cube(spark, sf_dir, "vec_id")
    lines = rows.select(F.col("vec_id").cast("int").alias("y"), F.posexplode("spectrum").alias("x", "v")).select("y", "x", F.array("v").alias("spectrum"))
    n = (rows.agg(F.max("vec_id")).first()[0] or 0) + 1
    at = _at(spark, "library")
    datasource.write_file(lines, f"{at}/all.sli", "envi", lines=max(1, n // 8), width=BANDS, height=n, bands=1, kind="f8")
    names = [f"vector {r['vec_id']}" for r in rows.select("vec_id").orderBy("vec_id").toLocalIterator()]  # the header's own list
    header = {"samples": BANDS, "lines": n, "bands": 1, "data type": 5, "interleave": "bsq", "byte order": 0, "file type": "ENVI Spectral Library", "wavelength units": "um", "wavelength": [w / 1000 for w in WAVELENGTHS], "spectra names": names}
    envi.put(f"{at}/all.hdr", envi.write_header(header).encode())
    total = F.aggregate(F.transform("values", lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v)
    return envi.read_library(spark, at).select("spec_id", "name", F.size("values").alias("size"), F.round(total, 4).alias("total"), F.round(F.aggregate("wavelengths", F.lit(0.0), lambda s, v: s + v), 3).alias("waves"))


@query(
    """, k AS (SELECT 'nation ' || s_nationkey AS name, s_suppkey AS k, (s_suppkey % 40)::DOUBLE AS x, (s_suppkey % 30)::DOUBLE AS y FROM supplier)
    SELECT name, CASE k % 4 WHEN 0 THEN 'Point' WHEN 1 THEN 'MultiPoint' WHEN 2 THEN 'Rectangle' ELSE 'Polygon' END AS type, CASE k % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 3 END AS corners,
      CASE k % 4 WHEN 0 THEN x + 2 * y WHEN 1 THEN 2 * x + 3 + 2 * (2 * y + 4) WHEN 2 THEN 4 * x + 10 + 2 * (4 * y + 8) ELSE 3 * x + 8 + 2 * (3 * y + 7) END AS total FROM k"""
)
def geojson_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of all kinds as GeoJSON, a file of each nation, read back: four corners along the axes are a rectangle."""
    k = F.col("s_suppkey")
    p = lambda dx, dy: F.array((k % 40 + dx).cast("double"), (k % 30 + dy).cast("double"))
    kinds = [("Point", [p(0, 0)]), ("MultiPoint", [p(0, 0), p(3, 4)]), ("Rectangle", [p(0, 0), p(5, 0), p(5, 4), p(0, 4)]), ("Polygon", [p(0, 0), p(6, 1), p(2, 6)])]
    pick = lambda f: F.get(F.array(*map(f, kinds)), (k % 4).cast("int"))
    rois = table(spark, sf_dir, "supplier").select(F.concat(F.lit("nation "), F.col("s_nationkey").cast("string")).alias("name"), pick(lambda x: F.lit(x[0])).alias("type"), pick(lambda x: F.array(*x[1])).alias("points"))
    at = _at(spark, "regions")
    geojson.write_rois(rois).write.option("maxRecordsPerFile", 1).text(at)
    total = F.aggregate("points", F.lit(0.0), lambda s, q: s + q[0] + 2 * q[1])
    return geojson.read_rois(spark, at).select("name", "type", F.size("points").alias("corners"), total.alias("total"))


@query(" SELECT kind, round(c_custkey * 1.5::DOUBLE, 3) AS px, round(c_custkey * 0.25::DOUBLE, 3) AS py, round(500000 + c_custkey * 2.0::DOUBLE, 3) AS gx, round(4000000 - c_custkey * 3.0::DOUBLE, 3) AS gy FROM customer, (SELECT unnest(['qgis', 'envi']) AS kind)")
def control_point_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control points as files of both formats, read back."""
    k = F.col("c_custkey")
    points = table(spark, sf_dir, "customer").select((k * 1.5).alias("px"), (k * 0.25).alias("py"), (500000 + k * 2.0).alias("gx"), (4000000 - k * 3.0).alias("gy"))
    out = None
    for kind, lines, read in (("qgis", gcp.qgis_lines, gcp.read_qgis), ("envi", gcp.envi_lines, gcp.read_envi)):
        at = _at(spark, "points")
        lines(points).write.text(at)
        own = read(spark, at).select(F.lit(kind).alias("kind"), *(F.round(c, 3).alias(c) for c in ("px", "py", "gx", "gy")))
        out = own if out is None else out.union(own)
    return out


@query(" SELECT y AS row, x AS col, round(s[4], 4) AS x_band, round(s[10], 4) AS y_band FROM p WHERE s[4] > s[10]")
def scatter_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected points of a scatter plot as CSV with a header, read back."""
    at = lambda b: F.get("spectrum", F.lit(b))
    chosen = cube(spark, sf_dir).where(at(3) > at(9)).select("y", "x", at(3).alias("px"), at(9).alias("py"))
    path = _at(spark, "scatter")
    spectra_text.scatter_selection(chosen).write.option("header", "true").csv(path)
    back = spark.read.option("header", "true").schema("row int, col int, x_band double, y_band double").csv(path)
    return back.select("row", "col", F.round("x_band", 4).alias("x_band"), F.round("y_band", 4).alias("y_band"))


@query(_DOTS + "SELECT row_number() OVER (ORDER BY round(score, 2), ref_id, vec_id)::INT AS line, vec_id || ',' || ref_id || ',' || round(score, 2) AS value FROM a WHERE round(score, 2) > 0")
def match_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches as the lines of a report, best first, with their order as the file has it."""
    pixels = cube(spark, sf_dir, "vec_id").select("vec_id", "spectrum")
    found = matching.sam(pixels, references(spark, sf_dir)).select("vec_id", "ref_id", F.round("score", 2).alias("score")).where("score > 0")
    numbered = spectra_text.match_report(found).withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    parts = numbered.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return numbered.join(parts, "part").select((F.col("before") + F.col("at") - F.shiftleft("part", 33) + 1).cast("int").alias("line"), "value")


@query(
    """, g AS (SELECT y, x, band, round(v + 1.5, 4) AS v FROM l WHERE x BETWEEN 3 AND 5 AND y BETWEEN 2 AND 3)
    SELECT 0 AS line, 'band' || chr(9) || string_agg('(' || x || ' ' || y || ')', chr(9) ORDER BY x, y) AS text FROM (SELECT DISTINCT x, y FROM g) UNION ALL SELECT band + 1, band || chr(9) || string_agg(v::VARCHAR, chr(9) ORDER BY x, y) FROM g GROUP BY band"""
)
def pixel_spectra_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pixels of a region as the columns of a text."""
    inside = cube(spark, sf_dir).where("x BETWEEN 3 AND 5 AND y BETWEEN 2 AND 3")
    rows = inside.select("x", "y", F.posexplode("spectrum").alias("band", "v")).select("x", "y", "band", F.round(F.col("v") + 1.5, 4).alias("value"))
    return spectra_text.export_pixel_spectra(rows)


@query(", q AS (SELECT y, x, CASE WHEN event_id % 13 <> 5 THEN round(value, 2) END AS v FROM i) SELECT y, x, v AS value, 100 AS width, 2500.0::DOUBLE AS \"left\", -30.0::DOUBLE AS step FROM q")
def ascii_grid_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A band as a grid of text, written by one task as the format is one file, and read back with its header."""
    band = image(spark, sf_dir, "event_id").select("y", "x", F.when(F.col("event_id") % 13 != 5, F.round("value", 2)).alias("value"))
    height = (band.agg(F.max("y")).first()[0] or 0) + 1
    cell = F.coalesce(F.col("value").cast("decimal(18,2)").cast("string"), F.lit("-9999"))
    lines = band.groupBy("y").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", cell.alias("t")))), lambda c: c.t), " ").alias("text"))
    at = f"{_at(spark, 'grid')}/band.asc"

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = f"ncols 100\nnrows {height}\nxllcorner 2500.0\nyllcorner 70.0\ncellsize 30.0\nNODATA_value -9999\n"
        envi.put(at, chain([head.encode()], ("".join(f"{t}\n" for t in b["text"].to_pylist()).encode() for b in batches)))
        yield pa.record_batch([pa.array([height])], names=["n"])

    lines.repartition(1).sortWithinPartitions("y").mapInArrow(put, "n long").collect()
    info = ascii_grid.read_info(spark, at).select("path", "width", F.get("gt", F.lit(0)).alias("left"), F.get("gt", F.lit(5)).alias("step"))
    return ascii_grid.read_grid(spark, at).join(F.broadcast(info), "path").join(band.select("y", "x"), ["y", "x"]).select("y", "x", "value", "width", "left", "step")


@query(" SELECT p_partkey, 'scene' || p_partkey || '_ndvi' AS result FROM part")
def batch_result_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of a batch's results."""
    k = F.col("p_partkey").cast("string")
    return table(spark, sf_dir, "part").select("p_partkey", folder.result_name(F.concat(F.lit("file:/a.b/scene"), k, F.when(F.col("p_partkey") % 2 == 0, ".img").otherwise("")), "_ndvi").alias("result"))


@query(" SELECT event_id, round(value * (2 * 3 + sqrt(14 * 14 + 2)) / 4.0::DOUBLE, 6) AS value FROM i")
def bm_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An expression of numbers and spectra is a number, a column like any other."""
    kind, number = evaluate("(2 * 3 + (dotprod(s, s) ** 2 + 2) ** 0.5) / 4", {"s": [1.0, 2.0, 3.0]})
    return image(spark, sf_dir, "event_id").select("event_id", F.round(F.col("value") * number, 6).alias("value")) if kind == "number" else None


@query(
    _SEGMENTS
    + _GRID
    + """, v AS (SELECT ref_id, band, v0 + (v1 - v0) * (wavelength - w0) / (w1 - w0) AS rv FROM c JOIN grid ON wavelength >= w0 AND wavelength < w1 AND v1 IS NOT NULL),
    m AS (SELECT vec_id, ref_id, sum(rv * s[band + 1]) AS tr, sum(s[band + 1] * s[band + 1]) AS tt, sum(rv * rv) AS rr FROM v, p GROUP BY vec_id, ref_id), d AS (SELECT vec_id, ref_id, round(degrees(acos(greatest(-1, least(1, tr / (sqrt(tt) * sqrt(rr)))))), 3) AS score FROM m)
    SELECT vec_id, ref_id, score FROM d WHERE score < 80"""
)
def sam_spectrum_other_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single spectra against references of another grid: only bands that both have count."""
    coarse = F.filter("ref", lambda v, i: i % 2 == 0)
    refs = references(spark, sf_dir).select("ref_id", F.lit("nm").alias("unit"), F.transform(coarse, lambda v, i: 400.0 + 20 * i).alias("wavelengths"), coarse.alias("values"), F.transform(coarse, lambda v: F.lit(True)).alias("good"))
    found, _ = matching.on_target_bands(refs, [405.0 + 10 * b for b in range(BANDS)])
    targets = cube(spark, sf_dir, "vec_id").select("vec_id", "spectrum")
    return matching.sam(targets, found, mode="spectrum").select("vec_id", "ref_id", F.round("score", 3).alias("score")).where("score < 80")
