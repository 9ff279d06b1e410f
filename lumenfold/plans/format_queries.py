"""Queries that write the driver's tables as raster files and read them back, each with its SQL."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.plans.inputs import SQL, WAVELENGTHS, cube
from lumenfold.session import scratch
from lumenfold.sources import datasource, rasters

QUERIES, ORACLE = {}, {}

#: Format, order of the values and their type; embeddings are 32-bit numbers, so that all are exact.
FORMATS = {"envi": ("bil", "f4"), "gtiff": ("bip", "f4"), "fits": ("bsq", "f8"), "netcdf": ("bsq", "f4"), "pds3": ("bil", "f4"), "pds4": ("bsq", "f8")}


def _written(spark: SparkSession, sf_dir: str, format: str) -> tuple[str, int]:
    """A cube without its pixels of column 7, as one file of several tasks below ``spark.checkpoint.dir``; (path, height)."""
    rows = cube(spark, sf_dir)
    height = (rows.agg(F.max("y")).first()[0] or 0) + 1
    order, kind = FORMATS[format]
    at = f"{scratch(spark)}/{format}-{uuid4().hex}/cube.img"
    options = {"width": 25, "height": height, "bands": 64, "interleave": order, "kind": kind, "wavelengths": WAVELENGTHS, "unit": "nm", "gt": [1000.0, 2.0, 0.0, 5000.0, 0.0, -2.0]}
    datasource.write_file(rows.where("x <> 7"), at, format, lines=max(1, height // 8), **options)
    return at, height


def _round_trip(format: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        at, _ = _written(spark, sf_dir, format)
        back = spark.read.format(format).option("blockbytes", 1 << 20).load(at)
        total = F.aggregate(F.transform("spectrum", lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v)
        return back.select("y", "x", F.round(total, 6).alias("total"), F.size(F.filter("spectrum", lambda v: v.isNotNull())).cast("long").alias("n"))

    query.__doc__ = f"All bands of a cube through one {format} file that many tasks fill; pixels that it lacks are NULL."
    return query


_BACK = f"""WITH {SQL}, hh AS (SELECT max(y) AS h FROM p), g AS (SELECT yy.i::INT AS y, xx.i::INT AS x FROM range((SELECT h + 1 FROM hh)) yy(i), range(25) xx(i))
SELECT g.y, g.x, round(list_sum(list_transform(range(64), lambda b: s[b + 1] * (b + 1))), 6) AS total, CASE WHEN s IS NULL THEN 0 ELSE 64 END::BIGINT AS n FROM g LEFT JOIN p ON p.y = g.y AND p.x = g.x AND p.x <> 7"""
for _format in FORMATS:
    QUERIES[f"{_format}_file"], ORACLE[f"{_format}_file"] = _round_trip(_format), _BACK


def raster_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the headers of files of all formats say, the format found from each."""
    found = None
    for format in FORMATS:
        at, _ = _written(spark, sf_dir, format)
        info = rasters.raster_info(spark, at.rsplit("/", 1)[0])
        waves = rasters.raster_bands(spark, at.rsplit("/", 1)[0]).groupBy("path").agg(F.count(F.lit(1)).alias("bands_told"), F.round(F.sum("wavelength"), 3).alias("waves"))
        own = info.join(waves, "path").select("format", "width", "height", "bands", "bands_told", "waves", F.get("gt", F.lit(0)).alias("left"))
        found = own if found is None else found.union(own)
    return found


QUERIES["raster_files"] = raster_files
ORACLE["raster_files"] = f"""WITH {SQL} SELECT f AS format, 25 AS width, (max(y) + 1)::INT AS height, 64 AS bands, 64::BIGINT AS bands_told,
CASE WHEN f IN ('gtiff', 'pds4') THEN NULL ELSE 45760.0::DOUBLE END AS waves, CASE WHEN f IN ('pds3', 'pds4') THEN NULL ELSE 1000.0::DOUBLE END AS "left" FROM p, (SELECT unnest(['envi', 'gtiff', 'fits', 'netcdf', 'pds3', 'pds4']) AS f) GROUP BY f"""
