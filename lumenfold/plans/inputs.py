"""The driver's tables seen as rasters: embeddings as a cube of 64 bands, events as an image band."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BANDS = 64
WAVELENGTHS = [400.0 + 10 * b for b in range(BANDS)]
GOOD = [b % 16 != 15 for b in range(BANDS)]
RAMP = [b / 64 for b in range(BANDS)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cube(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """(…extra, y, x, spectrum)"""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(*extra, F.floor(F.col("vec_id") / 25).cast("int").alias("y"), (F.col("vec_id") % 25).cast("int").alias("x"), F.col("embedding").cast("array<double>").alias("spectrum"))


def image(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """(…extra, y, x, value)"""
    rows = table(spark, sf_dir, "events")
    return rows.select(*extra, F.floor(F.col("event_id") / 100).cast("int").alias("y"), (F.col("event_id") % 100).cast("int").alias("x"), "value")


def bands(spark: SparkSession) -> DataFrame:
    return spark.range(BANDS).select(F.lit(0).cast("long").alias("ds_id"), F.col("id").cast("int").alias("band"), (400.0 + 10 * F.col("id")).alias("wavelength"), F.lit("nm").alias("unit"), (F.col("id") % 16 != 15).alias("good"))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ref_id, ref): the spectrum of the smallest vec_id of each label."""
    return cube(spark, sf_dir, "vec_id", "label").groupBy(F.col("label").cast("long").alias("ref_id")).agg(F.min_by("spectrum", "vec_id").alias("ref"))


#: The same in SQL. p: pixels with list s; l: a row for each band; i: image; r: references.
SQL = """
p AS (SELECT vec_id, label, (vec_id // 25)::INT AS y, (vec_id % 25)::INT AS x, list_transform(embedding, lambda v: v::DOUBLE) AS s FROM embeddings),
l AS (SELECT vec_id, label, y, x, n.band::INT AS band, s[n.band + 1] AS v FROM p, range(64) n(band)),
i AS (SELECT event_id, event_type, (event_id // 100)::INT AS y, (event_id % 100)::INT AS x, value FROM events),
r AS (SELECT label::BIGINT AS ref_id, arg_min(s, vec_id) AS ref FROM p GROUP BY label),
ramp AS (SELECT list_transform(range(64), lambda b: b / 64.0::DOUBLE) AS q)
"""
