"""Ground control points: QGIS .points files (CSV) and ENVI .pts files (four numbers a line, ; comments)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTS = "px double, py double, gx double, gy double"


def read_qgis(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & ~F.lower("value").startswith("mapx") & (F.trim("value") != ""))
    cell = lambda i: F.get(F.split("value", ","), F.lit(i)).try_cast("double")
    return lines.select(cell(2).alias("px"), (-cell(3)).alias("py"), cell(0).alias("gx"), cell(1).alias("gy"))


def qgis_lines(points: DataFrame) -> DataFrame:
    head = points.sparkSession.createDataFrame([(0, "mapX,mapY,sourceX,sourceY,enable")], "o int, value string")
    body = points.select(F.lit(1).alias("o"), F.concat_ws(",", F.col("gx").cast("string"), F.col("gy").cast("string"), F.col("px").cast("string"), (-F.col("py")).cast("string"), F.lit("1")).alias("value"))
    return head.union(body).coalesce(1).sortWithinPartitions("o").select("value")


def read_envi(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).where(~F.trim("value").startswith(";") & (F.trim("value") != ""))
    cell = lambda i: F.get(F.split(F.trim("value"), r"[\s,]+"), F.lit(i)).try_cast("double")
    return lines.select(cell(2).alias("px"), cell(3).alias("py"), cell(0).alias("gx"), cell(1).alias("gy"))


def envi_lines(points: DataFrame) -> DataFrame:
    head = points.sparkSession.createDataFrame([(0, "; ENVI Image to Map GCP File")], "o int, value string")
    body = points.select(F.lit(1).alias("o"), F.concat_ws(" ", *(F.col(c).cast("string") for c in ("gx", "gy", "px", "py"))).alias("value"))
    return head.union(body).coalesce(1).sortWithinPartitions("o").select("value")
