"""Regions of interest as GeoJSON features: points, multipoints, polygons and collections of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GEOMETRY = "struct<type: string, coordinates: string>"
FEATURES = "struct<features: array<struct<properties: map<string, string>, geometry: struct<type: string, coordinates: string, geometries: array<struct<type: string, coordinates: string>>>>>>"
RING = "array<array<array<double>>>"


def read_rois(spark: SparkSession, path: str) -> DataFrame:
    """(name, type, points): a row for each geometry; points are (x, y) pairs, a polygon's without the closing one."""
    whole = spark.read.text(path, wholetext=True)
    features = whole.select(F.explode(F.from_json("value", FEATURES).features).alias("f"))
    single = F.array(F.struct(F.col("f.geometry.type").alias("type"), F.col("f.geometry.coordinates").alias("coordinates")))
    parts = features.select(F.col("f.properties")["name"].alias("name"), F.explode(F.coalesce("f.geometry.geometries", single)).alias("g"))
    point = F.array(F.from_json("g.coordinates", "array<double>"))
    many = F.from_json("g.coordinates", "array<array<double>>")
    ring = F.get(F.from_json("g.coordinates", RING), F.lit(0))
    points = F.when(F.col("g.type") == "Point", point).when(F.col("g.type") == "MultiPoint", many).otherwise(F.slice(ring, 1, F.size(ring) - 1))
    found = parts.select("name", F.col("g.type").alias("kind"), points.alias("points"))
    return found.select("name", F.when((F.col("kind") == "Polygon") & axis_aligned(F.col("points")), "Rectangle").otherwise(F.col("kind")).alias("type"), "points")


def axis_aligned(points):
    """Four corners with two values of x and two of y, and sides along the axes."""
    xs, ys = F.array_distinct(F.transform(points, lambda p: p[0])), F.array_distinct(F.transform(points, lambda p: p[1]))
    side = lambda i, j: (F.get(points, F.lit(i))[0] == F.get(points, F.lit(j))[0]) | (F.get(points, F.lit(i))[1] == F.get(points, F.lit(j))[1])
    return (F.size(points) == 4) & (F.size(xs) == 2) & (F.size(ys) == 2) & side(0, 1) & side(1, 2) & side(2, 3) & side(3, 0)


def write_rois(rois: DataFrame) -> DataFrame:
    """(value): a GeoJSON text for each name of (name, type, points); write it with ``maxRecordsPerFile`` 1, a file for each."""
    closed = F.concat("points", F.slice("points", 1, 1))
    coordinates = F.when(F.col("type") == "Point", F.to_json(F.get("points", F.lit(0)))).when(F.col("type") == "MultiPoint", F.to_json("points")).otherwise(F.to_json(F.array(closed)))
    kind = F.when(F.col("type") == "Rectangle", "Polygon").otherwise(F.col("type"))
    one = F.format_string('{"type": "%s", "coordinates": %s}', kind, coordinates)
    parts = rois.groupBy("name").agg(F.array_sort(F.collect_list(one)).alias("g"))
    geometry = F.when(F.size("g") == 1, F.get("g", F.lit(0))).otherwise(F.concat(F.lit('{"type": "GeometryCollection", "geometries": ['), F.array_join("g", ", "), F.lit("]}")))
    name = F.to_json(F.struct("name"))
    return parts.select(F.concat(F.lit('{"type": "FeatureCollection", "features": [{"type": "Feature", "properties": '), name, F.lit(', "geometry": '), geometry, F.lit("}]}")).alias("value"))
