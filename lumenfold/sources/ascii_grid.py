"""Grids as text: some header lines of a key and a value, then the rows of values from north to south.

A file is read by splits of its lines, which many tasks share. How many values each split has tells where its first one
lies, so that values may be broken into lines anyhow; only a line is read as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Keys of the format.
KEYS = ("ncols", "nrows", "xllcorner", "xllcenter", "yllcorner", "yllcenter", "cellsize", "dx", "dy", "nodata_value")
HEAD = 100  # lines with text in which a header ends: each key and each value may have its own


def _found(spark: SparkSession, kind: str, path: str) -> DataFrame:
    return spark.read.format(kind).option("pathGlobFilter", "*.asc").option("recursiveFileLookup", "true").load(path)


def _cells(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(text, r"\s+", " "), " "), lambda c: c != "")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, start, line, value): lines with the place of their split; ``line`` grows within a split."""
    return _found(spark, "text", path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"), "value")


def _heads(spark: SparkSession, path: str) -> DataFrame:
    """(path, head, skip) of all files: the header as pairs of a key and a value, and how many texts it has."""
    first = _lines(spark, path).where("start = 0").withColumn("cells", _cells(F.col("value"))).where("size(cells) > 0")
    first = first.withColumn("at", F.row_number().over(Window.partitionBy("path").orderBy("line"))).where(F.col("at") <= HEAD)
    texts = first.groupBy("path").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", F.slice("cells", 1, 2 * HEAD).alias("c")))), lambda s: s.c)).alias("t"))
    is_key = lambda i: F.coalesce(F.lower(F.get("t", (2 * i).cast("int"))).isin(*KEYS) & F.get("t", (2 * i + 1).cast("int")).isNotNull(), F.lit(False))
    pairs = F.array_position(F.transform(F.sequence(F.lit(0), F.floor(F.size("t") / 2)), is_key), False) - 1
    heads = texts.withColumn("skip", 2 * pairs).select("path", F.array_join(F.slice("t", F.lit(1), F.col("skip").cast("int")), " ").alias("head"), "skip")
    files = _found(spark, "binaryFile", path).select(F.col("_metadata.file_path").alias("path"))
    return files.join(heads, "path", "left").select("path", F.coalesce("head", F.lit("")).alias("head"), F.coalesce("skip", F.lit(0)).cast("long").alias("skip"))


def _key(name: str) -> Column:
    return F.regexp_extract("head", rf"(?i)\b{name}\s+(\S+)", 1).try_cast("double")


def read_info(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height, ignore_value, gt): a geotransform from the lower left corner or the centre of its cell."""
    dx, dy = F.coalesce(_key("cellsize"), _key("dx")), F.coalesce(_key("cellsize"), _key("dy"))
    left = F.coalesce(_key("xllcorner"), _key("xllcenter") - dx / 2, F.lit(0.0))
    low = F.coalesce(_key("yllcorner"), _key("yllcenter") - dy / 2, F.lit(0.0))
    gt = F.array(left, dx, F.lit(0.0), low + _key("nrows") * dy, F.lit(0.0), -dy)
    return _heads(spark, path).select("path", _key("ncols").cast("int").alias("width"), _key("nrows").cast("int").alias("height"), _key("nodata_value").alias("ignore_value"), gt.alias("gt"))


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    """(path, y, x, value), NULL for the value that stands for no data; a file with too few or too many values raises."""
    lines = _lines(spark, path).withColumn("n", F.size(_cells(F.col("value"))).cast("long"))
    # a row for each split: how many values the file has before it
    splits = lines.groupBy("path", "start").agg(F.sum("n").alias("s"))
    splits = splits.select("path", "start", (F.sum("s").over(Window.partitionBy("path").orderBy("start")) - F.col("s")).alias("before"), F.sum("s").over(Window.partitionBy("path")).alias("total"))
    known = _heads(spark, path).select("path", "skip", _key("ncols").cast("int").alias("w"), _key("nrows").cast("int").alias("h"), _key("nodata_value").alias("none")).join(splits, "path", "left")
    right = F.col("w").isNotNull() & (F.col("total") - F.col("skip") == F.col("w").cast("long") * F.col("h"))
    first = F.when(right, F.col("before") - F.col("skip")).otherwise(F.raise_error(F.concat(F.lit("not the values that its header tells: "), F.col("path"))))
    known = known.select("path", "start", "w", "none", first.alias("first"))
    placed = lines.withColumn("own", F.sum("n").over(Window.partitionBy("path", "start").orderBy("line")) - F.col("n")).join(F.broadcast(known), ["path", "start"])
    rows = placed.select("path", "w", "none", (F.col("first") + F.col("own")).alias("base"), F.posexplode(_cells(F.col("value"))).alias("i", "cell")).withColumn("at", F.col("base") + F.col("i")).where("at >= 0")
    rows = rows.withColumn("v", F.col("cell").try_cast("double"))
    missing = F.isnan("v") | F.coalesce(F.col("v") == F.col("none"), F.lit(False))
    return rows.select("path", F.floor(F.col("at") / F.col("w")).cast("int").alias("y"), (F.col("at") % F.col("w")).cast("int").alias("x"), F.when(~missing, F.col("v")).alias("value"))
