"""Batches: a folder of rasters as one DataFrame, and the names of what is made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    """The name of a file without its folder and extension."""
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)


def one_of_each(names: DataFrame, column: str = "name") -> DataFrame:
    """(base, name): of the files with one base name one, with an extension first."""
    bare = (~F.col(column).rlike(r"[^/]\.[^./]+$")).cast("int")
    best = F.min(F.struct(bare.alias("bare"), F.col(column).alias("name"))).alias("best")
    return names.groupBy(base_name(F.col(column)).alias("base")).agg(best).select("base", "best.name")


def result_name(path: Column, suffix: str) -> Column:
    return F.concat(base_name(path), F.lit(suffix))
