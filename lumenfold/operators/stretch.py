"""Contrast stretches and rendering of channels, as expressions over normalised values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clip(x: Column) -> Column:
    """Into 0 to 1; a missing value stays missing (least and greatest alone would pass over it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def linear(x: Column, low: float, high: float) -> Column:
    if high <= low:
        raise ValueError("the upper limit must be above the lower")
    return clip((x - low) * (1.0 / (high - low)))


def square_root(x: Column) -> Column:
    return F.sqrt(x)


def log2_plus_one(x: Column) -> Column:
    return F.log2(x + 1)


def composite(*steps):
    """One stretch of several, first to last."""
    return lambda x: reduce(lambda v, step: step(v), steps, x)


def cumulative(hist: DataFrame) -> DataFrame:
    """(bin, cdf) of a histogram, which has as many rows as bins."""
    below = F.sum("n").over(Window.orderBy("bin"))
    return hist.select("bin", (below / F.sum("n").over(Window.partitionBy())).alias("cdf"))


def equalize(band: DataFrame, hist: DataFrame, bins: int = 512) -> DataFrame:
    """Histogram equalisation: values are interpolated in the cumulative distribution at the lower edges of the bins.

    A value meets the segment of its bin by an equi-join with the few rows of the distribution.
    """
    order = Window.orderBy("bin")
    segments = cumulative(hist).withColumn("next", F.lead("cdf").over(order))
    joined = band.withColumn("bin", F.least(F.greatest(F.floor(F.col("value") * bins), F.lit(0)), F.lit(bins - 1)).cast("int")).join(F.broadcast(segments), "bin", "left")  # as many rows as bins
    share = F.col("value") * bins - F.col("bin")
    return joined.withColumn("value", F.col("cdf") + F.greatest(share, F.lit(0.0)) * F.coalesce(F.col("next") - F.col("cdf"), F.lit(0.0))).drop("bin", "cdf", "next")


def conditioned_edges(hist: DataFrame, condition, bins: int = 512) -> DataFrame:
    """A histogram with the lower edges of its bins put through a conditioner; counts stay."""
    return hist.select("bin", condition(F.col("bin") / bins).alias("edge"), "n")


def bounded(x: Column, low: float, high: float) -> Column:
    """Values outside the bounds become NULL, the rest is normalised to them."""
    return F.when(x.between(low, high), (x - low) / (high - low))


def channel(x: Column) -> Column:
    """0 to 255, cut off; missing pixels are 0."""
    return F.coalesce(F.floor(clip(x) * 255), F.lit(0)).cast("long")


def rgb(red: Column, green: Column, blue: Column) -> Column:
    """Opaque packed pixels."""
    return F.lit(0xFF000000).bitwiseOR(F.shiftleft(red, 16)).bitwiseOR(F.shiftleft(green, 8)).bitwiseOR(blue)


def grayscale(x: Column) -> Column:
    return rgb(x, x, x)


def colour_mapped(band: DataFrame, colours: DataFrame) -> DataFrame:
    """``band`` (with a channel ``level``) looked up in (level, colour), which has 256 rows."""
    return band.join(F.broadcast(colours), "level")


def linked_limits(limits: DataFrame) -> DataFrame:
    """Low and high of the channels replaced by their averages."""
    whole = Window.partitionBy()
    return limits.select("channel", F.avg("low").over(whole).alias("low"), F.avg("high").over(whole).alias("high"))


def to_unit(x: Column, low: float, high: float) -> Column:
    """A raw bound as a share of the range of a band."""
    return (x - low) / (high - low)


def from_unit(x: Column, low: float, high: float) -> Column:
    return low + x * (high - low)
