"""Aggregates over bands: limits, histograms, percent clips and densities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.registry import finite

BINS = 512


def band_stats(cube: DataFrame, keys: Sequence[str] = (), bands: int | None = None) -> DataFrame:
    """(…keys, band, min, max) over finite values. With the number of bands known there is one row of aggregates and no explode."""
    if bands is None:
        rows = cube.select(*keys, F.posexplode("spectrum").alias("band", "value")).withColumn("value", finite(F.col("value")))
        return rows.groupBy(*keys, "band").agg(F.min("value").alias("min_value"), F.max("value").alias("max_value"))
    values = [finite(F.get("spectrum", F.lit(b))) for b in range(bands)]
    row = cube.groupBy(*keys).agg(*(f(v).alias(f"{n}{b}") for b, v in enumerate(values) for n, f in (("lo", F.min), ("hi", F.max))))
    pairs = F.array(*(F.struct(F.lit(b).alias("band"), F.col(f"lo{b}").alias("min_value"), F.col(f"hi{b}").alias("max_value")) for b in range(bands)))
    return row.select(*keys, F.inline(pairs))


def bin_of(value, low, high, bins: int = BINS):
    """The bin of a value in [low, high]: equal widths, the last closed; NULL outside."""
    inside = (value >= low) & (value <= high)
    return F.when(inside, F.least(F.floor((value - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int"))


def histogram(band: DataFrame, low: float = 0.0, high: float = 1.0, bins: int = BINS) -> DataFrame:
    """(bin, n) with a row for each bin."""
    counts = band.select(bin_of(finite(F.col("value")), F.lit(low), F.lit(high), bins).alias("bin")).where("bin IS NOT NULL").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    every = band.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def percent_clip(hist: DataFrame, percent: float) -> DataFrame:
    """(low_bin, high_bin): the bins where the tails of percent / 2 end. A histogram has as many rows as bins."""
    up, down = Window.orderBy("bin"), Window.orderBy(F.desc("bin"))
    total = F.sum("n").over(Window.partitionBy())
    walked = hist.select("bin", (total * percent / 2).alias("target"), F.sum("n").over(up).alias("below"), F.sum("n").over(down).alias("above"))
    return walked.agg(F.min(F.when(F.col("below") >= F.col("target"), F.col("bin"))).alias("low_bin"), F.max(F.when(F.col("above") >= F.col("target"), F.col("bin"))).alias("high_bin"))


def density(points: DataFrame, columns: int, rows: int, limits: tuple[float, float, float, float]) -> DataFrame:
    """(col, row, n): points (px, py) in each cell of a plane with limits x0, x1, y0, y1."""
    x0, x1, y0, y1 = limits
    cells = points.select(bin_of(F.col("px"), F.lit(x0), F.lit(x1), columns).alias("col"), bin_of(F.col("py"), F.lit(y0), F.lit(y1), rows).alias("row"))
    return cells.where("col IS NOT NULL AND row IS NOT NULL").groupBy("col", "row").agg(F.count(F.lit(1)).alias("n"))


def scatter(x: DataFrame, y: DataFrame, keys: Sequence[str] = ("y", "x")) -> DataFrame:
    """(…keys, px, py): the values of two bands at the pixels that both have."""
    return x.select(*keys, finite(F.col("value")).alias("px")).join(y.select(*keys, finite(F.col("value")).alias("py")), list(keys)).where("px IS NOT NULL AND py IS NOT NULL")


def scatter_limits(points: DataFrame) -> DataFrame:
    """One row (x0, x1, y0, y1)."""
    return points.agg(F.min("px").alias("x0"), F.max("px").alias("x1"), F.min("py").alias("y0"), F.max("py").alias("y1"))


def clip_edges(clip: DataFrame, bins: int = BINS) -> DataFrame:
    """(low, high): the lower edge of the low bin and the upper edge of the high bin of a percent clip."""
    return clip.select((F.col("low_bin") / bins).alias("low"), ((F.col("high_bin") + 1) / bins).alias("high"))
