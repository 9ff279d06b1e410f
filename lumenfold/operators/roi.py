"""Regions of interest: selections, their pixels, and spectra over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.registry import finite
from lumenfold.operators.polygon import polygon_cells


def rectangle(x: Column, y: Column, x1: int, y1: int, x2: int, y2: int) -> Column:
    """Inside two corners; the right and bottom edges are out."""
    (x1, x2), (y1, y2) = sorted((x1, x2)), sorted((y1, y2))
    return (x >= x1) & (x < x2) & (y >= y1) & (y < y2)


def inside_polygon(x: Column, y: Column, points: Sequence[tuple[float, float]]) -> Column:
    """By the number of edges that a ray to the right crosses."""
    if len(points) < 3:
        raise ValueError("a polygon has at least three points")
    crossings = F.lit(0)
    for (xa, ya), (xb, yb) in zip(points, [*points[1:], points[0]], strict=True):
        if ya != yb:
            hit = ((y < ya) != (y < yb)) & (x < (xb - xa) * (y - ya) / (yb - ya) + xa)
            crossings = crossings + hit.cast("int")
    return crossings % 2 == 1


def pixels_of(*selections: DataFrame) -> DataFrame:
    """The union of selections (roi_id, x, y), each pixel once."""
    out = selections[0].select("roi_id", "x", "y")
    for s in selections[1:]:
        out = out.union(s.select("roi_id", "x", "y"))
    return out.distinct()


def polygon_pixels(grid: DataFrame, roi_id: int, points: Sequence[tuple[float, float]], all_touched: bool = True) -> DataFrame:
    """(roi_id, x, y) of the grid's pixels in a polygon."""
    one = grid.sparkSession.createDataFrame([(roi_id, [[float(v) for v in p] for p in points])], "roi_id long, points array<array<double>>")
    return polygon_cells(one, all_touched).join(grid.select("x", "y").distinct(), ["x", "y"], "left_semi").select("roi_id", "x", "y")


def roi_spectrum(cube: DataFrame, roi: DataFrame, how: str = "mean") -> DataFrame:
    """(roi_id, band, value): the mean or median of finite values of each band over the pixels of each region."""
    if how not in ("mean", "median"):
        raise ValueError("mean or median")
    rows = cube.join(roi, ["x", "y"]).select("roi_id", F.posexplode("spectrum").alias("band", "v")).withColumn("v", finite(F.col("v")))
    return rows.groupBy("roi_id", "band").agg(F.avg("v").alias("value")) if how == "mean" else exact_medians(rows, ["roi_id", "band"])


def exact_medians(rows: DataFrame, keys: Sequence[str], accuracy: int = 10_000) -> DataFrame:
    """(…keys, value): the median of ``v`` in each group, NULL where it has none, however large a group is and however its
    values lie.

    Spark's quantile summaries, whose rank is wrong by a share of 1 / accuracy at most, give two values that hold the
    middle between them. What lies below is counted, what lies between (some ten thousandths of a group) is counted by
    value, and only these counts meet in a task. Both aggregates are partial before they are shuffled.
    """
    keys = list(keys)
    near = [0.5 - 3 / accuracy, 0.5 + 3 / accuracy]
    span = rows.groupBy(*keys).agg(F.percentile_approx("v", near, accuracy).alias("_q"), F.count("v").alias("_n"))
    upto = rows.where("v IS NOT NULL").join(span, keys).where(F.col("v") <= F.col("_q")[1])
    counted = upto.groupBy(*keys, "_n", F.when(F.col("v") >= F.col("_q")[0], F.col("v")).alias("v")).agg(F.count(F.lit(1)).alias("_c"))
    return span.select(*keys).join(_middles(counted, keys), keys, "left")


def _middles(counted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(…keys, value): the median of groups of ``_n`` values, of which ``v`` is there ``_c`` times; NULL stands for those below."""
    order = Window.partitionBy(*keys).orderBy(F.col("v").asc_nulls_first())
    ranked = counted.withColumn("_at", F.sum("_c").over(order) - F.col("_c"))
    holds = lambda place: F.max(F.when((F.col("_at") <= place) & (F.col("_at") + F.col("_c") > place), F.col("v")))
    low, high = F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)  # places of the middle values, from 0
    return ranked.groupBy(*keys).agg(((holds(low) + holds(high)) / 2).alias("value"))


def counted_medians(rows: DataFrame, keys: Sequence[str], parts: int = 64, accuracy: int = 1000) -> DataFrame:
    """(…keys, value): the same where a value ``v`` is there ``_c`` times.

    Quantiles of the rows, whatever their counts, cut a group into parts. The parts that hold the middle are found by
    adding up counts, and only their values are ranked.
    """
    keys = list(keys)
    edges = [i / parts for i in range(parts + 1)]
    span = rows.groupBy(*keys).agg(F.percentile_approx("v", edges, accuracy).alias("_q"), F.sum(F.when(F.col("v").isNotNull(), F.col("_c"))).alias("_n"))
    placed = rows.where("v IS NOT NULL").join(span, keys).withColumn("_part", F.size(F.filter("_q", lambda q: q < F.col("v")))).drop("_q")
    order = Window.partitionBy(*keys).orderBy("_part")
    walked = placed.groupBy(*keys, "_n", "_part").agg(F.sum("_c").alias("_w")).withColumn("_upto", F.sum("_w").over(order))
    holding = walked.where((F.col("_upto") > F.floor((F.col("_n") - 1) / 2)) & (F.col("_upto") - F.col("_w") <= F.floor(F.col("_n") / 2)))
    ends = holding.groupBy(*keys).agg(F.min("_part").alias("_low"), F.max("_part").alias("_high"))
    upto = placed.join(ends, keys).where("_part <= _high")
    counted = upto.groupBy(*keys, "_n", F.when(F.col("_part") >= F.col("_low"), F.col("v")).alias("v")).agg(F.sum("_c").alias("_c"))
    return span.select(*keys).join(_middles(counted, keys), keys, "left")


def points_spectrum(cube: DataFrame, points: DataFrame, how: str = "mean") -> DataFrame:
    """(roi_id, band, value): the mean or median of each band over listed points (roi_id, x, y) that the cube has, a
    point listed twice counting twice. Unlike in a region, a missing value of one point makes that of the band missing.

    Points are counted before they meet the cube, so that one which is listed often is one row with its count.
    """
    if how not in ("mean", "median"):
        raise ValueError("mean or median")
    listed = points.groupBy("roi_id", "x", "y").agg(F.count(F.lit(1)).alias("_c"))
    rows = cube.join(listed, ["x", "y"]).select("roi_id", "_c", F.posexplode("spectrum").alias("band", "v")).withColumn("v", finite(F.col("v")))
    whole = rows.groupBy("roi_id", "band").agg((F.sum(F.col("v") * F.col("_c")) / F.sum("_c")).alias("value"), F.bool_and(F.col("v").isNotNull()).alias("whole"))
    if how == "median":
        whole = counted_medians(rows, ["roi_id", "band"]).join(whole.drop("value"), ["roi_id", "band"])
    return whole.select("roi_id", "band", F.when(F.col("whole"), F.col("value")).alias("value"))


def bounding_boxes(roi: DataFrame) -> DataFrame:
    lo, hi = [F.min(c).alias(f"{c}_min") for c in "xy"], [(F.max(c) - F.min(c) + 1).cast("int").alias(n) for c, n in zip("xy", ("width", "height"), strict=True)]
    return roi.groupBy("roi_id").agg(*lo, *hi)


def runs(roi: DataFrame) -> DataFrame:
    """(roi_id, y, x_min, x_max): the rows of a region as runs of neighbouring pixels."""
    order = Window.partitionBy("roi_id", "y").orderBy("x")
    numbered = roi.withColumn("island", F.col("x") - F.row_number().over(order))
    return numbered.groupBy("roi_id", "y", "island").agg(F.min("x").alias("x_min"), F.max("x").alias("x_max")).drop("island")


def rectangles(roi: DataFrame) -> DataFrame:
    """(roi_id, x_min, x_max, y_min, y_max): equal runs in neighbouring rows as one rectangle."""
    order = Window.partitionBy("roi_id", "x_min", "x_max").orderBy("y")
    numbered = runs(roi).withColumn("island", F.col("y") - F.row_number().over(order))
    return numbered.groupBy("roi_id", "x_min", "x_max", "island").agg(F.min("y").alias("y_min"), F.max("y").alias("y_max")).drop("island")


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("x", "y").intersect(b.select("x", "y"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("x", "y").distinct().exceptAll(b.select("x", "y").distinct())


def pixel_spectra(cube: DataFrame, roi: DataFrame) -> DataFrame:
    """All spectra of a region's pixels, by x and y."""
    return cube.join(roi.select("x", "y").distinct(), ["x", "y"], "left_semi").orderBy("x", "y")


def single_pixel(roi_id: int, grid: DataFrame, x: int, y: int) -> DataFrame:
    """(roi_id, x, y) of one pixel, if the grid has it."""
    return predicate_pixels(grid, roi_id, (F.col("x") == x) & (F.col("y") == y))


def multi_pixel(grid: DataFrame, points: DataFrame) -> DataFrame:
    """(roi_id, x, y) of listed points (roi_id, x, y) that the grid has, each once."""
    return points.select("roi_id", "x", "y").distinct().join(grid.select("x", "y").distinct(), ["x", "y"]).select("roi_id", "x", "y")


def predicate_pixels(grid: DataFrame, roi_id: int, condition: Column) -> DataFrame:
    """(roi_id, x, y) of the pixels for which a condition over the grid's columns is true."""
    return grid.where(condition).select(F.lit(roi_id).cast("long").alias("roi_id"), "x", "y").distinct()


SELECTION = "type string, pixel array<int>, pixels array<array<int>>, point1 array<int>, point2 array<int>, points array<array<int>>, predicate string"


def selection_json(type_: str, **places: Column) -> Column:
    """A selection as JSON: ``pixel``, ``pixels``, ``point1`` and ``point2``, ``points`` or ``predicate`` beside its type."""
    return F.to_json(F.struct(F.lit(type_).alias("type"), *(c.alias(name) for name, c in places.items())))


def selection_pixels(selections: DataFrame) -> DataFrame:
    """(roi_id, x, y) of selections (roi_id, json), each pixel once; polygons take all cells that they touch.

    NULL or unreadable text and predicates, which need an image (``predicate_pixels``), give no pixels. A rectangle is
    spread by lines, then by columns, so that a large one isn't one array.
    """
    s = selections.select("roi_id", F.from_json("json", SELECTION).alias("s")).select("roi_id", "s.*")
    listed = F.when(F.col("type") == "SINGLE_PIXEL", F.array("pixel")).when(F.col("type") == "MULTI_PIXEL", F.col("pixels"))
    single = s.select("roi_id", F.explode(listed).alias("p")).select("roi_id", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))
    at = lambda i: F.array(F.col("point1")[i], F.col("point2")[i])
    box = s.where("type = 'RECTANGLE'").select("roi_id", *(f(at(i)).alias(n + c) for i, c in enumerate("xy") for f, n in ((F.array_min, "lo"), (F.array_max, "hi"))))
    lines = box.where("hix > lox AND hiy > loy").select("*", F.explode(F.sequence("loy", F.col("hiy") - 1)).alias("y"))
    cells = lines.select("roi_id", F.explode(F.sequence("lox", F.col("hix") - 1)).alias("x"), "y")
    return pixels_of(single, cells, polygon_cells(s.where("type = 'POLYGON'").select("roi_id", "points")))


def fewest_rectangles(roi: DataFrame) -> DataFrame:
    """Rectangles by rows or by columns, whichever are fewer for a region; rows on ties."""
    turned = roi.select("roi_id", F.col("y").alias("x"), F.col("x").alias("y"))
    both = rectangles(roi).withColumn("axis", F.lit(0)).unionByName(
        rectangles(turned).select("roi_id", F.col("y_min").alias("x_min"), F.col("y_max").alias("x_max"), F.col("x_min").alias("y_min"), F.col("x_max").alias("y_max"), F.lit(1).alias("axis"))
    )
    n = both.groupBy("roi_id", "axis").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy("roi_id").agg(F.min(F.struct("n", "axis")).alias("best")).select("roi_id", F.col("best.axis").alias("axis"))
    return both.join(best, ["roi_id", "axis"]).drop("axis")
