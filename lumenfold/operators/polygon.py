"""Polygons as pixels: the cells that a polygon's edges pass through, and those whose centre it holds.

The cells of an edge come from the edge: it is cut at the columns of the grid, and each part tells its rows. The inside
comes from the places where the edges cross the middle of a row. So the work is as large as the result, whatever the
image, and polygons are rows of a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_AT = {"ax": "p[0]", "ay": "p[1]", "bx": "q[0]", "by": "q[1]"}


def edges(polygons: DataFrame) -> DataFrame:
    """(roi_id, ax, ay, bx, by, right, bottom) of polygons (roi_id, points array<array<number>>), the closing edge included;
    ``right`` and ``bottom`` are the largest places of the polygon. Polygons of less than three points have none."""
    points = F.transform(F.filter("points", lambda p: (F.size(p) >= 2) & p[0].isNotNull() & p[1].isNotNull()), lambda p: F.array(p[0].cast("double"), p[1].cast("double")))
    held = polygons.select("roi_id", points.alias("points")).where(F.size("points") >= 3)
    largest = lambda i: F.array_max(F.transform("points", lambda p: p[i]))
    turned = F.concat(F.slice("points", F.lit(2), F.size("points")), F.slice("points", F.lit(1), F.lit(1)))
    each = held.select("roi_id", largest(0).alias("right"), largest(1).alias("bottom"), F.explode(F.arrays_zip(F.col("points").alias("p"), turned.alias("q"))).alias("e"))
    return each.select("roi_id", "right", "bottom", *(F.expr(f"e.{v}").alias(n) for n, v in _AT.items())).where("ax <> bx OR ay <> by")


def crossed(edges: DataFrame) -> DataFrame:
    """(roi_id, x, y): the cells that hold a part of an edge, more than a point of it.

    An edge along a line of the grid belongs to the cell on its right or below it. Cells on the right of the polygon's
    largest x or below its largest y are out.
    """
    upright = edges.where("ax = bx").selectExpr("*", "floor(ax) AS x", "least(ay, by) AS lo", "greatest(ay, by) AS hi")
    slanted = edges.where("ax <> bx").selectExpr("*", "explode(sequence(floor(least(ax, bx)), ceil(greatest(ax, bx)) - 1)) AS x")
    # products before quotients: with whole numbers a place on a line of the grid is exact
    at = lambda x: f"((ay * (bx - ax) + ({x} - ax) * (by - ay)) / (bx - ax))"
    first, last = at("greatest(x, least(ax, bx))"), at("least(x + 1, greatest(ax, bx))")
    slanted = slanted.selectExpr("*", f"least({first}, {last}) AS lo", f"greatest({first}, {last}) AS hi")
    parts = upright.unionByName(slanted)
    cells = parts.selectExpr("roi_id", "x", "right", "bottom", "explode(sequence(floor(lo), greatest(floor(lo), ceil(hi) - 1))) AS y")
    return cells.where("x < right AND y < bottom").selectExpr("roi_id", "int(x) AS x", "int(y) AS y").distinct()


def inside(edges: DataFrame) -> DataFrame:
    """(roi_id, x, y): the cells whose centre is inside, by rows; an edge of a row that a ray to the right hits counts."""
    rows = edges.where("ay <> by").selectExpr("*", "explode(sequence(floor(least(ay, by)), ceil(greatest(ay, by)))) AS y")
    hit = rows.where("(y + 0.5 < ay) <> (y + 0.5 < by)").selectExpr("roi_id", "y", "(bx - ax) * (y + 0.5 - ay) / (by - ay) + ax AS c")
    spans = hit.groupBy("roi_id", "y").agg(F.sort_array(F.collect_list("c")).alias("c"))  # of one polygon and row: at most an edge each
    pairs = spans.selectExpr("roi_id", "y", "explode(transform(sequence(0, size(c) div 2 - 1), i -> struct(ceil(c[2 * i] - 0.5) AS lo, ceil(c[2 * i + 1] - 0.5) - 1 AS hi))) AS s")
    return pairs.where("s.hi >= s.lo").selectExpr("roi_id", "explode(sequence(s.lo, s.hi)) AS x", "y").selectExpr("roi_id", "int(x) AS x", "int(y) AS y")


def polygon_cells(polygons: DataFrame, all_touched: bool = True) -> DataFrame:
    """(roi_id, x, y) of polygons (roi_id, points), each cell once: those with their centre inside and, with
    ``all_touched``, those that an edge passes through. Equal ids are one region."""
    found = edges(polygons)
    cells = inside(found)
    return (cells.union(crossed(found)) if all_touched else cells).distinct()
