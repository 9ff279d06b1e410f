"""Polygons as cells against clipping of every edge by every cell, in fractions."""

import random
from fractions import Fraction

from lumenfold.operators import roi
from lumenfold.operators.polygon import polygon_cells


def plain(points, all_touched=True):
    points = [tuple(map(Fraction, p)) for p in points]
    right, bottom = max(x for x, _ in points), max(y for _, y in points)
    out = set()
    edges = [(a, b) for a, b in zip(points, [*points[1:], points[0]], strict=True) if a != b]
    for i in range(-12, 13):
        for j in range(-12, 13):
            x, y = i + Fraction(1, 2), j + Fraction(1, 2)
            hits = sum((y < a[1]) != (y < b[1]) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in edges)
            if hits % 2:
                out.add((i, j))
            if not all_touched or i >= right or j >= bottom:
                continue
            for a, b in edges:
                lo, hi = Fraction(0), Fraction(1)
                for p, q, c in ((a[0], b[0], i), (a[1], b[1], j)):
                    if p == q:
                        hi = hi if c <= p < c + 1 else Fraction(-1)
                    else:
                        s, t = sorted(((c - p) / (q - p), (c + 1 - p) / (q - p)))
                        lo, hi = max(lo, s), min(hi, t)
                if hi > lo:
                    out.add((i, j))
    return out


def test_equals_clipping(spark):
    rng = random.Random(8)
    whole = [[[rng.randint(-9, 9), rng.randint(-9, 9)] for _ in range(rng.randint(3, 7))] for _ in range(40)]
    parts = [[[rng.randint(-72, 72) / 8, rng.randint(-72, 72) / 8] for _ in range(rng.randint(3, 6))] for _ in range(30)]
    shapes = whole + parts + [[[0, 0], [4, 0], [4, 3], [0, 3]], [[2, 2], [2, 2], [5, 5]], [[0, 0], [3, 3], [0, 0]], [[-3, -3], [-3, 4], [1, 1]]]
    df = spark.createDataFrame([(i, [[float(v) for v in p] for p in s]) for i, s in enumerate(shapes)], "roi_id long, points array<array<double>>")
    for touched in (True, False):
        got = {}
        for r in polygon_cells(df, touched).collect():
            assert (r["x"], r["y"]) not in got.setdefault(r["roi_id"], set())
            got[r["roi_id"]].add((r["x"], r["y"]))
        for i, s in enumerate(shapes):
            assert got.get(i, set()) == plain(s, touched), s


def test_no_polygon(spark):
    rows = [(1, None), (2, []), (3, [[1.0, 1.0], [4.0, 4.0]]), (4, [[1.0, None], [2.0, 2.0], None, [3.0, 1.0]]), (5, [[1.0, 1.0]] * 4)]
    df = spark.createDataFrame(rows, "roi_id long, points array<array<double>>")
    assert polygon_cells(df).collect() == []


def test_large_polygon_needs_no_grid(spark):
    """A triangle of half a million cells, of which the edges are told by themselves."""
    df = spark.createDataFrame([(1, [[0.0, 0.0], [1000.0, 0.0], [0.0, 1000.0]])], "roi_id long, points array<array<double>>")
    assert polygon_cells(df).count() == 1000 * 1001 // 2


def test_on_a_grid(spark):
    grid = spark.range(100).selectExpr("int(id % 10) AS x", "int(id div 10) AS y")
    points = [(2.2, 2.2), (2.3, 2.2), (2.3, 8.0)]
    assert {(r["x"], r["y"]) for r in roi.polygon_pixels(grid, 1, points).collect()} == {(2, y) for y in range(2, 8)}
