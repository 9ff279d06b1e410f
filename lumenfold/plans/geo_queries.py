"""Queries of georeferencing, projections and polygons over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.operators import polygon, warp
from lumenfold.operators.projection import BODIES, Projection, utm
from lumenfold.plans.inputs import SQL, cube, image, table
from lumenfold.plans.more_queries import clipped

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, f"WITH {SQL}{sql}"
        return f

    return add


def _digest(df: DataFrame) -> DataFrame:
    """All bands of a pixel in one number, NULL for a hole."""
    total = F.aggregate(F.transform("spectrum", lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v)
    return df.select("y", "x", F.round(total, 6).alias("total"))


#: The same of the source in SQL, and its height.
_SOURCE = ", src AS (SELECT y, x, list_sum(list_transform(range(64), lambda b: s[b + 1] * (b + 1))) AS t FROM p), hh AS (SELECT (max(y) + 1)::DOUBLE AS h FROM p)"


def _height(rows: DataFrame) -> int:
    return (rows.agg(F.max("y")).first()[0] or 0) + 1


def _control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control points of suppliers, which follow one affine mapping."""
    k = F.col("s_suppkey")
    at = table(spark, sf_dir, "supplier").select((k * 7 % 25).cast("double").alias("px"), (k * 11 % 19).cast("double").alias("py"))
    return at.select("px", "py", (1000 + 3 * F.col("px") + 0.5 * F.col("py")).alias("gx"), (2000 - 0.25 * F.col("px") - 2.5 * F.col("py")).alias("gy"))


@query(
    _SOURCE
    + """, c AS (SELECT 1000 + 3 * a.i * 25 + 0.5 * b.j * h AS u, 2000 - 0.25 * a.i * 25 - 2.5 * b.j * h AS v, h FROM range(2) a(i), range(2) b(j), hh),
    e AS (SELECT min(u) AS u0, max(u) AS u1, min(v) AS v0, max(v) AS v1, sqrt((75 + 0.5 * any_value(h)) ** 2 + (6.25 + 2.5 * any_value(h)) ** 2) / sqrt(625 + any_value(h) ** 2) AS s FROM c),
    g AS (SELECT yy.i::INT AS y, xx.i::INT AS x, u0 + s * (xx.i + 0.5) - 1000 AS u, v1 - s * (yy.i + 0.5) - 2000 AS v FROM e, range((SELECT floor((u1 - u0) / s + 0.5)::BIGINT FROM e)) xx(i), range((SELECT floor((v1 - v0) / s + 0.5)::BIGINT FROM e)) yy(i)),
    o AS (SELECT y, x, (u * -2.5 - v * 0.5) / (3 * -2.5 + 0.25 * 0.5) AS sx, (v * 3 + u * 0.25) / (3 * -2.5 + 0.25 * 0.5) AS sy FROM g)
    SELECT o.y, o.x, round(t, 6) AS total FROM o LEFT JOIN src ON src.x = floor(sx) AND src.y = floor(sy)"""
)
def gcp_warp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cube warped by control points to the nearest pixel, on the canvas that holds it, with holes as NULL."""
    rows = cube(spark, sf_dir)
    found, _, _ = warp.georeference(rows, _control(spark, sf_dir), 25, _height(rows))
    return _digest(found)


_QUADRATIC = ("2.0 + 0.5 * gx + 0.1 * gy + 0.002 * gx * gy", "1.0 - 0.05 * gx + 0.4 * gy + 0.001 * gx * gx")


@query(
    _SOURCE
    + f""", g AS (SELECT yy.i::INT AS y, xx.i::INT AS x, -3 + 0.9 * (xx.i + 0.5)::DOUBLE AS gx, 60 - 1.1 * (yy.i + 0.5)::DOUBLE AS gy FROM range(50) xx(i), range(60) yy(i)),
    o AS (SELECT y, x, {_QUADRATIC[0]} AS sx, {_QUADRATIC[1]} AS sy FROM g),
    n AS (SELECT o.y, o.x, sum(w * t) / sum(w) AS total FROM (SELECT o.*, floor(sx - 0.5) + i AS ix, floor(sy - 0.5) + j AS iy, (1 - abs(sx - 0.5 - floor(sx - 0.5) - i)) * (1 - abs(sy - 0.5 - floor(sy - 0.5) - j)) AS w FROM o, range(2) a(i), range(2) b(j)) o JOIN src ON src.x = ix AND src.y = iy GROUP BY o.y, o.x)
    SELECT o.y, o.x, CASE WHEN src.t IS NOT NULL THEN round(n.total, 6) END AS total FROM o LEFT JOIN src ON src.x = floor(sx) AND src.y = floor(sy) LEFT JOIN n ON n.y = o.y AND n.x = o.x"""
)
def gcp_warp_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cube on a given grid through a fitted polynomial of order two, all bands between the pixels."""
    places = image(spark, sf_dir, "event_id").select((F.col("x") / 2.0).alias("gx"), (F.col("y") / 2.0).alias("gy"))
    points = places.selectExpr("gx", "gy", f"{_QUADRATIC[0]} AS px", f"{_QUADRATIC[1]} AS py")
    back = warp.fit_polynomial(points, 2, ("gx", "gy"), ("px", "py"))
    return _digest(warp.warp(cube(spark, sf_dir), back, warp.Grid((-3.0, 0.9, 0.0, 60.0, 0.0, -1.1), 50, 60), "bilinear"))


@query(
    _SOURCE
    + """, k AS (SELECT h, cos(radians(30::DOUBLE)) AS c, sin(radians(30::DOUBLE)) AS s FROM hh), d AS (SELECT *, ceil(round(0.8 * (25 * c + h * s), 9)) AS ow, ceil(round(0.8 * (25 * s + h * c), 9)) AS oh FROM k),
    o AS (SELECT yy.i::INT AS y, xx.i::INT AS x, 12.5 + (c * (xx.i + 0.5 - ow / 2) - s * (yy.i + 0.5 - oh / 2)) / 0.8 AS sx, h / 2 + (s * (xx.i + 0.5 - ow / 2) + c * (yy.i + 0.5 - oh / 2)) / 0.8 AS sy FROM d, range((SELECT ow::BIGINT FROM d)) xx(i), range((SELECT oh::BIGINT FROM d)) yy(i))
    SELECT o.y, o.x, round(t, 6) AS total FROM o LEFT JOIN src ON src.x = floor(sx) AND src.y = floor(sy)"""
)
def cube_turned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All bands turned by thirty degrees and made smaller; the whole canvas, with holes as NULL."""
    rows = cube(spark, sf_dir)
    return _digest(warp.turned(rows, 30.0, 0.8, 25, _height(rows)))


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(k.cast("long").alias("k"), (k * 7 % 25 + k / 100).cast("double").alias("px"), (k * 11 % 19 + k / 77).cast("double").alias("py"))


@query(", n AS (SELECT n_nationkey AS k, n_nationkey * 7 % 25 + n_nationkey / 100.0::DOUBLE AS px, n_nationkey * 11 % 19 + n_nationkey / 77.0::DOUBLE AS py FROM nation) SELECT event_id, round(500000 + 30 * px + 40 * sin(py / 9), 4) AS gx_fit, round(4000000 - 30 * py + 25 * cos(px / 7), 4) AS gy_fit, 0.0::DOUBLE AS residual_x, 0.0::DOUBLE AS residual_y FROM i JOIN n ON n.k = event_id % 25")
def gcp_spline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A thin plate spline through the places of the nations, at the nation of each event: exact at its points."""
    points = _nations(spark, sf_dir).select("*", (500000 + 30 * F.col("px") + 40 * F.sin(F.col("py") / 9)).alias("gx"), (4000000 - 30 * F.col("py") + 25 * F.cos(F.col("px") / 7)).alias("gy"))
    asked = image(spark, sf_dir, "event_id").select("event_id", (F.col("event_id") % 25).alias("k")).join(points, "k")
    found = warp.residuals(asked, warp.fit_spline(points), [0, 30.0, 0, 0, 0, -30.0])
    near = lambda c, d: F.abs(F.round(c, d)).alias(c)
    return found.select("event_id", near("gx_fit", 4), near("gy_fit", 4), near("residual_x", 5), near("residual_y", 5))


@query(", e AS (SELECT *, x / 4.0::DOUBLE AS px, y / 4.0::DOUBLE AS py FROM i) SELECT event_id, round(1000 + 3 * px + 0.5 * py, 6) AS gx_fit, round(2000 - 0.25 * px - 2.5 * py, 6) AS gy_fit FROM e")
def gcp_spline_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spline of points that follow an affine mapping, away from its points: nothing bends."""
    nations = _nations(spark, sf_dir)
    spline = warp.fit_spline(nations.select("px", "py", (1000 + 3 * F.col("px") + 0.5 * F.col("py")).alias("gx"), (2000 - 0.25 * F.col("px") - 2.5 * F.col("py")).alias("gy")))
    u, v = spline(F.col("x") / 4.0, F.col("y") / 4.0)
    return image(spark, sf_dir, "event_id").select("event_id", F.round(u, 6).alias("gx_fit"), F.round(v, 6).alias("gy_fit"))


def _ellipsoid(name: str) -> tuple[float, float]:
    a, inverse = BODIES[name]
    return a, 1 / inverse if inverse else 0.0


_KINDS = {
    "longlat": Projection("longlat", *_ellipsoid("wgs84")),
    "eqc": Projection("eqc", *_ellipsoid("mars"), lat0=-5.0, lon0=100.0, lat_ts=20.0),
    "merc": Projection("merc", *_ellipsoid("grs80"), lon0=-60.0),
    "stere": Projection("stere", *_ellipsoid("intl"), lat0=35.0, lon0=20.0, k0=0.99, x0=1000.0),
    "polar": Projection("stere", *_ellipsoid("mars"), lat0=-90.0, lon0=0.0),
    "tmerc": utm(33),
}
_E2 = {n: p.flattening * (2 - p.flattening) for n, p in _KINDS.items()}


@query(", k AS (SELECT unnest(['longlat', 'eqc', 'merc', 'stere', 'polar', 'tmerc']) AS kind, unnest([0, 100, -60, 20, 0, 15]) AS lon0) SELECT event_id, kind, round(lon0 + (event_id % 1001 - 500) / 50.0::DOUBLE + 0.00123, 8) AS lon, round((event_id % 1201 - 600) / 10.0::DOUBLE + 0.00321, 8) AS lat FROM i, k")
def geo_latlon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of each projection led back to longitude and latitude."""
    out = None
    for name, p in _KINDS.items():
        i = F.col("event_id")
        lon, lat = p.lon0 + (i % 1001 - 500) / 50 + 0.00123, (i % 1201 - 600) / 10 + 0.00321
        x, y = p.forward(lon, lat)
        at = image(spark, sf_dir, "event_id").select("event_id", x.alias("x"), y.alias("y"))
        lon, lat = p.inverse(F.col("x"), F.col("y"))
        found = at.select("event_id", F.lit(name).alias("kind"), F.round(lon, 8).alias("lon"), F.round(lat, 8).alias("lat"))
        out = found if out is None else out.union(found)
    return out


def _arc(name: str, lat: str) -> str:
    """The meridian from the equator to ``lat`` (radians), by Simpson's rule."""
    e2 = repr(_E2[name])
    f = f"power(1 - {e2} * power(sin({lat} * q / 400), 2), -1.5)"
    return f"({_KINDS[name].a} * (1 - {e2}) * {lat} / 1200 * list_sum(list_transform(range(401), lambda q: (CASE WHEN q = 0 OR q = 400 THEN 1 WHEN q % 2 = 1 THEN 4 ELSE 2 END) * {f})))"


def _tangent(name: str, lat: str) -> str:
    """The tangent of half the conformal latitude and 45 degrees."""
    e = repr(_E2[name] ** 0.5)
    return f"(tan(pi() / 4 + ({lat}) / 2) * power((1 - {e} * sin({lat})) / (1 + {e} * sin({lat})), {e} / 2))"


def _conformal(name: str, lat: str) -> str:
    return f"(2 * atan({_tangent(name, lat)}) - pi() / 2)"


def _nu(name: str, lat: str) -> str:
    return f"({_KINDS[name].a} / sqrt(1 - {_E2[name]!r} * power(sin({lat}), 2)))"


_EP = repr(_E2["tmerc"] / (1 - _E2["tmerc"]))
_C1, _CHI = _conformal("stere", "radians(35::DOUBLE)"), _conformal("stere", "f")


@query(
    f""", a AS (SELECT s_suppkey, radians((s_suppkey * 37 % 1600 - 800) / 10.0::DOUBLE) AS f, radians((s_suppkey * 53 % 100 - 50) / 100.0::DOUBLE) AS d FROM supplier),
    t AS (SELECT *, tan(f) ** 2 AS tt, {_EP} * cos(f) ** 2 AS cc, d * cos(f) AS aa, {_nu("tmerc", "f")} AS nu FROM a),
    rr AS (SELECT s_suppkey, 'tmerc' AS kind, 500000 + 0.9996 * nu * (aa + (1 - tt + cc) * aa ** 3 / 6 + (5 - 18 * tt + tt ** 2 + 72 * cc - 58 * {_EP}) * aa ** 5 / 120) AS x,
        0.9996 * ({_arc("tmerc", "f")} + nu * tan(f) * (aa ** 2 / 2 + (5 - tt + 9 * cc + 4 * cc ** 2) * aa ** 4 / 24 + (61 - 58 * tt + tt ** 2 + 600 * cc - 330 * {_EP}) * aa ** 6 / 720)) AS y FROM t
      UNION ALL SELECT s_suppkey, 'merc', 6378137.0 * d * 50, 6378137.0 * ln({_tangent("merc", "f")}) FROM a
      UNION ALL SELECT s_suppkey, 'eqc', {_nu("eqc", "radians(20::DOUBLE)")} * cos(radians(20::DOUBLE)) * d * 50, {_arc("eqc", "f")} - {_arc("eqc", "radians(-5::DOUBLE)")} FROM a
      UNION ALL SELECT s_suppkey, 'stere', 1000 + k * cos(chi) * sin(d * 50), k * (cos(c1) * sin(chi) - sin(c1) * cos(chi) * cos(d * 50)) FROM (SELECT *, 2 * 0.99 * {_nu("stere", "radians(35::DOUBLE)")} * cos(radians(35::DOUBLE)) / cos(c1) / (1 + sin(c1) * sin(chi) + cos(c1) * cos(chi) * cos(d * 50)) AS k FROM (SELECT *, {_C1} AS c1, {_CHI} AS chi FROM a)))
    SELECT s_suppkey, kind, round(x, 3) AS x, round(y, 3) AS y FROM rr"""
)
def geo_projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of suppliers in four projections."""
    k, out = F.col("s_suppkey"), None
    for name, wide in (("tmerc", 1), ("merc", 50), ("eqc", 50), ("stere", 50)):
        p = _KINDS[name]
        x, y = p.forward(p.lon0 + wide * ((k * 53 % 100 - 50) / 100), (k * 37 % 1600 - 800) / 10)
        found = table(spark, sf_dir, "supplier").select("s_suppkey", F.lit(name).alias("kind"), F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))
        out = found if out is None else out.union(found)
    return out


_SHAPE = [("k % 17", "k % 5"), ("k % 17 + 3 + k % 7", "k % 5 + k % 3"), ("k % 17 + 2 + k % 4", "k % 5 + 4 + k % 6"), ("k % 17 - k % 3", "k % 5 + 2 + k % 2")]


@query(
    ", s AS (SELECT s_suppkey::BIGINT AS roi_id, s_suppkey AS k FROM supplier), e AS ("
    + " UNION ALL ".join(f"SELECT roi_id, ({a[0]})::DOUBLE AS ax, ({a[1]})::DOUBLE AS ay, ({b[0]})::DOUBLE AS bx, ({b[1]})::DOUBLE AS bby FROM s" for a, b in zip(_SHAPE, [*_SHAPE[1:], _SHAPE[0]], strict=True))
    + """), m AS (SELECT roi_id, max(ax) AS r, max(ay) AS b FROM e GROUP BY roi_id), g AS (SELECT roi_id AS own, xx.i::INT AS x, yy.i::INT AS y FROM m, range(-3, 30) xx(i), range(-1, 20) yy(i) WHERE xx.i < r AND yy.i < b),
    hits AS (SELECT own, x, y, sum((((y + 0.5 < ay) <> (y + 0.5 < bby)) AND x + 0.5 < (bx - ax) * (y + 0.5 - ay) / (bby - ay) + ax)::INT) AS n FROM g JOIN e ON e.roi_id = own GROUP BY own, x, y),"""
    + f" touched AS ({clipped('g', 'e')} AND e.roi_id = c.own) SELECT own AS roi_id, x, y FROM hits WHERE n % 2 = 1 UNION SELECT own, x, y FROM touched"
)
def roi_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells that polygons, one of each supplier, touch."""
    points = ", ".join(f"array({x}, {y})" for x, y in _SHAPE)
    rows = table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "s_suppkey AS k").selectExpr("CAST(s_suppkey AS BIGINT) AS roi_id", f"CAST(array({points}) AS ARRAY<ARRAY<DOUBLE>>) AS points")
    return polygon.polygon_cells(rows)
