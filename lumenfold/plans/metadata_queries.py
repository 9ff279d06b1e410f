"""Queries of result types, selections as text, metadata, components and ENVI files over the driver's tables, each with its SQL."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions.dtypes import TYPES, result_dtypes
from lumenfold.functions.registry import BandFunction, Registry
from lumenfold.operators import matching, pca, raster, roi
from lumenfold.operators.bandmath import Image, evaluate
from lumenfold.plans.inputs import GOOD, SQL, WAVELENGTHS, cube, references, table
from lumenfold.plans.more_queries import clipped
from lumenfold.plans.spectral_queries import _DOTS
from lumenfold.session import scratch
from lumenfold.sources import envi, spectra_text

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, f"WITH {SQL} {sql}"
        return f

    return add


r6 = lambda c: F.round(F.col(c), 6).alias(c)
_total = lambda: F.aggregate("spectrum", F.lit(0.0), lambda s, v: s + v)

_KINDS = ", k AS (SELECT unnest(['u', 'u', 'u', 'u', 'i', 'i', 'i', 'f', 'f', 'c', 'c']) AS kind, unnest([8, 16, 32, 64, 16, 32, 64, 32, 64, 64, 128]) AS bits, unnest(range(11)) AS n)"
_NAME = "CASE kind WHEN 'u' THEN 'uint' WHEN 'i' THEN 'int' WHEN 'f' THEN 'float' ELSE 'complex' END || bits"


@query(
    _KINDS
    + f""", o AS (SELECT event_id, a.kind AS ka, a.bits AS ba, b.kind AS kb, b.bits AS bb FROM events JOIN k a ON a.n = event_id % 11 LEFT JOIN k b ON b.n = event_id // 11 % 12),
    whole AS (SELECT *, CASE WHEN ka = kb THEN ka WHEN 'u' IN (ka, kb) AND 'i' IN (ka, kb) THEN 'i' WHEN 'c' IN (ka, kb) THEN 'c' ELSE 'f' END AS kind,
      greatest(CASE WHEN ka = 'c' THEN ba // 2 WHEN ka = 'f' THEN ba WHEN ba > 16 THEN 64 ELSE 32 END, CASE WHEN kb = 'c' THEN bb // 2 WHEN kb = 'f' THEN bb WHEN bb > 16 THEN 64 ELSE 32 END) AS wide FROM o),
    sized AS (SELECT event_id, CASE WHEN kb IS NULL THEN ka WHEN ka <> kb AND kind = 'i' AND (CASE WHEN ka = 'u' THEN ba ELSE bb END) = 64 THEN 'f' ELSE kind END AS kind,
      CASE WHEN kb IS NULL THEN ba WHEN ka = kb THEN greatest(ba, bb) WHEN kind = 'i' THEN greatest(CASE WHEN ka = 'u' THEN least(64, 2 * ba) ELSE ba END, CASE WHEN kb = 'u' THEN least(64, 2 * bb) ELSE bb END)
      WHEN kind = 'c' THEN 2 * wide ELSE wide END AS bits FROM whole)
    SELECT event_id, {_NAME} AS dtype FROM sized"""
)
def result_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type of an arithmetic result for all pairs of types, some with the second unknown."""
    names, i = F.array(*map(F.lit, TYPES)), F.col("event_id")
    at = lambda n: F.get(names, n.cast("int"))
    return table(spark, sf_dir, "events").select("event_id", result_dtypes(at(i % 11), at(F.floor(i / 11) % 12)).alias("dtype"))


@query(
    """, s AS (SELECT event_id AS roi_id, event_id % 5 AS k, (event_id % 17)::INT AS x, (event_id % 23)::INT AS y FROM events),
    cells AS (SELECT a.i::INT AS i, b.j::INT AS j FROM range(6) a(i), range(5) b(j)), e AS (SELECT unnest([0, 6, 2]) AS ax, unnest([0, 1, 5]) AS ay, unnest([6, 2, 0]) AS bx, unnest([1, 5, 0]) AS byy),
    tri AS (SELECT i, j FROM cells, e GROUP BY i, j HAVING sum((((j + 0.5 < ay) <> (j + 0.5 < byy)) AND i + 0.5 < (bx - ax) * (j + 0.5 - ay) / (byy - ay)::DOUBLE + ax)::INT) % 2 = 1
      UNION SELECT x, y FROM ("""
    + clipped("(SELECT i AS x, j AS y FROM cells)", "(SELECT ax::DOUBLE AS ax, ay::DOUBLE AS ay, bx::DOUBLE AS bx, byy::DOUBLE AS bby FROM e)")
    + """))
    SELECT roi_id, x, y FROM s WHERE k = 0 UNION ALL SELECT roi_id, x + d.i::INT, y FROM s, range(2) d(i) WHERE k = 1 UNION ALL SELECT roi_id, x + i, y + j FROM s, cells WHERE k = 2 AND i < 5 AND j < 3 UNION ALL SELECT roi_id, x + i, y + j FROM s, tri WHERE k = 3"""
)
def selections_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selections of all kinds, written as JSON and read as pixels."""
    i = F.col("event_id")
    x, y = (i % 17).cast("int"), (i % 23).cast("int")
    p = lambda dx, dy: F.array(x + dx, y + dy)
    kinds = [
        roi.selection_json("SINGLE_PIXEL", pixel=p(0, 0)),
        roi.selection_json("MULTI_PIXEL", pixels=F.array(p(0, 0), p(1, 0), p(0, 0))),
        roi.selection_json("RECTANGLE", point1=p(5, 0), point2=p(0, 3)),
        roi.selection_json("POLYGON", points=F.array(p(0, 0), p(6, 1), p(2, 5))),
        roi.selection_json("PREDICATE", predicate=F.lit("b1 > 0")),
    ]
    written = table(spark, sf_dir, "events").select(i.alias("roi_id"), F.get(F.array(*kinds), (i % 5).cast("int")).alias("json"))
    return roi.selection_pixels(written)


@query(_DOTS + ", o AS (SELECT y, x, list(score ORDER BY ref_id) AS q FROM a GROUP BY y, x) SELECT y, x, len(q) AS n, round(list_sum(list_transform(range(len(q)), lambda k: q[k + 1] * (k + 1))), 3) AS total FROM o")
def sam_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The angles as a cube with a band for each reference."""
    found = matching.as_cube(matching.sam(cube(spark, sf_dir), references(spark, sf_dir), threshold=75.0))
    total = F.aggregate(F.transform("spectrum", lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v)
    return found.select("y", "x", F.size("spectrum").cast("long").alias("n"), F.round(total, 3).alias("total"))


@query("SELECT (row_number() OVER (ORDER BY ref_id) - 1)::INT AS band, 'Spec: label ' || ref_id AS description FROM r")
def sam_band_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.cube_bands(references(spark, sf_dir).select("ref_id", F.concat(F.lit("label "), F.col("ref_id").cast("string")).alias("name")))


@query(
    """, b AS (SELECT s_suppkey::BIGINT AS ds_id, n.i::INT AS band, 400.0::DOUBLE + 10 * n.i + 10 * (s_suppkey % 3) AS wavelength, 3 - s_suppkey % 3 AS first, 4 + s_suppkey % 5 AS d FROM supplier, range(12) n(i))
    SELECT ds_id, (band - first)::INT AS band, wavelength, (CASE WHEN 3 - first >= 0 AND 3 - first < 5 AND d - first >= 0 AND d - first < 5 THEN d - first ELSE 2 END)::INT AS last_shown FROM b WHERE wavelength BETWEEN 430 AND 470"""
)
def metadata_exact_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands between two stored wavelengths, whose place differs from dataset to dataset, with their display bands."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("ds_id"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("band"))
    shown = F.array(F.lit(3), (4 + F.col("ds_id") % 5).cast("int"), F.lit(3), (4 + F.col("ds_id") % 5).cast("int"))
    bands = rows.select("ds_id", "band", (400.0 + 10 * F.col("band") + 10 * (F.col("ds_id") % 3)).alias("wavelength"), shown.alias("shown"))
    kept = raster.exact_subset(bands, 430.0, 470.0)
    return kept.select("ds_id", "band", "wavelength", F.element_at(raster.moved_display(F.col("shown"), F.col("first"), F.col("size")), -1).alias("last_shown"))


@query(", m AS (SELECT band, avg(v) AS m FROM l GROUP BY band) SELECT y, x, round(sum((v - m) * (v - m)), 6) AS norm FROM l JOIN m USING (band) WHERE band % 16 <> 15 GROUP BY y, x")
def pca_keeps_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All components of the good bands: a rotation, so that distances to the mean stay."""
    rows = cube(spark, sf_dir)
    found = pca.transform(rows, pca.fit(rows, sum(GOOD), good=GOOD))
    return found.select("y", "x", F.round(F.aggregate("spectrum", F.lit(0.0), lambda s, v: s + v * v), 6).alias("norm"))


@query("SELECT y, x, round(list_sum(list_transform(s, lambda v: atan2(0.5::DOUBLE, v))), 6) AS total FROM p")
def bm_named_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = Image("cube", cube(spark, sf_dir))
    return evaluate("arctan2(b = c, a = 0.5)", {"c": image})[1].select("y", "x", F.round(_total(), 6).alias("total"))


def example_plugin() -> dict[str, BandFunction]:
    return {"Bump": BandFunction(lambda x: x * x + 1, 1, params=("x",))}


@query("SELECT y, x, round(list_sum(list_transform(s, lambda v: v * v + 1)), 6) AS total FROM p")
def bm_plugin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function found by the dotted name of its plugin."""
    functions = Registry()
    functions.plug_in(f"{__name__}.example_plugin")
    return evaluate("bump(c)", {"c": Image("cube", cube(spark, sf_dir))}, functions)[1].select("y", "x", F.round(_total(), 6).alias("total"))


@query("SELECT y - 1 AS y, x - 2 AS x, round(s[4] + s[10], 6) AS value, 430.0::DOUBLE AS wavelength FROM p WHERE x BETWEEN 2 AND 21 AND y >= 1")
def envi_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crop with two bands, written as ENVI rasters below ``spark.checkpoint.dir`` and read by byte ranges."""
    rows = cube(spark, sf_dir)
    height = (rows.agg(F.max("y")).first()[0] or 0) + 1
    header = {"samples": 25, "lines": height, "bands": 64, "wavelength": WAVELENGTHS, "wavelength units": "Nanometers"}
    at = f"{scratch(spark)}/envi-{uuid4().hex}"
    envi.write_raster(rows, at, "cube", header, left=2, top=1, width=20, height=height - 1, include=[b in (3, 9) for b in range(64)], ignore=-9999.0)
    back = envi.read_raster(spark, at).where(F.get("spectrum", F.lit(0)).isNotNull())
    first = envi.read_bands(spark, at).where("band = 0").groupBy().agg(F.min("wavelength").alias("wavelength"))
    return raster.attach(back, first).select("y", "x", F.round(_total(), 6).alias("value"), "wavelength")


@query("SELECT 'v' || vec_id AS path, n.c::INT AS column, CASE n.c WHEN 0 THEN 'one' ELSE 'two' END AS name, 64 AS size, round(list_sum(s) * (n.c + 1), 4) AS total FROM p, range(2) n(c)")
def spectra_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of comma-separated files, wavelengths first, as two spectra for each file."""
    rows = cube(spark, sf_dir, "vec_id").select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("path"), F.posexplode("spectrum").alias("band", "v"))
    body = rows.select("path", (F.col("band") + 1).alias("line"), F.concat_ws(",", (400 + 10 * F.col("band")).cast("string"), F.col("v").cast("string"), (2 * F.col("v")).cast("string")).alias("text"))
    heads = cube(spark, sf_dir, "vec_id").select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("path"), F.lit(0).alias("line"), F.lit("nm,one,two").alias("text"))
    found = spectra_text.import_spectra(heads.union(body))
    return found.select("path", "column", "name", F.size("wavelengths").alias("size"), F.round(F.aggregate("values", F.lit(0.0), lambda s, v: s + v), 4).alias("total"))
