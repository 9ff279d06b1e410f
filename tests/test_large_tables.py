"""Cases that only large tables have, each made small."""

import math

import pytest

from lumenfold.operators import geo
from lumenfold.operators import warp as wp
from lumenfold.plans import catalog
from tests.oracle import assert_same


def test_distances_beyond_the_squares_of_integers(spark, tmp_path):
    spark.sql("SELECT id AS event_id, 'a' AS event_type, 1.0D AS value FROM VALUES (4634799L), (4634800L), (6000000L), (36000099L) AS t(id)").write.parquet(f"{tmp_path}/events.parquet")
    found = {r["event_id"]: (r["d"], r["m"]) for r in catalog.QUERIES["distances"](spark, str(tmp_path)).collect()}
    places = {i: (i % 100 - 7, i // 100 - 9) for i in (4634799, 4634800, 6000000, 36000099)}
    assert found == {i: (pytest.approx(math.hypot(x, y), abs=1e-6), abs(x) + abs(y)) for i, (x, y) in places.items()}


@pytest.mark.parametrize("height", [44, 99])
def test_turned_places_on_an_edge(spark, tmp_path, height):
    spark.range(25 * height).selectExpr("id AS vec_id", "transform(sequence(0, 63), b -> float(id % 97 + b)) AS embedding", "int(id % 3) AS label").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.range(4).selectExpr("id AS event_id", "'a' AS event_type", "1.0D AS value").write.parquet(f"{tmp_path}/events.parquet")
    assert_same(catalog.QUERIES["cube_turned"](spark, str(tmp_path)), catalog.ORACLE["cube_turned"], str(tmp_path))


@pytest.mark.parametrize("height", [80, 99])
def test_warped_places_on_the_source_s_edge(spark, tmp_path, height):
    """A line of the output meets the source's left edge: which of its pixels lie inside depends on the last digit."""
    spark.range(25 * height).selectExpr("id AS vec_id", "transform(sequence(0, 63), b -> float(id % 97 + b)) AS embedding", "int(id % 3) AS label").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.range(500).selectExpr("id AS s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(4).selectExpr("id AS event_id", "'a' AS event_type", "1.0D AS value").write.parquet(f"{tmp_path}/events.parquet")
    assert_same(catalog.QUERIES["gcp_warp"](spark, str(tmp_path)), catalog.ORACLE["gcp_warp"], str(tmp_path))


def test_only_exact_points_give_the_inverse(spark):
    rows = [(float(x), float(y), 1000 + 3 * x + 0.5 * y, 2000 - 0.25 * x - 2.5 * y) for x in range(5) for y in range(4)]
    kind = "px double, py double, gx double, gy double"
    exact = spark.createDataFrame(rows, kind)
    back = wp.way_back(exact, wp.fit_polynomial(exact))
    assert list(back.gt) == [1000.0, 3.0, 0.5, 2000.0, -0.25, -2.5] and back(1004.5, 1992.25) == (1.0, 3.0)
    near = spark.createDataFrame([*rows[:-1], (*rows[-1][:2], rows[-1][2] + 1e-9, rows[-1][3])], kind)
    assert wp.way_back(near, wp.fit_polynomial(near)) is None
    assert wp.way_back(exact, wp.fit_polynomial(exact, 2)) is None


def test_exported_zeros_keep_their_sign(spark, tmp_path):
    values = "CASE b % 5 WHEN 0 THEN -0.00003 WHEN 1 THEN 0.00003 WHEN 2 THEN -0.00005 WHEN 3 THEN -0.0D ELSE b / 100 - 0.3 END"
    spark.range(30).selectExpr("id AS vec_id", f"transform(sequence(0, 63), b -> float({values})) AS embedding", "int(id % 10) AS label").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.range(4).selectExpr("id AS event_id", "'a' AS event_type", "1.0D AS value").write.parquet(f"{tmp_path}/events.parquet")
    assert_same(catalog.QUERIES["spectra_export"](spark, str(tmp_path)), catalog.ORACLE["spectra_export"], str(tmp_path))


def test_linked_pairs_are_not_shuffled(spark):
    """Only datasets are exchanged, by size and by cell; no pairs, which are many more."""
    gt = "named_struct('gt0', double(id * 7 % 40), 'gt1', 1.0D, 'gt2', 0.0D, 'gt3', double(id * 5 % 30), 'gt4', 0.0D, 'gt5', -1.0D)"
    rows = lambda n: spark.range(n).selectExpr("id AS ds_id", "IF(id % 9 = 0, NULL, int(3 + id % 4)) AS width", "int(2 + id % 3) AS height", f"{gt} AS gt", "IF(id % 5 > 0, concat('utm', id % 2), NULL) AS wkt")
    a, b = rows(60), rows(90)
    found = geo.link_state(a, b, 16.0)
    held = lambda d: [(r["ds_id"], r["width"], r["height"], r["gt"]["gt0"], r["gt"]["gt3"], r["wkt"]) for r in d.collect()]
    want = []
    for i, w, h, x, y, k in held(a):
        for j, v, g, p, q, m in held(b):
            if w is not None and (w, h) == (v, g):
                want.append((i, j, "PIXEL"))
            elif None not in (k, m, w, v) and k == m and x <= p + v and p <= x + w and y - h <= q and q - g <= y:
                want.append((i, j, "SPATIAL"))
    assert sorted(map(tuple, found.where("a_id % 9 > 0 AND b_id % 9 > 0").collect())) == sorted(w for w in want if w[0] % 9 and w[1] % 9)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2


_SETS = ["id AS ds_id", "concat('d', id % 3) AS name", "int(id % 4) AS width", "5 AS height", "4 AS num_bands", "IF(id % 3 = 0, -9999.0D, NULL) AS ignore_value", "named_struct('gt0', double(id % 2)) AS gt", "IF(id % 5 > 0, 'utm', NULL) AS wkt"]


@pytest.mark.parametrize("block", [2, 512])
def test_pairs_of_a_name(spark, monkeypatch, block):
    monkeypatch.setattr(geo, "BLOCK", block)
    a, b = spark.range(20).selectExpr(*_SETS), spark.range(0, 33, 1, 3).selectExpr(*_SETS)
    fields = lambda i: (i % 4, i % 3 == 0, i % 2, i % 5 > 0)
    want = sorted((i, j, fields(i) == fields(j)) for i in range(20) for j in range(33) if i % 3 == j % 3)
    found = geo.same_metadata(a, b)
    assert sorted(map(tuple, found.collect())) == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert -1 < plan.find("Generate explode") < plan.find("Join Inner")  # a row of the join is a block of pairs
