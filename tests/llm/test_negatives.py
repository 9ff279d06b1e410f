"""Hard negatives against brute force, and the intervals against true scores."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import negatives
from lumenfold.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import assert_same

COLUMNS = "anchor_id positive_id rank negative_id positive_score negative_score".split()


def plain(rows, positives=5, negatives_=5, low=80, high=100):
    rows = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and None not in r[2]]
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    for own, label, v in rows:
        if own % 100:
            continue
        scored = sorted((-dot(v, w), i, other) for i, other, w in rows if i != own)
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            fit = [x for x in scored if x[2] != label and low * -s <= 100 * -x[0] <= high * -s]
            out += [(own, p, k, i, -s, -t) for k, (t, i, _) in enumerate(fit[:negatives_], 1)]
    return sorted(out)


def found(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_intervals_hold_the_scores():
    rng = np.random.default_rng(1)
    for size, layers in ((3, 1), (64, 1), (64, 4), (100, 3)):
        rows, asked = np.floor(rng.standard_normal((300, size)) * 90), np.floor(rng.standard_normal((40, size)) * 90)
        rows[0] = 0
        codes, aligned, rest = negatives.encoded(rows, layers)
        lo, hi = negatives.Anchors(asked).intervals(slice(0, 40), codes, aligned, rest, np.linalg.norm(rows, axis=1))
        true = asked @ rows.T
        assert (lo <= true).all() and (true <= hi).all()
        if layers > 1:
            assert (hi - lo).mean() < 1.2 * np.linalg.norm(rows, axis=1).mean() * np.linalg.norm(asked, axis=1).mean()


@pytest.mark.parametrize("block_bytes", [16 << 20, 700])
def test_equals_brute_force(spark, block_bytes):
    rng = random.Random(7)
    rows = [(i, rng.choice([1, 1, 1, 2, 3]), [rng.randint(-4, 9) for _ in range(8)]) for i in range(601)]
    rows += [(1000 + i, 2, rows[0][2]) for i in range(5)] + [(2000, 1, [3, 1]), (None, 1, [1] * 8), (2001, None, [1] * 8), (2002, 1, None), (2003, 1, [1, None]), (2004, 2, [])]
    rows += [rows[5]] * 3  # repeated rows
    df = spark.createDataFrame(rows, "vec_id long, label int, vector array<long>").withColumn("id", F.lit("x")).withColumn("score", F.lit(0)).repartition(5)
    assert found(negatives.mine(df, F.col("vec_id") % 100 == 0, block_bytes=block_bytes)) == plain(rows)


def test_large_components(spark):
    rows = [(100, 1, [3_000_000_000, 1]), (1, 1, [2_000_000_000, 5]), (2, 2, [1_900_000_000, -3])]
    df = spark.createDataFrame(rows, "vec_id long, label int, vector array<long>")
    assert found(negatives.mine(df, F.col("vec_id") % 100 == 0)) == plain(rows)


def test_nothing_to_mine(spark):
    empty = spark.createDataFrame([], "vec_id long, label int, vector array<long>")
    assert negatives.mine(empty, F.col("vec_id") % 100 == 0).collect() == []
    alone = spark.createDataFrame([(100, 1, [1]), (3, 2, [1])], empty.schema)
    assert negatives.mine(alone, F.col("vec_id") % 100 == 0).columns == COLUMNS
    assert negatives.mine(alone, F.col("vec_id") % 100 == 0).collect() == []
    assert negatives.mine(alone, F.lit(False)).collect() == []


def test_query_equals_sql(spark):
    assert_same(QUERIES["op12_hard_negatives"](spark, "/root/testdata/sf0.01"), ORACLE_SQL["op12_hard_negatives"], "/root/testdata/sf0.01")


def test_query_leaves_out_what_is_no_number(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 3), (1, [0.9, 0.5], 3), (2, [0.8, 0.6], 4), (3, [nan, 1.0], 4), (4, [inf, 1.0], 4), (5, [None, 1.0], 3), (6, None, 4), (8, [0.85, 0.5], None), (7, [0.8, 0.5], 2), (None, [1.0, 1.0], 3)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert_same(QUERIES["op12_hard_negatives"](spark, str(tmp_path)), ORACLE_SQL["op12_hard_negatives"], str(tmp_path))
