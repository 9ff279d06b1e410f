"""Masks and rotation over every row of a table, a last line that isn't full among them."""

import pytest

from lumenfold.plans import catalog


@pytest.fixture(scope="module")
def at(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("rasters"))
    rows = [(i, [0.1 if b % 7 == 0 else i + b / 64 for b in range(64)], i % 5) for i in range(25 * 30 + 8)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{at}/embeddings.parquet")
    return at


def test_every_pixel_is_masked(spark, at):
    found = {(r["y"], r["x"], r["band"]): r["value"] for r in catalog.QUERIES["mask_values"](spark, at).collect()}
    want = {(i // 25, i % 25, b): None if b % 16 == 15 or b % 7 == 0 else pytest.approx(i + b / 64, rel=1e-6, abs=1e-6) for i in range(758) for b in range(64)}
    assert found == want


def test_the_whole_band_turns(spark, at):
    found = {(r["y"], r["x"]): r["value"] for r in catalog.QUERIES["rotate_nearest"](spark, at).collect()}
    assert found == {(24 - i % 25, i // 25): pytest.approx(i + 3 / 64, rel=1e-6) for i in range(758)}
