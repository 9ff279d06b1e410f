"""Queries over all bands and all rows of the tables, against brute force."""

import numpy as np
import pytest

from lumenfold.plans import catalog

N, LABELS = 70, 3


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """70 vectors (2.8 lines of pixels) of 64 bands that differ beyond band 12."""
    rng = np.random.default_rng(7)
    x = rng.uniform(-0.5, 0.5, (N, 64)).astype(np.float32)
    x[:, 3::9] = 0.1
    at = str(tmp_path_factory.mktemp("whole"))
    schema = "vec_id long, embedding array<float>, label int"
    spark.createDataFrame([(i, [float(v) for v in r], i % LABELS) for i, r in enumerate(x)], schema).write.parquet(f"{at}/embeddings.parquet")
    return at, x.astype(float) + 1.5


def removed(v):
    """Values over the highest chord at each band."""
    chord = [max(v[j] if i == k else v[i] + (v[k] - v[i]) * (j - i) / (k - i) for i in range(j + 1) for k in range(j, len(v)) if i < k or i == j) for j in range(len(v))]
    return v / np.array(chord)


@pytest.fixture(scope="module")
def features(tables):
    return np.array([1 - removed(v) for v in tables[1]])


def test_continuum_of_all_bands(spark, tables, features):
    rows = catalog.QUERIES["continuum_removal"](spark, tables[0]).collect()
    assert len(rows) == N * 64
    for r in rows:
        assert r["value"] == pytest.approx(1 - features[r["y"] * 25 + r["x"]][r["band"]], abs=2e-6)


def test_features_of_all_bands_and_rows(spark, tables, features):
    want = {}
    for i in range(N):
        for j in range(LABELS):
            t, r = features[i], features[j]
            scale = t @ r / (r @ r)
            want[i, j] = scale, np.sqrt(((t - scale * r) ** 2).sum() / 64)
    rows = {(r["vec_id"], r["ref_id"]): r for r in catalog.QUERIES["sff_image"](spark, tables[0]).collect()}
    assert rows.keys() == want.keys()
    for k, (scale, score) in want.items():
        assert rows[k]["scale"] == pytest.approx(scale, abs=1e-4) and rows[k]["score"] == pytest.approx(score, abs=2e-5)
    found = {(r["vec_id"], r["ref_id"]): r["score"] for r in catalog.QUERIES["sff_spectrum"](spark, tables[0]).collect()}
    assert found == {k: pytest.approx(score, abs=2e-5) for k, (_, score) in want.items() if score <= 0.06}


def test_angles_of_every_spectrum(spark, tables):
    x = tables[1] - 1.5
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    angles = np.degrees(np.arccos(np.clip(unit @ unit[:LABELS].T, -1, 1)))
    found = {(r["vec_id"], r["ref_id"]): r["score"] for r in catalog.QUERIES["sam_spectrum"](spark, tables[0]).collect()}
    assert found == {(i, j): pytest.approx(angles[i, j], abs=2e-3) for i in range(N) for j in range(LABELS) if angles[i, j] <= 90}
    assert max(i for i, _ in found) >= 20
