"""Principal components of a cube: one aggregate for the moments, a small eigenproblem, and a projection.

The moments of n bands are n sums and n x n products, added up on the executors in one pass; only they reach the
driver. Each component's sign makes its largest loading positive.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Pca:
    mean: np.ndarray
    components: np.ndarray
    variance: np.ndarray
    ratio: np.ndarray
    count: int
    good: Sequence[bool] | None = None

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(i, float(v), float(r), float(np.sqrt(max(v, 0) * (self.count - 1))), [float(x) for x in c]) for i, (v, r, c) in enumerate(zip(self.variance, self.ratio, self.components, strict=True))]
        return spark.createDataFrame(rows, "component int, variance double, ratio double, singular_value double, loadings array<double>")


def moments(cube: DataFrame, spectrum: str = "spectrum", good: Sequence[bool] | None = None) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(n, sums, products, origin) over pixels without a missing good band, counted from a pixel as origin, so that large
    raw values lose no digits. Pixels missing in all good bands are left out, pixels missing in some raise."""
    whole = F.forall(F.col(spectrum) if good is None else _kept(spectrum, good), lambda v: v.isNotNull() & ~F.isnan(v))
    some = cube.select(spectrum).where(F.col(spectrum).isNotNull() & whole).first()  # any pixel will do
    if some is None:
        raise ValueError("no pixel has all bands")
    keep = np.ones(len(some[0]), bool) if good is None else np.array(good, bool)
    origin = np.array(some[0], dtype=float)[keep]

    def run(batches):
        n, s, p = 0, 0.0, 0.0
        for pdf in batches:
            rows = pdf[spectrum].dropna().tolist()
            if not rows:
                continue
            x = np.array(rows, dtype=float)[:, keep]
            x = x[~np.isnan(x).all(1)] - origin
            if not np.isfinite(x).all():
                raise ValueError("a pixel is missing in some bands only")
            n, s, p = n + len(x), s + x.sum(0), p + x.T @ x
        if n:
            yield pd.DataFrame({"m": [np.concatenate([[n], s, p.ravel()])]})

    parts = cube.select(spectrum).mapInPandas(run, "m array<double>").select(F.posexplode("m").alias("i", "v"))
    rows = sorted((r["i"], r["v"]) for r in parts.groupBy("i").agg(F.sum("v").alias("v")).collect())  # 1 + k + k * k numbers of k bands
    flat, k = np.array([v for _, v in rows]), len(origin)
    return int(flat[0]), flat[1 : k + 1], flat[k + 1 :].reshape(k, k), origin


def _kept(spectrum: str, good: Sequence[bool]) -> Column:
    return F.array(*(F.get(spectrum, F.lit(b)) for b, g in enumerate(good) if g))


def fit(cube: DataFrame, components: int, spectrum: str = "spectrum", good: Sequence[bool] | None = None) -> Pca:
    """The first components of the good bands (all, if not told). Ignore values are NULL or NaN beforehand."""
    n, s, p, origin = moments(cube, spectrum, good)
    if n < 2:
        raise ValueError("components need at least two pixels")
    mean = s / n
    values, vectors = np.linalg.eigh((p - n * np.outer(mean, mean)) / (n - 1))
    order = np.argsort(values)[::-1][:components]
    loadings = vectors[:, order].T
    loadings *= np.sign(loadings[np.arange(len(order)), np.abs(loadings).argmax(1)])[:, None]
    return Pca(origin + mean, loadings, values[order], values[order] / values.sum(), n, good)


def transform(cube: DataFrame, model: Pca, spectrum: str = "spectrum") -> DataFrame:
    """``cube`` with the components of each pixel, NULL where a good band is missing."""
    centred = F.zip_with(spectrum if model.good is None else _kept(spectrum, model.good), F.array(*(F.lit(float(m)) for m in model.mean)), lambda v, m: v - m)
    dot = lambda c: F.aggregate(F.zip_with(F.col("_c"), F.array(*(F.lit(float(x)) for x in c)), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return cube.withColumn("_c", centred).withColumn(spectrum, F.array(*(dot(c) for c in model.components))).drop("_c")
