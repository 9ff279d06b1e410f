"""Continuum removal: a spectrum over its upper convex hull.

The hull needs a walk along the bands, which columns can't express; it runs in Arrow batches, where all spectra of a
batch step from corner to corner together. Missing bands are dropped before the hull and stay missing.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hulls(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The upper hull of each row of y (NaN where missing) over the rising x, at its finite values.

    From a corner the next one is where the slope is steepest, the farthest on ties.
    """
    n, bands = y.shape
    ok, place = np.isfinite(y), np.arange(bands)
    out = np.full(y.shape, np.nan)
    some = np.flatnonzero(ok.any(1))
    at = ok[some].argmax(1)
    last = bands - 1 - ok[some][:, ::-1].argmax(1)
    out[some, at] = y[some, at]
    while len(go := np.flatnonzero(at < last)):
        rows, own = some[go], at[go]
        rise, run = y[rows] - y[rows, own][:, None], x - x[own][:, None]
        ahead = ok[rows] & (place > own[:, None])
        slope = np.full(rise.shape, -np.inf)
        np.divide(rise, run, out=slope, where=ahead & (run > 0))
        to = bands - 1 - slope[:, ::-1].argmax(1)
        between = ahead & (place <= to[:, None])
        line = y[rows, own][:, None] + slope[np.arange(len(go)), to][:, None] * run
        out[rows] = np.where(between, line, out[rows])
        out[rows, to] = y[rows, to]
        at[go] = to
    return out


def hull_values(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The same of one spectrum."""
    return hulls(x, y[None])[0]


def removed(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of y over their hulls, hulls); 1 where the hull is 0, NaN where a value is missing."""
    order = np.argsort(x, kind="stable")
    hull = np.empty_like(y)
    hull[:, order] = hulls(x[order], y[:, order])
    return np.where(np.isnan(hull), np.nan, np.divide(y, hull, out=np.ones_like(y), where=~np.isnan(hull) & (hull != 0))), hull


def remove(wavelengths: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same of one spectrum."""
    found, hull = removed(np.asarray(wavelengths, float), np.where(np.isfinite(values), values, np.nan)[None])
    return found[0], hull[0]


def continuum_removed(spectrum: Column, wavelengths: Sequence[float]) -> Column:
    own = np.asarray(wavelengths, dtype=float)

    @F.pandas_udf("array<double>")
    def run(values: pd.Series) -> pd.Series:
        there = values.notna()
        if not there.any():
            return values
        y = np.array([np.asarray(v, dtype=float) for v in values[there]])  # null bands become NaN
        found = removed(own, np.where(np.isfinite(y), y, np.nan))[0]
        rows = iter([r if k else [None if np.isnan(v) else v for v in r] for r, k in zip(found, ~np.isnan(found).any(1), strict=True)])
        return pd.Series([next(rows) if k else None for k in there], index=values.index, dtype=object)

    return run(spectrum)


def remove_continuum(cube: DataFrame, wavelengths: Sequence[float], spectrum: str = "spectrum") -> DataFrame:
    """``cube`` with each spectrum divided by its continuum."""
    return cube.withColumn(spectrum, continuum_removed(F.col(spectrum), wavelengths))
