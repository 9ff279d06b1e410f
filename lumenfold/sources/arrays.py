"""Arrays in memory as cubes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def from_array(spark: SparkSession, values: np.ndarray) -> tuple[DataFrame, DataFrame, float | None]:
    """((y, x, spectrum), (band, good), ignore value) of an array [band][y][x] or [y][x], which may be masked.

    Masked and non-finite values are NULL; the ignore value is the value under the first masked element; all bands are
    good. The array is the caller's own and stands in memory already.
    """
    cube = values[None] if values.ndim == 2 else values
    n, h, w = cube.shape
    mask = np.ma.getmaskarray(cube)
    plain = np.where(mask, np.nan, np.ma.getdata(cube)).astype(float)
    ignore = float(np.ma.getdata(cube)[mask][0]) if mask.any() else None
    y, x = np.divmod(np.arange(h * w), max(w, 1))
    spectra = [[float(v) if np.isfinite(v) else None for v in s] for s in plain.reshape(n, -1).T]
    rows = pd.DataFrame({"y": y, "x": x, "spectrum": spectra})
    pixels = spark.createDataFrame(rows, "y int, x int, spectrum array<double>")
    return pixels, spark.createDataFrame([(b, True) for b in range(n)], "band int, good boolean"), ignore
