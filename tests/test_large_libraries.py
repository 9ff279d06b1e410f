"""A library of several blocks gives what one block gives, and the pixels are not shuffled for it."""

import random

from lumenfold.operators import matching


def test_blocks_change_nothing(spark, monkeypatch):
    rng = random.Random(3)
    pixels = spark.createDataFrame([(y, x, [rng.random() + 0.1 for _ in range(12)]) for y in range(6) for x in range(5)], "y int, x int, spectrum array<double>")
    refs = spark.createDataFrame([(i, [rng.random() + 0.1 if rng.random() > 0.1 else None for _ in range(12)]) for i in range(40)], "ref_id long, ref array<double>")
    waves = [400.0 + 10 * b for b in range(12)]
    told = lambda: [sorted(map(tuple, df.collect()), key=str) for df in (matching.sam(pixels, refs), matching.best_angle(pixels, refs), matching.sff(pixels, refs, waves))]
    whole = told()
    monkeypatch.setattr(matching, "LIBRARY_BYTES", 1500)
    assert matching.with_library(pixels, refs)[1] > 2
    assert told() == whole
    plan = matching.sam(pixels, refs)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    monkeypatch.setattr(matching, "LIBRARY_BYTES", 64 << 20)
    assert matching.with_library(pixels, refs.limit(0))[1] == 1 and matching.sam(pixels, refs.limit(0)).collect() == []
