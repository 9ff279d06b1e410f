"""Texts of similar shingle sets meet in a band however unevenly one repeats its passages."""

import random

import pandas as pd

from lumenfold.llm import minhash_dedup, neardup


def test_uneven_repeats_are_linked(spark):
    rng = random.Random(3)
    rows = []
    for i in range(60):
        words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        rows.append((2 * i, " ".join(words)))
        rows.append((2 * i + 1, " ".join(words[:200] * 50 + words[200:])))  # half of it 50 times
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["doc_id", "text"])).repartition(4)
    found = {r["doc_id"]: r["class_id"] for r in minhash_dedup.near_classes(df).collect()}
    assert found == {i: i - i % 2 for i in range(120)}


def test_signatures_do_not_see_counts(spark):
    once, often = "a b c d e f g h i j", "a b c d e f g h i j a b c d e f g h i j a b c d e f g h i j"
    sets = [set(minhash_dedup.shingles(x).tolist()) for x in (once, often)]
    assert sets[0] < sets[1]
    both = [often, often + " " + " ".join(often.split()[:10])]  # equal sets, other counts
    assert set(minhash_dedup.shingles(both[0]).tolist()) == set(minhash_dedup.shingles(both[1]).tolist())
    df = spark.createDataFrame(list(enumerate(both)), "id long, text string")
    rows = minhash_dedup.signed(df).collect()
    assert {r["bucket"] for r in rows if r["id"] == 0} == {r["bucket"] for r in rows if r["id"] == 1}


def test_places_change_nothing(spark, monkeypatch):
    """Buckets of one partition that are met place by place give the same classes."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(60)]
    base = [[rng.choice(words) for _ in range(60)] for _ in range(30)]
    rows = [(100 * i + k, " ".join(b[:k] + ["x"] * (k % 3) + b[k:])) for i, b in enumerate(base) for k in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    whole = sorted(map(tuple, minhash_dedup.near_classes(df).collect()))
    monkeypatch.setattr(neardup, "PLACE_BYTES", 2000)
    assert neardup.places_for(df, 4) > 40
    assert sorted(map(tuple, minhash_dedup.near_classes(df).collect())) == whole
    assert len({r[1] for r in whole}) < 60
