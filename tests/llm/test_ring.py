"""Sharding against a walk of the ring, key by key."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lumenfold.llm import sharding
from lumenfold.llm.queries import QUERIES


def walk(spark, rows, shards, nodes=64):
    """Every row passes full shards only on its way from its own arc; the counts are at most one apart."""
    arcs = [(a["pos"], a["shard"]) for a in sharding.ring(spark, shards, nodes).first()["arcs"]]
    loads = Counter(r["shard"] for r in rows)
    assert max(loads.values()) - min(loads[i] for i in range(shards)) <= 1
    caps = [len(rows) // shards + (i < len(rows) % shards) for i in range(shards)]
    for r in rows:
        at = next((i for i, (pos, _) in enumerate(arcs) if pos >= r["h"]), 0)
        while (shard := arcs[at][1]) != r["shard"]:
            assert loads[shard] == caps[shard]
            at = (at + 1) % len(arcs)


def slots(rows, shards):
    for i in range(shards):
        own = sorted(r["slot"] for r in rows if r["shard"] == i)
        assert own == list(range(len(own)))


def test_single_keys_walk_the_ring(spark):
    h = F.xxhash64(F.col("id").isNull(), "id")
    rows = sharding.assign(spark.range(500).withColumn("h", h), 5, "id", nodes=8).collect()
    walk(spark, rows, 5, 8)
    slots(rows, 5)


def test_groups_stay_together(spark):
    rng = random.Random(4)
    keys = [f"pair {i}" for i in range(400)] * 2 + [f"one {i}" for i in range(700)] + ["large"] * 120 + ["larger"] * 190 + [None] * 60
    rng.shuffle(keys)
    df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "doc_id long, k string").repartition(6)
    rows = sharding.assign(df, 7, "k").collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(keys)))
    slots(rows, 7)
    assert sorted(Counter(r["shard"] for r in rows).values()) == sorted(len(keys) // 7 + (i < len(keys) % 7) for i in range(7))
    where = defaultdict(set)
    for r in rows:
        where[r["k"]].add(r["shard"])
    assert all(len(x) == 1 for x in where.values())


def test_a_group_larger_than_a_shard_is_cut(spark):
    rows = [(7, "x")] * 500 + [(i, "y") for i in range(1000, 2000)]
    found = sharding.assign(spark.createDataFrame(rows, "doc_id long, shard string").repartition(5), 5).collect()
    slots(found, 5)
    assert sorted(Counter(r["shard"] for r in found).values()) == [300] * 5
    assert len({r["shard"] for r in found if r["doc_id"] == 7}) == 2


def test_all_in_pairs(spark):
    """No single row is there to fill up: only pairs at the edges of shards may be cut."""
    rows = sharding.assign(spark.createDataFrame([(i // 2,) for i in range(4002)], "doc_id long"), 4).collect()
    slots(rows, 4)
    loads = Counter(r["shard"] for r in rows)
    assert max(loads.values()) - min(loads.values()) <= 1
    where = defaultdict(set)
    for r in rows:
        where[r["doc_id"]].add(r["shard"])
    assert sum(len(x) > 1 for x in where.values()) <= 8


def test_equal_texts_of_the_query(spark):
    sf = "/root/testdata/sf0.01"
    text = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op2_sharding"](spark, sf).collect()
    slots(rows, 24)
    loads = Counter(r["shard"] for r in rows)
    assert len(rows) == len(text) and max(loads.values()) - min(loads.values()) <= 1
    where = defaultdict(set)
    for r in rows:
        where[text[r["doc_id"]]].add(r["shard"])
    assert all(len(x) == 1 for x in where.values())
