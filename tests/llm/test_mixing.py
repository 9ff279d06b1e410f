"""The mix against a plain one, slot by slot, and against its targets."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from lumenfold.llm import mixing
from lumenfold.llm.queries import QUERIES

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
KIND = "doc_id long, text string, source string"


def plain_targets(sizes, share=1.5, most=2.0):
    """By halving: the level at which the capped shares add up."""
    w, total = [(5, 2, 1)[i % 3] for i in range(len(sizes))], share * sum(sizes)
    lo, hi = 0.0, total + 1
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(most * s, mid * x) for s, x in zip(sizes, w, strict=True)) < total else (lo, mid)
    return [min(most * s, hi * x) for s, x in zip(sizes, w, strict=True)]


def corpus(rng, n=400):
    gap = lambda: rng.choice([" ", "\n", "\t ", "\x0b", "  "])
    text = lambda k: gap().join(rng.choice(["a", "ü x", "word", " ", "1"]) for _ in range(k))
    rows = [(i, text(rng.choice([0, 1, 7, 40, 300])), rng.choice(["hot"] * 9 + ["", "z", "é", None, "rare"])) for i in range(n)]
    rows += [(n, None, "hot"), (n + 1, "", "none"), (n + 2, text(5000), "z"), (None, text(9), "hot"), (n + 3, text(2), None)]
    rows += [rows[7]] * 5 + [(rows[7][0], text(3), "hot")]
    rng.shuffle(rows)
    return rows


def check(rows, got, exact=True):
    """Sizes, targets and bounds of (doc_id, size, source_size, target, taken)."""
    size = lambda t: len(WORDS.findall(t or ""))
    of = Counter()
    for _, t, s in rows:
        of[s] += size(t)
    order = sorted(of, key=lambda s: (s is None, (s or "").encode()))
    target = dict(zip(order, plain_targets([of[s] for s in order]), strict=True))
    near = lambda x: round(x, 4)
    want = sorted((str(d), size(t), of[s], near(target[s])) for d, t, s in rows)
    assert sorted((str(r["doc_id"]), r["size"], r["source_size"], near(r["target"])) for r in got) == want
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    taken = defaultdict(int)
    for r in got:
        taken[near(r["target"]), r["source_size"]] += r["taken"]
    expected = defaultdict(int)
    for s in order:
        expected[near(target[s]), of[s]] += target[s]
    for k, v in expected.items():
        assert abs(taken[k] - v) <= 2


def plain_mix(rows, block, slots, seed=11):
    """Words taken by document, walking shard by shard and slot by slot."""
    by = defaultdict(list)
    for d, t, s in rows:
        by[s].append((d, WORDS.findall(t or "")))
    order = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    streams = {s: [(d, w) for d, ws in sorted(by[s], key=lambda x: x[0]) for w in ws] for s in order}
    sizes = np.array([len(streams[s]) for s in order])
    plan = mixing.Plan(order, sizes, mixing.targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(order))], 1.5, 2.0), block, slots, seed)
    draws = [k for shard in range(plan.shards) for k, n in enumerate(plan.draw(shard)) for _ in range(n)]
    seen, spare = Counter(), []
    for k in draws:
        seen[k] += 1
    lacking = [k for k in range(len(order)) for _ in range(max(0, plan.slots[k] - seen[k]))]
    spare = Counter({k: seen[k] - plan.slots[k] for k in seen if seen[k] > plan.slots[k]})
    assert sum(spare.values()) == len(lacking)
    taken, words = Counter(), Counter()
    for k, s in enumerate(order):
        left, turn = int(plan.words[k]), 0
        cuts = [streams[s][i : i + block] for i in range(0, len(streams[s]), block)]
        full = sum(len(c) == block for c in cuts)
        while left:
            turn_order = [int(mixing.permuted(np.array([i]), np.array([full]), plan.keys[k : k + 1] + np.uint64(turn))[0]) if i < full else i for i in range(len(cuts))]
            assert sorted(turn_order) == list(range(len(cuts)))
            for b in turn_order:
                for d, w in cuts[b][:left]:
                    taken[d] += 1
                    words[w] += 1
                left -= len(cuts[b][:left])
            turn += 1
    return taken, words


def test_permutations():
    for n in (1, 2, 3, 17, 1000):
        for key in range(3):
            assert sorted(mixing.permuted(np.arange(n), np.full(n, n), np.full(n, key))) == list(range(n))
    assert list(mixing.permuted(np.arange(50), np.full(50, 50), np.zeros(50))) != list(mixing.permuted(np.arange(50), np.full(50, 50), np.ones(50)))


def test_equals_a_plain_mix(spark):
    rng = random.Random(2)
    rows = [r for r in {r[0]: r for r in corpus(rng)}.values() if r[0] is not None]
    df = spark.createDataFrame(rows, KIND).withColumn("size", F.lit("x")).withColumn("row", F.lit(1)).repartition(6)
    found = mixing.mix(df, block=16, slots=20)
    taken, words = plain_mix(rows, 16, 20)
    got = {r["key"]: r["n"] for r in found.spans.groupBy("key").agg(F.sum("words").alias("n")).collect()}
    assert got == dict(taken)
    slots = mixing.texts(df, found.spans).collect()
    assert Counter(w for r in slots for w in WORDS.findall(r["text"])) == words
    at = defaultdict(set)
    for r in slots:
        at[r["shard"]].add(r["slot"])
    assert all(at[s] == set(range(len(at[s]))) for s in at) and sorted(at) == list(range(found.plan.shards))
    counts = defaultdict(Counter)
    for r in found.spans.where("at = 0").select("shard", "source").collect():
        counts[r["shard"]][r["source"]] += 1
    same = sum(min(counts[k][s], n) for k in counts for s, n in zip(found.plan.names, found.plan.draw(k), strict=True))
    assert same > 0.8 * sum(map(len, at.values()))  # all but a small share of the slots are as drawn


def test_all_rows_of_a_rough_table(spark, tmp_path):
    rows = corpus(random.Random(5))
    spark.createDataFrame(rows, KIND).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op11_mixing"](spark, str(tmp_path)).collect()
    check(rows, got)
    spark.createDataFrame(rows[::-1], KIND).repartition(8).write.parquet(f"{tmp_path}/again/documents.parquet")
    again = QUERIES["op11_mixing"](spark, f"{tmp_path}/again").collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_nothing_to_mix(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, " ", None)], KIND)
    found = mixing.mix(df)
    assert [r["target"] for r in found.documents.collect()] == [0.0, 0.0] and found.spans.collect() == []
    assert mixing.mix(df.limit(0)).documents.collect() == []


def test_the_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()]
    check(rows, QUERIES["op11_mixing"](spark, sf).collect())
