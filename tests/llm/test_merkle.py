"""The manifest against a tree built and folded plainly with hashlib."""

import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from lumenfold.llm import merkle
from lumenfold.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import assert_same

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
KIND = "doc_id long, source string, lang string, n_chars long, text string"
H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def walk(nodes, at, now):
    """(root, siblings, root from ``now``)"""
    siblings = []
    while len(nodes) > 1:
        first = at // 16 * 16
        run = nodes[first : first + 16]
        siblings += run[: at - first] + run[at - first + 1 :]
        now = H(*run[: at - first], now, *run[at - first + 1 :])
        nodes, at = [H(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)], at // 16
    return nodes[0], siblings, now


def plain(rows, tamper):
    groups = {}
    for r in rows:
        groups.setdefault((r[1] is not None, (r[1] or "").encode()), []).append(r)
    trees = {s: sorted(g, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s, g in sorted(groups.items())}
    leaves = {s: [leaf(r) for r in g] for s, g in trees.items()}
    subroots = [walk(x, 0, "")[0] for x in leaves.values()]
    out = []
    for k, (s, g) in enumerate(trees.items()):
        for i, r in enumerate(g):
            sub, beside, now = walk(leaves[s], i, leaf(tamper(r)))
            root, above, now = walk(subroots, k, now)
            out.append((r[0], leaves[s][i], sub, root, H(*beside, *above), now, now == root))
    return sorted(out, key=str)


def lowered(r):
    if r[0] is None or r[4] is None or zlib.crc32(str(r[0]).encode()) % 5:
        return r
    return (*r[:4], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4]))


def found(df):
    names = "doc_id leaf subroot root proof_sha256 folded_root verified".split()
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=str)


def test_compression_equals_the_library():
    rng = np.random.default_rng(0)
    for n in (1, 2, 16):
        message = rng.integers(0, 256, (5, n, 64), dtype=np.uint8)
        state = np.repeat(merkle._START[:, None], 5, 1)
        for k in range(n):
            state = merkle.compressed(state, message[:, k])
        assert [x.tobytes().decode() for x in merkle.finished(state, np.full(5, n))] == [hashlib.sha256(m.tobytes()).hexdigest() for m in message]


def test_equals_plain_trees(spark, tmp_path):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aBÄ cZ\n") for _ in range(rng.randint(0, 30)))
    source = lambda: rng.choice(["hot"] * 20 + ["", None, "é", "z", "😀"])
    rows = [(i, source(), rng.choice(["en", None]), rng.randint(0, 9), word()) for i in range(700)]
    rows += [(5000 + i, f"source {i}", None, None, None) for i in range(40)] + [(-7, "hot", "en", None, "A" * 50_000), (None, "hot", "en", 1, "B"), (None, None, None, None, None)]
    rows += [rows[3]] * 40 + [(rows[3][0], "hot", "en", 1, word()) for _ in range(5)]
    rng.shuffle(rows)
    spark.createDataFrame(rows, KIND).withColumn("digest", F.lit(1)).repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    got = found(QUERIES["op13_merkle"](spark, str(tmp_path)))
    assert got == plain(rows, lowered)
    assert {r[6] for r in got} == {True, False}


def test_one_row_and_none(spark):
    one = spark.createDataFrame([(5, "s", None, 1, "Abc")], KIND)
    assert found(merkle.manifest(one, FIELDS)) == plain([(5, "s", None, 1, "Abc")], lambda r: r)
    assert merkle.manifest(one.limit(0), FIELDS).collect() == []


def test_other_columns(spark):
    """Fields, key and group are the caller's; a changed group or key changes the leaf only."""
    rows = spark.createDataFrame([(i, i % 3, f"v{i}", "x") for i in range(300)], "n long, tree int, v string, at string")
    out = merkle.manifest(rows, ["n", "v"], key="n", group="tree", tampered={"v": F.lit("w")}, where=F.col("n") == 7).collect()
    assert len(out) == 300 and [r["n"] for r in out if not r["verified"]] == [7]


def test_query_equals_sql(spark):
    for sf in ("sf0.001", "sf0.01"):
        assert_same(QUERIES["op13_merkle"](spark, f"/root/testdata/{sf}"), ORACLE_SQL["op13_merkle"], f"/root/testdata/{sf}")
