"""Sharding, deduplication, archives and neighbours against brute force and exact round trips."""

import base64
import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from lumenfold.llm import ann, exact_dedup, line_dedup, minhash_dedup, neardup, sharding, warc
from lumenfold.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import assert_same


# sharding


def test_shards_are_balanced_and_gapless(spark):
    df = spark.range(3001).select(F.col("id").alias("doc_id"), F.lit("x").alias("arc"), F.lit(5).alias("rank"), F.lit(9).alias("shard"))
    rows = sharding.assign(df, 7).collect()
    assert len(rows) == 3001 and all(r["arc"] == "x" and r["rank"] == 5 for r in rows)
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(map(len, slots.values())) == [428] * 2 + [429] * 5
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_one_more_shard_moves_few(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"))
    a, b = ({r["doc_id"]: r["shard"] for r in sharding.assign(df, n, slack=0.1).collect()} for n in (8, 9))
    moved = sum(a[i] != b[i] for i in a)
    assert moved < 0.3 * len(a)
    loads = np.bincount(list(b.values()), minlength=9)
    assert loads.max() <= np.ceil(1.1 * 4000 / 9)


def test_shards_of_odd_tables(spark):
    schema = "doc_id long, text string"
    assert sharding.assign(spark.createDataFrame([], schema), 4).count() == 0
    rows = sharding.assign(spark.createDataFrame([(None, "a"), (None, "a"), (1, "b"), (1, "b"), (1, "b")], schema), 4).collect()
    assert sorted(np.bincount([r["shard"] for r in rows], minlength=4)) == [1, 1, 1, 2]


def test_the_whole_arc_goes_round(spark):
    """All keys in one arc: every shard gets its share from the queue."""
    rows = sharding.assign(spark.createDataFrame([(5, i) for i in range(100)], "doc_id long, i int"), 3).collect()
    assert sorted(np.bincount([r["shard"] for r in rows])) == [33, 33, 34]


# exact deduplication


def digests(n, seed=0):
    return np.frombuffer(b"".join(hashlib.sha256(f"{seed}/{i}".encode()).digest() for i in range(n)), ">u8").astype(np.uint64).reshape(-1, 4)


def test_index_inserts_deletes_and_grows():
    index, d = exact_dedup.CuckooIndex(4), digests(5000)
    index.insert(d[:3000], np.zeros((3000, 3), np.int64))
    assert len(index.prints) > 4 and (index.find(d[:3000]) >= 0).all() and (index.find(d[3000:]) < 0).all()
    index.delete(index.find(d[500:1500]))
    assert (index.find(d[500:1500]) < 0).all() and (index.find(d[:500]) >= 0).all() and len(index) == 2000
    index.insert(d[3000:], np.zeros((2000, 3), np.int64))
    assert (index.find(d[3000:]) >= 0).all() and index.used == 4000  # places of deleted keys are used again
    assert (index.prints != 0).sum() == len(index)


def test_a_fingerprint_is_verified():
    index, d = exact_dedup.CuckooIndex(4), digests(1)
    index.insert(d, np.zeros((1, 3), np.int64))
    twin = d.copy()
    twin[0, 3] += np.uint64(1)  # the same fingerprint and buckets
    assert index.find(twin)[0] < 0
    index.insert(twin, np.ones((1, 3), np.int64))
    index.delete(index.find(d))
    assert index.find(d)[0] < 0 and index.find(twin)[0] >= 0


def test_copies(spark):
    random.seed(3)
    rows = [(i, random.choice([None, "", "a", "b", "c" * 100_000, f"own {i}"]), 0) for i in range(400)]
    rows += [(7, "twice", 0), (7, "twice", 0), (None, "twice", 0), (None, "none", 0), (None, "none", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, uid int").repartition(5)
    got = exact_dedup.mark_copies(df, carry=("text",)).collect()
    assert len(got) == len(rows)
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(t or "", []).append(i)
    for r in got:
        ids = groups[r["text"] or ""]
        assert r["group_size"] == len(ids) and r["keep_id"] == max((i for i in ids if i is not None), default=None)
        assert bytes(r["digest"]) == hashlib.sha256((r["text"] or "").encode()).digest()
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in kept)
    assert exact_dedup.mark_copies(df.where("false")).count() == 0


# archives


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(5)
    bodies = ["<p>" + " ".join(rng.choices(["alpha", "beta", "gamma", "ünï"], k=rng.randint(0, 300))) + "</p>" for _ in range(60)]
    rows = [(i, f"http://x/{i}\r\nHost: y", rng.choice(bodies + [None, ""]), "extra") for i in range(200)] + [(600, None, bodies[0], "x"), (600, None, bodies[0], "x"), (None, "u", "alone", ""), (500, "u", "long " * 100_000, "")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, frame string").repartition(3), rows


def test_archives_come_back(spark, tmp_path, pages):
    df, rows = pages
    path = str(tmp_path / "archives")
    warc.write_archives(df, path)
    got = warc.read_archives(spark, path).collect()
    assert len(got) == len(rows) and all(r["error"] is None for r in got)
    first = {}
    for i, _, html, _ in rows:
        first[html or ""] = min((x for x in (i, first.get(html or "")) if x is not None), default=None)
    by = {}
    for i, _, html, _ in rows:
        by.setdefault(i, (html or "").encode())
    for r in got:
        body = by[r["page_id"]]
        assert r["payload_bytes"] == len(body) and r["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()
        own = first[body.decode()]
        assert (r["record_type"], r["refers_to"]) == (("response", None) if own == r["page_id"] else ("revisit", own))
        assert r["payload"] is None if r["refers_to"] is not None else bytes(r["payload"]) == body
    data = next((tmp_path / "archives").glob("part-*")).read_bytes()
    assert struct.unpack("<I", data[:4])[0] in (warc.DICTIONARY, warc.FRAME)


def test_an_empty_archive(spark, tmp_path, pages):
    warc.write_archives(pages[0].where("false"), str(tmp_path / "none"))
    assert warc.read_archives(spark, str(tmp_path / "none")).count() == 0


def archive(records):
    return b"".join(f + warc.SEPARATOR.encode() for f in warc.frames(iter(records)))


def test_bad_records_are_told():
    good = warc.record(1, "u", b"payload", None, "2024-01-01T00:00:00Z")
    assert warc.parse(good)["payload"] == b"payload"
    for bad in (good[:-4], good.replace(b"WARC-Date", b"Date"), good.replace(b"payload\r", b"paylord\r"), b"nothing", good.replace(b"WARC/1.1", b"XARC/1.1"), re.sub(rb"Content-Length: \d+\r\n\r\nHTTP", b"Content-Length: 99999\r\n\r\nHTTP", good)):
        with pytest.raises(ValueError):
            warc.parse(bad)


def test_dictionaries_and_damage():
    records = [warc.record(i, "http://host/path", b"<html><body>some text and more " * (i % 9 + 3), None, "2024-01-01T00:00:00Z") for i in range(300)]
    data = archive(records)
    assert struct.unpack("<I", data[:4])[0] == warc.DICTIONARY
    assert [r for r, _ in warc.records_of(data)] == records
    size = struct.unpack("<I", data[4:8])[0]
    with pytest.raises(zstandard.ZstdError):  # frames need the dictionary
        zstandard.ZstdDecompressor().decompress(data[16 + size :])
    assert list(warc.records_of(data[:-30]))[-1][1] is not None
    assert [e for _, e in warc.records_of(b"garbage!" + data)] != [None]
    assert [r for r, _ in warc.records_of(archive(records[:3]))] == records[:3]  # too few for a dictionary


# near duplicates


def words_of(t):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())


def shingle_set(t):
    w = words_of(t)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {("none", t or "")}


def line_set(t):
    t = " ".join(t.lower().split()).ljust(8, "\0")
    return {t[i : i + 8] for i in range(len(t) - 7)}


def roots(sets, threshold=0.8):
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(sets))]


def varied(rng, base, edits, vocabulary):
    out = list(base)
    for _ in range(edits):
        out[rng.randrange(len(out))] = rng.choice(vocabulary)
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(900)]
    base = [rng.choices(vocabulary, k=150) for _ in range(4)]
    out = [None, "", "", "  ", "...", "one", "one", "One!", "two words", "a b c d e"]
    out += [" ".join(varied(rng, base[0], rng.randint(0, 7), vocabulary)) for _ in range(120)]  # a chain of near copies
    out += [" ".join(varied(rng, b, k, vocabulary)) for b in base[1:] for k in (0, 1, 2, 5, 30)]
    out += [" ".join(rng.choices(vocabulary, k=rng.randint(1, 200))) for _ in range(40)]
    out += [" ".join(base[2] * 100), out[20], out[20].upper()]
    return out


def test_near_classes_equal_brute_force(spark, texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "x")], "doc_id long, text string, root string").repartition(4)
    rows = minhash_dedup.near_classes(df, carry=("root",)).collect()
    want = roots([shingle_set(t) for t in texts])
    size = np.bincount([want[r["doc_id"]] for r in rows], minlength=len(texts))
    for r in rows:
        assert r["class_id"] == want[r["doc_id"]] and r["class_size"] == size[r["class_id"]] and r["root"] == "x"
    assert sorted(r["doc_id"] for r in rows if r["kept"]) == sorted(set(want))
    assert minhash_dedup.near_classes(df.where("false")).count() == 0
    df.coalesce(1).write.mode("overwrite").parquet(path := neardup_path(spark))
    assert sorted(r["doc_id"] for r in minhash_dedup.keep_one(spark.read.parquet(path)).collect()) == sorted(set(want))


def neardup_path(spark):
    from lumenfold.llm.common import scratch

    return scratch(spark, "texts")


def test_blocks_of_a_bucket(spark, texts, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = roots([shingle_set(t) for t in texts])
    assert {r["doc_id"]: r["class_id"] for r in minhash_dedup.near_classes(df).collect()} == dict(enumerate(want))


def test_probability_of_agreement():
    """Signatures agree as often as the probability Jaccard similarity says."""
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 1 << 62, (2, 400), dtype=np.uint64)
    b[:250] = a[:250]
    w, v = rng.uniform(0.5, 3, 400), rng.uniform(0.5, 3, 400)
    sign = minhash_dedup.first_arrivals([a, b], [w, v], 4096)
    x = {int(k): (p, 0.0) for k, p in zip(a, w, strict=True)}
    for k, p in zip(b, v, strict=True):
        x[int(k)] = (x.get(int(k), (0.0, 0.0))[0], p)
    pairs = np.array(list(x.values()))
    both = pairs[(pairs > 0).all(1)]
    want = sum(1 / np.maximum(pairs[:, 0] / p, pairs[:, 1] / q).sum() for p, q in both)
    assert (sign[0] == sign[1]).mean() == pytest.approx(want, abs=0.04)
    assert minhash_dedup.first_arrivals([a[:1]], [w[:1]], 32).tolist() == [[int(a[0])] * 32]


def test_lines_equal_brute_force(spark):
    rng = random.Random(8)
    lines = ["".join(rng.choices("abcdefgh ", k=rng.randint(3, 160))) for _ in range(60)]
    near = [x[:40] + "z" + x[41:] for x in lines if len(x) > 100]
    docs = ["\n".join(rng.choices(lines + near + ["", "  ", "ab", lines[0].upper()], k=rng.randint(1, 12))) for _ in range(60)] + [None, "", "\n\n", "x" * 50_000, "x" * 50_000]
    rows = [(i, t, "en", 1) for i, t in enumerate(docs)]
    df = spark.createDataFrame(rows, "doc_id long, text string, uid string, n_chars long")
    df.repartition(4).write.parquet(path := neardup_path(spark))
    df = spark.read.parquet(path)
    first = {}
    for i, t in enumerate(docs):
        for p, x in enumerate((t or "").split("\n")):
            if x.strip():
                first.setdefault(x, (i, p))
    known = sorted(first, key=first.get)
    root = dict(zip(known, (first[known[i]] for i in roots([line_set(x) for x in known])), strict=True))
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(df).collect()}
    for i, t in enumerate(docs):
        want = None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if not x.strip() or root[x] == (i, p))
        assert got[i]["text"] == want and got[i]["uid"] == "en"
        assert got[i]["n_chars"] == (None if t is None else len(want))
    assert line_dedup.dedup_lines(df.where("false")).count() == 0


def test_repeated_and_unnamed_documents(spark):
    df = spark.createDataFrame([(None, "first line of text"), (4, "first line of text"), (4, "first line of text")], "doc_id long, text string")
    df.write.parquet(path := neardup_path(spark))
    df = spark.read.parquet(path)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in line_dedup.dedup_lines(df).collect()) == [(0, ""), (4, ""), (4, "first line of text")]


@pytest.mark.parametrize("finish", [-1, 10, 500_000])
def test_components(spark, monkeypatch, finish):
    monkeypatch.setattr(neardup, "FINISH", finish)
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 103), (103, 101), (55, 54)]
    random.Random(0).shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long").repartition(6)
    got = {r["id"]: r["root"] for r in neardup.components(df).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100, 103: 100, 54: 54, 55: 54}
    assert neardup.components(df.where("false")).count() == 0


# neighbours


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(700, 16)) * rng.uniform(0.3, 2, (700, 1))
    x[50:60] = x[50]
    rows = [(i, [float(np.float32(v)) for v in r], 1) for i, r in enumerate(x)]
    rows += [(1000, None, 1), (1020, [0.0] * 16, 1), (1040, [None] + [1.0] * 15, 1), (1060, [float("nan")] + [1.0] * 15, 1), (None, [1.0] * 16, 1), (1080, [1.0] * 3, 1), (1100, [float("inf")] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int").withColumn("embedding", F.col("embedding").cast("array<float>"))
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 20 = 0"), 10, block=200).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    y = x.astype(np.float32).astype(float)
    hits = 0
    assert sorted(got) == list(range(0, 700, 20))
    for q, found in got.items():
        found.sort()
        assert [k for k, _, _ in found] == list(range(1, 11))
        assert all(s == pytest.approx(y[q] @ y[i]) and i != q for _, i, s in found)
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        scores = y @ y[q]
        scores[q] = -np.inf
        hits += len({i for _, i, _ in found} & set(np.lexsort((np.arange(700), -scores))[:10].tolist()))
    assert hits / (10 * len(got)) >= 0.9
    few = df.where("vec_id < 4")
    assert ann.nearest(few, few, 20).count() == 12
    assert ann.nearest(df.where("false"), few, 20).count() == 0


# queries


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert_same(QUERIES[name](spark, "/root/testdata/sf0.001"), ORACLE_SQL[name], "/root/testdata/sf0.001")


def test_crc_and_sizes(spark):
    rows = {r["doc_id"]: r for r in QUERIES["op2_sharding"](spark, "/root/testdata/sf0.001").collect()}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        data = (r["text"] or "").encode()
        assert (rows[r["doc_id"]]["size"], rows[r["doc_id"]]["text_crc32"]) == (len(data) + 8, zlib.crc32(data))
