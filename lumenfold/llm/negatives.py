"""Hard-negative mining by integer inner products, filtered by rotated one-bit codes.

All vectors are turned by one random rotation. A row keeps the signs of its components as a one-bit code, and its
alignment with it, the inner product of the vector with the unit code vector. What the code doesn't explain is coded the
same way, ``layers`` times. The inner product with an anchor, whose components are rounded to ``BITS`` bit planes, is
estimated by popcounts of code AND plane. By the inequality of Cauchy and Schwarz the error is at most the length of the
last residual times that part of the rounded anchor that is orthogonal to the last code, and the length of the row times
that of the rounding error. So each pair has an interval that holds its true score for certain: a pair whose interval
lies outside what is sought goes, the others are scored in integers. No true result is lost.

Anchors are the stated query set. They are dealt into blocks of at most ``block_bytes``; a block is broadcast to the
tasks that read the rows' codes, first for the positives, then for the negatives of the block. A task keeps the best of
each anchor only, and a window picks the best of all tasks, so that no label, however frequent, meets in one task.

Defined results: rows without id, label or vector, or with a null component, take no part; rows with the anchor's id
are no partners of it; repeated rows count each; a repeated anchor asks once for each of its rows; shorter vectors count
as if zeros followed; equal scores go by the smaller id; an anchor without positives, or a positive without negatives in
range, gives no rows; a score beyond 64 bits raises OverflowError; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.llm.common import cut, stored, table

BITS = 6  # of an anchor's rounded components
AT_ONCE = 32  # anchors that are estimated at a time

FOUND = "anchor_no long, anchor_id long, positive_id long, positive_score long, id long, score long"


def rotation(size: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(29).standard_normal((size, size)))[0] if size else np.zeros((0, 0))


def words(bits: np.ndarray) -> np.ndarray:
    """(…, components) of 0 and 1 as (…, words) of 64 bits."""
    packed = np.packbits(bits, axis=-1, bitorder="little")
    short = -packed.shape[-1] % 8
    return np.pad(packed, [(0, 0)] * (bits.ndim - 1) + [(0, short)]).view("<u8")


def encoded(vectors: np.ndarray, layers: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes by row, layer and word; alignments by row and layer; lengths of the last residuals)"""
    rest, root = vectors @ rotation(vectors.shape[1]), math.sqrt(max(1, vectors.shape[1]))
    codes, aligned = [], []
    for _ in range(layers):
        positive = rest >= 0
        code = np.where(positive, 1 / root, -1 / root)
        own = (rest * code).sum(1)
        codes.append(words(positive))
        aligned.append(own)
        rest = rest - own[:, None] * code
    return np.stack(codes, 1), np.stack(aligned, 1), np.linalg.norm(rest, axis=1)


class Anchors:
    """Anchors as rounded bit planes."""

    def __init__(self, vectors: np.ndarray):
        self.size = vectors.shape[1]
        turned = vectors @ rotation(self.size)
        self.low = turned.min(1, initial=0)
        self.step = np.maximum((turned.max(1, initial=0) - self.low) / (2**BITS - 1), 1e-300)
        levels = np.rint((turned - self.low[:, None]) / self.step[:, None]).astype(np.uint8)
        rounded = self.low[:, None] + self.step[:, None] * levels
        self.planes = np.stack([words(levels >> b & 1) for b in range(BITS)], 1)  # by anchor, bit and word
        self.total = levels.sum(1, dtype=np.int64)
        self.square, self.error, self.norm = (rounded**2).sum(1), np.linalg.norm(turned - rounded, axis=1), np.linalg.norm(vectors, axis=1)

    def intervals(self, some: slice, codes: np.ndarray, aligned: np.ndarray, rest: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest possible scores of anchors and rows."""
        root, estimate, along = math.sqrt(max(1, self.size)), 0.0, 0.0
        low, step, total = (x[some, None] for x in (self.low, self.step, self.total))
        for layer in range(codes.shape[1]):
            own = codes[:, layer]
            inside = np.zeros((low.shape[0], len(codes)), np.int64)
            for bit in range(BITS):
                inside += np.bitwise_count(own[None] & self.planes[some, bit][:, None]).sum(2, dtype=np.int64) << bit
            signs = 2 * np.bitwise_count(own).sum(1, dtype=np.int64) - self.size
            along = (low * signs + step * (2 * inside - total)) / root  # of the rounded anchor on the unit code vector
            estimate = estimate + along * aligned[:, layer]
        off = np.sqrt(np.maximum(self.square[some, None] - along**2, 0)) * rest + self.error[some, None] * norm
        off += 1e-9 * self.norm[some, None] * norm + 1e-3  # for what floating point rounds
        return estimate - off, estimate + off


def scores(rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Integer inner products, in doubles where these are exact."""
    bound = int(np.abs(rows).max(initial=0)) * int(np.abs(anchor).max(initial=0)) * max(1, len(anchor))
    if bound < 2**53:
        return (rows.astype(np.float64) @ anchor.astype(np.float64)).astype(np.int64)
    if bound < 2**63:
        return rows @ anchor
    return np.array([sum(int(a) * int(b) for a, b in zip(r, anchor, strict=True)) for r in rows], dtype=np.int64)


def best(score: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -score))[:n]
    return score[order], ids[order]


def nth(values: np.ndarray, n: int) -> float:
    return np.partition(values, len(values) - n)[len(values) - n] if len(values) >= n else -math.inf


def ints(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)


def scan(anchors: pa.Table, sought: dict[int, list[tuple[int | None, int | None]]], layers: int, n: int, low: int, high: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each of ``anchors`` and what is ``sought`` for it, the ``n`` best rows of a task: (None, None) asks for rows of
    its label, (id, score) of a positive for rows of other labels in that positive's range."""
    size = len(anchors["v"][0])
    ids, labels, vectors, numbers = anchors["id"].to_numpy(), anchors["label"].to_numpy(), ints(anchors["v"].combine_chunks(), size), anchors["anchor_no"].to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded = Anchors(vectors.astype(np.float64))
        held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            row_ids, row_labels, rows = batch["id"].to_numpy(), batch["label"].to_numpy(), ints(batch["v"], size)
            codes = np.frombuffer(b"".join(batch["codes"].to_pylist()), "<u8").reshape(len(rows), layers, -1)
            aligned, rest = batch["aligned"].flatten().to_numpy().reshape(len(rows), layers), batch["rest"].to_numpy()
            norm = np.linalg.norm(rows.astype(np.float64), axis=1)
            for first in range(0, len(ids), AT_ONCE):
                least, most = coded.intervals(slice(first, first + AT_ONCE), codes, aligned, rest, norm)
                for i, (lo, hi) in enumerate(zip(least, most, strict=True), first):
                    if not (asked := sought.get(int(numbers[i]))):
                        continue
                    same = row_labels == labels[i]
                    fit = np.flatnonzero((same if asked[0][0] is None else ~same) & (row_ids != ids[i]))
                    lo, hi, passed = lo[fit], hi[fit], np.zeros(len(fit), bool)
                    for k, (_, p) in enumerate(asked):
                        top = math.inf if p is None else high * p / 100
                        floor = -math.inf if p is None else low * p / 100
                        known = held.get((i, k))
                        reached = known[0][-1] if known is not None and len(known[0]) == n else -math.inf
                        floor = max(floor - 0.01, reached, nth(lo[hi <= top], n))
                        passed |= (hi >= floor) & (lo <= top + 0.01)
                    near = fit[passed]
                    own = scores(rows[near], vectors[i])
                    for k, (_, p) in enumerate(asked):
                        ok = slice(None) if p is None else (own >= -(-low * p // 100)) & (own <= high * p // 100)  # exact in Python's integers
                        s, found = own[ok], row_ids[near][ok]
                        if (i, k) in held:
                            s, found = np.concatenate([held[i, k][0], s]), np.concatenate([held[i, k][1], found])
                        held[i, k] = best(s, found, n)
        for (i, k), (s, found) in held.items():
            p_id, p = sought[int(numbers[i])][k]
            m = len(s)
            yield pa.record_batch([pa.array([x] * m, pa.int64()) for x in (int(numbers[i]), int(ids[i]), p_id, p)] + [pa.array(found, pa.int64()), pa.array(s, pa.int64())], names=["anchor_no", "anchor_id", "positive_id", "positive_score", "id", "score"])

    return run


def mine(rows: DataFrame, anchor: Column, key: str = "vec_id", label: str = "label", vector: str = "vector", positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, layers: int = 4, block_bytes: int = 16 << 20) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows where ``anchor`` holds.

    The positives of an anchor are its first ``positives`` other rows of the same label; for each, the first
    ``negatives`` rows of other labels with ``low`` to ``high`` per cent of its score are returned. ``vector`` is an
    array of integers.
    """
    spark = rows.sparkSession
    used = rows.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<long>").alias("v"), F.coalesce(anchor, F.lit(False)).alias("is_anchor"))
    used = used.where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND NOT exists(v, x -> x IS NULL)")
    size = used.agg(F.max(F.size("v"))).first()[0]
    if size is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    padded = used.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(size) - F.size("v"))))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, aligned, rest = encoded(ints(batch["v"], size).astype(np.float64), layers)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rest) + 1, dtype=np.int32) * layers), pa.array(aligned.ravel()))
            yield pa.record_batch([batch[c] for c in ("id", "label", "v", "is_anchor")] + [pa.array([c.tobytes() for c in codes], pa.binary()), lists, pa.array(rest)], names=["id", "label", "v", "is_anchor", "codes", "aligned", "rest"])

    coded = stored(padded.mapInArrow(encode, "id long, label long, v array<long>, is_anchor boolean, codes binary, aligned array<double>, rest double"))
    asked = cut(coded.where("is_anchor").select("id", "label", "v").withColumn("anchor_no", F.monotonically_increasing_id()))
    blocks = math.ceil(asked.count() * 8 * (size + 8) / block_bytes)
    schema, results = FOUND, []
    for b in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("anchor_no"), F.lit(blocks)) == b).toArrow()  # at most some block_bytes
        if not own.num_rows:
            continue
        ask = {int(a): [(None, None)] for a in own["anchor_no"].to_numpy()}
        order = Window.partitionBy("anchor_no").orderBy(F.desc("score"), "id")
        near = coded.mapInArrow(scan(own, ask, layers, positives, low, high), schema)
        near = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= positives)
        of_block: dict[int, list[tuple[int | None, int | None]]] = {}
        for r in near.select("anchor_no", "id", "score").collect():  # ``positives`` rows for each anchor of the block
            of_block.setdefault(r["anchor_no"], []).append((r["id"], r["score"]))
        if not of_block:
            continue
        order = Window.partitionBy("anchor_no", "positive_id", "positive_score").orderBy(F.desc("score"), "id")
        far = coded.mapInArrow(scan(own, of_block, layers, negatives, low, high), schema)
        far = far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
        far = far.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        results.append(far if blocks == 1 else stored(far))
    if not results:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    out = results[0]
    for r in results[1:]:
        out = out.union(r)
    return out


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with a null or non-finite component take no part, as rows without a label."""
    x = lambda v: v.cast("double")
    usable = F.forall("embedding", lambda v: F.coalesce(F.abs(x(v)) < float("inf"), F.lit(False)))  # a NaN isn't below infinity
    rows = table(spark, sf_dir, "embeddings").where(F.coalesce(usable, F.lit(False))).select(
        "vec_id",
        F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
        F.transform("embedding", lambda v: F.floor(256 * x(v))).alias("vector"),
    )
    return mine(rows, F.col("vec_id") % 100 == 0)


OP12_SQL = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))::BIGINT AS score FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 5
"""
