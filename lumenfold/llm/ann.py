"""Nearest neighbours by inner product through collision counting on single projections.

Largest inner products become smallest distances: each vector gets one more component that brings it to the largest
norm, each query is scaled to that norm. A block of vectors keeps, for each of ``projections`` random lines, the order
of its vectors' projections. A query opens a window around its own projection on every line, found by bisection, and
counts for each vector the windows that hold it. Windows widen by a constant factor (virtual rehashing) until enough
vectors lie in at least ``threshold`` of them. Those are verified by their inner product in double precision, the ones
with most collisions first: the threshold rises to what lets enough through.

Enough are 5 k and ``verify`` times the root of the number of rows, over all blocks together, so that the share that is
verified falls as a table grows and doesn't depend on how it is dealt into blocks.

Rows and queries are dealt into blocks of bounded size, every block of queries meets every block of rows in a task of
its own, and a window keeps the k best of each query (Spark cuts each block's list before the shuffle).

Defined results: vectors that are null, zero, hold null or non-finite components, have no id, or are shorter than the
longest, take no part; rows with the query's id count as its own; a repeated query id asks once for each of its
vectors and gets the k best of all; equal scores go by the smaller id; with fewer than k candidates all are returned;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.llm.common import table

#: Rows of a block (their ranks take 16 bits) and queries of one.
BLOCK, QUERIES = 8192, 32_768
WIDEN, FIRST = 1.5, 1.1  # of the windows; FIRST in standard deviations of a projection
#: Queries that are counted at a time.
AT_ONCE = 32


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


class Lines:
    """A block of vectors with their ranks on each of the projections."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, largest: float, projections: int):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors, self.largest = ids[order], vectors[order], largest
        self.lines = np.random.default_rng(17).standard_normal((vectors.shape[1] + 1, projections))
        rest = np.sqrt(np.maximum(largest**2 - (self.vectors**2).sum(1), 0))
        found = (np.concatenate([self.vectors, rest[:, None]], 1) @ self.lines).T.astype(np.float32)
        self.spread = found.std(1) + 1e-12
        self.ranks = np.empty(found.shape, np.uint16)
        for own, ranks in zip(found, self.ranks, strict=True):
            order = np.argsort(own, kind="stable")
            ranks[order] = np.arange(len(order), dtype=np.uint16)
            own.sort()
        self.sorted = found

    def counted(self, at: np.ndarray, width: float) -> np.ndarray:
        """For queries with projections ``at`` how many windows hold each vector."""
        half = width * self.spread
        low, high = (np.stack([np.searchsorted(s, x, side) for s, x in zip(self.sorted, (at + sign * half).T.astype(np.float32), strict=True)]) for sign, side in ((-1, "left"), (1, "right")))
        shape = (len(at), len(self.ids))
        counts, some, moved, inside = np.zeros(shape, np.uint16), np.zeros(shape, np.uint8), np.empty(shape, np.uint16), np.empty(shape, bool)
        for i, (ranks, a, b) in enumerate(zip(self.ranks, low, high, strict=True), 1):
            np.subtract(ranks, a.astype(np.uint16)[:, None], out=moved)  # ranks below wrap round
            np.less(moved, (b - a).astype(np.uint16)[:, None], out=inside)
            some += inside.view(np.uint8)
            if i % 255 == 0 or i == len(self.ranks):
                counts += some
                some[:] = 0
        return counts

    def candidates(self, queries: np.ndarray, need: int, threshold: float):
        """(query, places of the vectors to verify) for each query."""
        n, enough = len(self.ids), max(1, math.ceil(threshold * len(self.ranks)))
        at = (queries * (self.largest / np.linalg.norm(queries, axis=1))[:, None]) @ self.lines[:-1]
        need = min(n, need)
        for first in range(0, len(queries), AT_ONCE):
            open_, width = np.arange(first, min(first + AT_ONCE, len(queries))), FIRST
            while len(open_):
                counts, still = self.counted(at[open_], width), []
                for q, own in zip(open_, counts, strict=True):
                    level = np.partition(own, n - need)[n - need]
                    if level >= enough:
                        yield q, np.flatnonzero(own >= level)
                    else:
                        still.append(q)
                open_, width = np.array(still, int), width * WIDEN

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int, need: int, threshold: float):
        """(query id, ids, scores) of the k nearest for each query."""
        for q, found in self.candidates(queries, max(need, k + 1), threshold):
            found = found[self.ids[found] != ids[q]]
            scores = self.vectors[found] @ queries[q]
            if len(found) > k:
                top = scores >= np.partition(scores, len(scores) - k)[-k]
                found, scores = found[top], scores[top]
            best = np.lexsort((self.ids[found], -scores))[:k]
            yield ids[q], self.ids[found[best]], scores[best]


def nearest(rows: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", projections: int = 256, threshold: float = 0.5, verify: float = 6.0, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows found for each query."""
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)

    def usable(df: DataFrame) -> DataFrame:
        found = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
        return found.withColumn("norm", norm).where("norm > 0 AND norm < double('infinity')")  # a null component makes it null, a NaN isn't below infinity

    rows, queries = usable(rows), usable(queries)
    n, largest, size = rows.agg(F.count(F.lit(1)), F.max("norm"), F.max(F.size("v"))).first()
    asked = queries.count()
    if not n or not asked:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows, queries = rows.where(F.size("v") == size), queries.where(F.size("v") == size)
    of_rows, of_queries = math.ceil(n / block), math.ceil(asked / QUERIES)
    wanted = 5 * k + verify * math.sqrt(n)

    def dealt(df: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
        return df.select("id", "v", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other))

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            if left.num_rows > 65_535:
                raise ValueError("a block has 65,535 rows at most")
            lines = Lines(left.column("id").to_numpy(), matrix(left.column("v")), math.sqrt(largest), projections)
            ids, vectors = right.column("id").to_numpy(), matrix(right.column("v"))
            out += lines.search(ids, vectors, k, math.ceil(wanted * left.num_rows / n), threshold)
        columns = [np.concatenate([np.full(len(i), q) for q, i, _ in out] or [np.zeros(0)]).astype(np.int64), np.concatenate([i for _, i, _ in out] or [np.zeros(0)]).astype(np.int64), np.concatenate([s for _, _, s in out] or [np.zeros(0)])]
        return pa.table(columns, names=["query_id", "vec_id", "score"])

    left = dealt(rows, "of_rows", of_rows, "of_queries", of_queries).groupBy("of_rows", "of_queries")
    right = dealt(queries, "of_queries", of_queries, "of_rows", of_rows).groupBy("of_rows", "of_queries")
    found = left.cogroup(right).applyInArrow(cell, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where("vec_id % 20 = 0"), 20)
