"""Mixing sources to target weights by fixed-length blocks.

1. Targets: the sources' weights share ``share`` times all words; a target stops at ``most`` times its source's words, and
   the excess is shared again by weight until none is above.
2. The words of a source, its documents in the order of their keys, are one stream, cut into blocks of ``block`` words;
   only the last one may be shorter. A document's place comes from prefix sums over sorted ranges.
3. The mix has slots, so many of a source as its target fills with blocks, in output shards of ``slots`` slots. Each
   shard draws its counts of the sources from a multinomial distribution with the targets' probabilities, seeded by the
   shard's number. Since the draws of all shards together miss the targets by some roots of them, the last slots of
   sources that were drawn too often go, in order, to those drawn too rarely: the totals are exact, and all but that
   small share of the slots stay as drawn.
4. The slots of a source are numbered across the shards by prefix sums. A slot's number is mapped to a block by a
   pseudorandom permutation of the source's block numbers, a new one for each turn through the source, so that no block
   comes oftener than the turns; the short block comes last in its turn. Another permutation orders a shard's slots.
5. Slots meet the pieces of documents by (source, block). The last slot of a source is cut where its target is reached.

The mixture's own table, a row for each source, is held by the driver; nothing else is.

Defined results: words are what isn't white space of ASCII; a null or empty text has none and is taken zero times; the
null source comes last in order; rows are ordered by key, then by the hash of their text, so that reruns at any
partitioning agree; repeated rows count each; without any word all targets are 0; an empty table gives no rows; other
columns pass by.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.common import cut, identity, placed, table

#: A word: what stands between white space of ASCII.
WORD = r"[^\x20\x09-\x0D]+"
_ROUNDS = 4


def targets(sizes: Sequence[int], weights: Sequence[float], share: float, most: float) -> np.ndarray:
    sizes, weights = np.asarray(sizes, float), np.asarray(weights, float)
    out, left, free = np.zeros(len(sizes)), share * sizes.sum(), np.ones(len(sizes), bool)
    while free.any():
        each = left * weights / weights[free].sum()
        above = free & (each > most * sizes)
        if not above.any():
            out[free] = each[free]
            break
        out[above] = most * sizes[above]
        left, free = left - out[above].sum(), free & ~above
    return out


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Places of ``index`` (below ``size``) in a permutation of 0 … size - 1 that ``key`` tells, all three element by element.

    A Feistel network over the next power of four, walked on until the number is below the size.
    """
    index, key = index.astype(np.uint64), _scrambled(key.astype(np.uint64))
    half = np.ceil(np.log2(np.maximum(size, 2)) / 2).astype(np.uint64)
    mask, todo, out = (np.uint64(1) << half) - np.uint64(1), np.arange(len(index)), index.copy()
    while len(todo):
        left, right, h, m = out[todo] >> half[todo], out[todo] & mask[todo], half[todo], mask[todo]
        for r in range(_ROUNDS):
            left, right = right, left ^ (_scrambled(right + key[todo] + np.uint64(r * 0x9E3779B97F4A7C15 % 2**64)) & m)
        out[todo] = left << h | right
        todo = todo[out[todo] >= size[todo]]
    return out.astype(np.int64)


@dataclass
class Plan:
    """What the driver knows of a mixture: arrays with an element for each source."""

    names: list[str | None]
    sizes: np.ndarray
    targets: np.ndarray
    block: int
    shard_slots: int
    seed: int

    def __post_init__(self):
        self.words = np.rint(self.targets).astype(np.int64)
        self.blocks = -(-self.sizes // self.block)
        turns, rest = self.words // np.maximum(self.sizes, 1), self.words % np.maximum(self.sizes, 1)
        of_rest = -(-rest // self.block)
        self.slots = turns * self.blocks + of_rest
        tail = self.sizes - (self.blocks - 1) * self.block  # words of the last block
        self.last = np.where(rest > 0, rest - (of_rest - 1) * self.block, tail)  # words of the last slot
        self.keys = np.array([zlib.crc32((n or "").encode()) + 2 * (n is None) for n in self.names], np.uint64) * np.uint64(1 << 20) + np.uint64(self.seed)

    @property
    def shards(self) -> int:
        return math.ceil(int(self.slots.sum()) / self.shard_slots)

    def size_of(self, shard: np.ndarray) -> np.ndarray:
        return np.minimum(self.shard_slots, int(self.slots.sum()) - shard * self.shard_slots)

    def draw(self, shard: int) -> np.ndarray:
        """The counts of the sources in a shard."""
        return np.random.default_rng([self.seed, shard]).multinomial(int(self.size_of(np.array(shard))), self.slots / self.slots.sum())

    def levelled(self, source: np.ndarray, number: np.ndarray, drawn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sources and numbers of slots, with those beyond a source's slots given to the sources that lack some."""
        extra, lack = np.maximum(drawn - self.slots, 0), np.maximum(self.slots - drawn, 0)
        place = (np.cumsum(extra) - extra)[source] + number - self.slots[source]
        ends = np.cumsum(lack)
        to = np.minimum(np.searchsorted(ends, place, "right"), len(lack) - 1)
        moved = number >= self.slots[source]
        return np.where(moved, to, source), np.where(moved, drawn[to] + place - (ends - lack)[to], number)

    def blocks_of(self, source: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Blocks of slots, and how many of their words are taken."""
        turn, at, full = number // self.blocks[source], number % self.blocks[source], self.sizes[source] // self.block
        whole = at < full
        block = full.copy()
        block[whole] = permuted(at[whole], full[whole], self.keys[source[whole]] + turn[whole].astype(np.uint64))
        words = np.minimum(self.block, self.sizes[source] - block * self.block)
        return block, np.where(number == self.slots[source] - 1, np.minimum(self.last[source], words), words)


@dataclass
class Mix:
    """``documents``: a row for each row of the input (key, row, t1, t2, size, source_size, target); ``spans``: the words
    that the mix takes, (shard, slot, at, source, key, row, t1, t2, first, words), ``words`` of them from the document's
    word ``first`` on, at the place ``at`` of the slot. t1 and t2 tell a row by key and text, ``row`` by number."""

    documents: DataFrame
    spans: DataFrame
    plan: Plan


def mix(rows: DataFrame, key: str = "doc_id", text: str = "text", group: str = "source", weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, block: int = 1024, slots: int = 512, seed: int = 11) -> Mix:
    spark = rows.sparkSession
    t1, t2 = identity(F.col(key), F.col(text))
    source = F.struct(F.col(group).isNull().alias("missing"), F.coalesce(F.col(group).cast("string"), F.lit("")).alias("name")).alias("source")
    sized = cut(rows.select(F.col(key).alias("key"), t1.alias("t1"), t2.alias("t2"), source, F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.monotonically_increasing_id().alias("row")))
    docs = cut(placed(sized, "source", ["key", "t1", "t2"], F.col("size")))
    found = sorted((r["missing"], r["name"].encode(), r["total"]) for r in docs.groupBy("source").agg(F.max("total").alias("total")).select("source.*", "total").collect())  # a row for each source
    names = [None if missing else name.decode() for missing, name, _ in found]
    sizes = np.array([n for *_, n in found], np.int64)
    plan = Plan(names, sizes, targets(sizes, [weights[i % len(weights)] for i in range(len(names))], share, most), block, slots, seed)
    known = [((n is None, n or ""), i, float(t)) for i, (n, t) in enumerate(zip(names, plan.targets, strict=True))]
    sources = spark.createDataFrame(known, "source struct<missing: boolean, name: string>, number int, target double")
    docs = docs.join(sources, "source").withColumnRenamed("total", "source_size")

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch["id"].to_pylist():
                counts = plan.draw(shard)
                own = np.flatnonzero(counts)
                first = (np.cumsum(counts) - counts)[own]
                yield pa.record_batch([pa.array(x, t) for x, t in ((np.full(len(own), shard), pa.int64()), (own, pa.int32()), (first, pa.int64()), (counts[own], pa.int64()))], names=["shard", "number", "first", "n"])

    draws = cut(spark.range(plan.shards).mapInArrow(draw, "shard long, number int, first long, n long"))
    drawn = np.zeros(len(names), np.int64)
    for r in draws.groupBy("number").agg(F.sum("n").alias("n")).collect():  # a row for each source
        drawn[r["number"]] = r["n"]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            shard, number, slot, at = (batch[c].to_numpy() for c in ("shard", "number", "slot", "at"))
            own, at = plan.levelled(number, at, drawn)
            chosen, words = plan.blocks_of(own, at)
            slot = permuted(slot, plan.size_of(shard), shard.astype(np.uint64) * np.uint64(2**20) + np.uint64(seed))
            yield pa.record_batch([pa.array(x, t) for x, t in ((shard, pa.int64()), (slot, pa.int64()), (own, pa.int32()), (chosen, pa.int64()), (words, pa.int64()))], names=["shard", "slot", "number", "block", "taken"])

    each = placed(draws, "number", ["shard"], F.col("n")).select("shard", "number", "first", "at", F.posexplode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("i", "j"))
    filled = each.select("shard", "number", (F.col("first") + F.col("i")).alias("slot"), (F.col("at") + F.col("i")).alias("at")).mapInArrow(fill, "shard long, slot long, number int, block long, taken long")

    pieces = docs.where("size > 0").select("*", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))).alias("block"))
    start = F.col("block") * block
    pieces = pieces.withColumn("a", F.greatest(F.col("at") - start, F.lit(0))).withColumn("b", F.least(F.col("at") + F.col("size") - start, F.lit(block))).withColumn("first", start + F.col("a") - F.col("at"))
    # both sides grow with the words, which Spark can't tell of rows from Python
    met = filled.hint("merge").join(pieces.select("number", "block", "a", "b", "first", "key", "row", "t1", "t2", "source"), ["number", "block"]).where("a < taken")
    spans = met.select("shard", "slot", F.col("a").alias("at"), F.when(~F.col("source.missing"), F.col("source.name")).alias("source"), "key", "row", "t1", "t2", "first", (F.least("b", "taken") - F.col("a")).alias("words"))
    return Mix(docs.select("key", "row", "t1", "t2", "size", "source_size", "target"), spans, plan)


def texts(rows: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(shard, slot, text): the mix itself, the words of each slot joined by blanks."""
    t1, t2 = identity(F.col(key), F.col(text))
    once = rows.select(t1.alias("t1"), t2.alias("t2"), F.col(text).alias("text")).where("text IS NOT NULL").groupBy("t1", "t2").agg(F.first("text").alias("text"))
    cut_out = spans.join(once, ["t1", "t2"]).select("shard", "slot", "at", F.concat_ws(" ", F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), (F.col("first") + 1).cast("int"), F.col("words").cast("int"))).alias("part"))
    parts = F.sort_array(F.collect_list(F.struct("at", "part")))  # of one slot: at most ``block`` words
    return cut_out.groupBy("shard", "slot").agg(F.concat_ws(" ", F.transform(parts, lambda p: p.part)).alias("text"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(table(spark, sf_dir, "documents"))
    taken = found.spans.groupBy("row").agg(F.sum("words").alias("taken"))
    return found.documents.join(taken.hint("merge"), "row", "left").select(F.col("key").alias("doc_id"), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
