"""Exact deduplication through a cuckoo-filter index of live digests.

Each row becomes a 32-byte digest of its whole text. An index keeps, for the digests that are live, a 16-bit
fingerprint in one of two buckets (partial-key cuckoo hashing) and beside it the place of the whole digest; a hit on
a fingerprint is verified against the digest stored there. When rows keep being kicked around, the index doubles and
is filled again from its stored keys. A row with a larger id than the live one of its digest takes its place: the
live entry is deleted and the new one inserted.

Rows meet twice: first each scan task runs its rows through an index of its own, which collapses a hot text to a row
for each task; then rows are shuffled by digest (no texts move), into as many tasks as the count of rows asks for, and
each task indexes its share: INDEX_ROWS or so. A join brings the result back to all rows.

Defined results: a null text equals the empty one; of rows with equal text the largest id stays, a null id before
none; of repeated rows with that id exactly one stays; an empty table gives no rows; ids are integers (another type is
cast to one, or fails); other columns are ignored unless they are named in ``carry``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.common import cut, table

SLOTS, KICKS, LOAD = 4, 200, 0.9
#: Digests that a task indexes after the shuffle, some 100 bytes each.
INDEX_ROWS = 2_000_000
LEAST = -(1 << 63)


class CuckooIndex:
    """Digests are rows of four 64-bit words. Places of deleted keys are used again."""

    def __init__(self, buckets: int = 1024):
        self.keys = np.zeros((SLOTS * buckets, 4), np.uint64)
        self.values = np.zeros((SLOTS * buckets, 3), np.int64)
        self.live = np.zeros(SLOTS * buckets, bool)
        self.used, self.free = 0, np.zeros(0, np.int64)
        self._empty(buckets)

    def __len__(self) -> int:
        return int(self.live.sum())

    def _empty(self, buckets: int) -> None:
        self.mask = np.uint64(buckets - 1)
        self.prints = np.zeros((buckets, SLOTS), np.uint16)
        self.places = np.zeros((buckets, SLOTS), np.int64)

    def _print(self, digests: np.ndarray) -> np.ndarray:
        return np.maximum(digests[:, 0] & np.uint64(0xFFFF), np.uint64(1)).astype(np.uint16)

    def _other(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        return (bucket ^ (prints.astype(np.uint64) * np.uint64(0x5BD1E995))) & self.mask

    def find(self, digests: np.ndarray) -> np.ndarray:
        """The places of the digests that are live, else -1."""
        prints, first = self._print(digests), digests[:, 1] & self.mask
        found = np.full(len(digests), -1)
        for bucket in (first, self._other(first, prints)):
            for slot in range(SLOTS):
                hit = np.flatnonzero((self.prints[bucket, slot] == prints) & (found < 0))
                place = self.places[bucket[hit], slot]
                true = self.live[place] & (self.keys[place] == digests[hit]).all(1)  # a fingerprint alone may be another digest's
                found[hit[true]] = place[true]
        return found

    def insert(self, digests: np.ndarray, values: np.ndarray) -> None:
        """Distinct digests that are not live."""
        again = self.free[: len(digests)]
        self.free = self.free[len(again) :]
        fresh = len(digests) - len(again)
        while self.used + fresh > len(self.keys):
            self.keys, self.values, self.live = (np.concatenate([x, np.zeros_like(x)]) for x in (self.keys, self.values, self.live))
        at = np.concatenate([again, np.arange(self.used, self.used + fresh)])
        self.used += fresh
        self.keys[at], self.values[at], self.live[at] = digests, values, True
        if len(self) > LOAD * self.prints.size or not self._place(at):
            self._resize()

    def delete(self, places: np.ndarray) -> None:
        """Takes live digests, by their places, out of the index."""
        digests = self.keys[places]
        prints, first = self._print(digests), digests[:, 1] & self.mask
        for bucket in (first, self._other(first, prints)):
            for slot in range(SLOTS):
                own = (self.prints[bucket, slot] != 0) & (self.places[bucket, slot] == places)
                self.prints[bucket[own], slot] = 0
        self.live[places] = False
        self.free = np.concatenate([self.free, places])

    def _resize(self) -> None:
        buckets = len(self.prints)
        while True:
            buckets *= 2
            self._empty(buckets)
            if self._place(np.flatnonzero(self.live)):
                return

    def _place(self, at: np.ndarray) -> bool:
        """Puts fingerprints of stored keys into buckets, one key for each bucket in a round; False if some stay out."""
        prints, bucket = self._print(self.keys[at]), self.keys[at][:, 1] & self.mask
        for turn in range(KICKS):
            for again in (False, True):
                if not len(at):
                    return True
                if again:
                    bucket = self._other(bucket, prints)
                chosen = np.unique(bucket, return_index=True)[1]
                space = self.prints[bucket[chosen]] == 0
                chosen, space = chosen[space.any(1)], space[space.any(1)]
                self.prints[bucket[chosen], space.argmax(1)] = prints[chosen]
                self.places[bucket[chosen], space.argmax(1)] = at[chosen]
                rest = np.ones(len(at), bool)
                rest[chosen] = False
                at, prints, bucket = at[rest], prints[rest], bucket[rest]
            full = (self.prints[bucket] != 0).all(1)
            chosen = np.unique(bucket, return_index=True)[1]
            chosen = chosen[full[chosen]]
            if len(chosen):  # the newcomer takes a slot and its holder moves on to its other bucket
                slot, where = (turn + chosen) % SLOTS, bucket[chosen]
                for x, own in ((self.prints, prints), (self.places, at)):
                    out = x[where, slot].copy()
                    x[where, slot] = own[chosen]
                    own[chosen] = out
                bucket[chosen] = self._other(where, prints[chosen])
        return not len(at)

    def take(self, digests: np.ndarray, ids: np.ndarray, uids: np.ndarray, counts: np.ndarray) -> None:
        """Rows of any digests: counts add up, and the largest (id, uid) becomes the live row of its digest."""
        order = np.lexsort((uids, ids, *digests.T))
        digests, ids, uids, counts = digests[order], ids[order], uids[order], counts[order]
        new = np.concatenate([[True], (digests[1:] != digests[:-1]).any(1)])
        last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(new) - 1]])
        n = np.add.reduceat(counts, np.flatnonzero(new))
        digests, values = digests[last], np.stack([ids[last], uids[last], n], 1)
        place = self.find(digests)
        hit = place >= 0
        held = self.values[place[hit]]
        values[hit, 2] += held[:, 2]
        larger = (values[hit, 0] > held[:, 0]) | ((values[hit, 0] == held[:, 0]) & (values[hit, 1] > held[:, 1]))
        self.values[place[hit][~larger], 2] = values[hit][~larger, 2]
        self.delete(place[hit][larger])
        put = ~hit
        put[np.flatnonzero(hit)[larger]] = True
        if put.any():
            self.insert(digests[put], values[put])


LIVE = "digest binary, keep_id long, keep_uid long, group_size long"


def _index(batches):
    """(digest, id, uid, n) rows to the live row of each digest."""
    index = CuckooIndex()
    for batch in batches:
        if batch.num_rows:
            raw = b"".join(batch.column("digest").to_pylist())
            index.take(np.frombuffer(raw, ">u8").astype(np.uint64).reshape(-1, 4), *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("keep_id", "keep_uid", "group_size")))
    at = np.flatnonzero(index.live)
    for part in np.array_split(at, max(1, len(at) // 10_000)):
        if len(part):
            raw = index.keys[part].astype(">u8").tobytes()
            digests = pa.Array.from_buffers(pa.binary(32), len(part), [None, pa.py_buffer(raw)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([digests, *(pa.array(index.values[part, i]) for i in range(3))], names=["digest", "keep_id", "keep_uid", "group_size"])


def mark_copies(df: DataFrame, text: str = "text", key: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, *carry, keep_id, group_size, kept, digest) for each row."""
    # written once, without texts: the numbers of rows must be the same wherever they are used
    rows = cut(df.select(key, *carry, F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("digest"), F.monotonically_increasing_id().alias("uid")))
    single = rows.select("digest", F.coalesce(F.col(key).cast("long"), F.lit(LEAST)).alias("keep_id"), F.col("uid").alias("keep_uid"), F.lit(1).cast("long").alias("group_size"))
    local = single.mapInArrow(_index, LIVE)
    shuffled = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = math.ceil(rows.count() / INDEX_ROWS)  # of rows without texts
    dealt = local.repartition("digest") if wanted <= shuffled else local.repartition(wanted, "digest")
    live = dealt.mapInArrow(_index, LIVE)
    return rows.join(live, "digest").select(
        key,
        *carry,
        F.nullif("keep_id", F.lit(LEAST)).alias("keep_id"),
        "group_size",
        (F.col("uid") == F.col("keep_uid")).alias("kept"),
        "digest",
    )


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mark_copies(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP9_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
