"""MinHash near-deduplication with ProbMinHash.

Every five-word shingle of the whole text is a Poisson process whose rate is its weight: arrivals are drawn from its
hash, each arrival lands in a random place of the signature, a place keeps the shingle that came first, and a shingle
stops once its time is beyond the latest first arrival of the document. Two documents agree in a place with a
probability equal to the probability Jaccard similarity of their weights. Links are defined on shingle sets, so all
shingles weigh the same here, however often they stand: then that is the plain Jaccard similarity. Signatures are cut
into bands, and candidates are verified by the exact Jaccard similarity of their shingle sets (see ``neardup``).

Defined results: texts without a word are near duplicates of equal texts only (null counts as empty); texts of fewer
than five words have one shingle of all their words; of a class the row with the smallest id stays, a null id last;
of repeated rows one stays; an empty table gives no rows; other columns are ignored unless named in ``carry``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.common import cut, identity, split_repeats, table
from lumenfold.llm.neardup import STAR, band_keys, linked, mixed, name_of, tied, unseen

WORDS, THRESHOLD = 5, 0.8
#: A pair at the threshold meets in some band with probability 1 - (1 - 0.8 ** 7) ** 30 = 0.999.
ROWS, BANDS = 7, 30
PRIME = np.uint64(0x100000001B3)
INVERSE = np.uint64(pow(0x100000001B3, -1, 1 << 64))
STEP = np.uint64(0x9E3779B97F4A7C15)
WHOLE = (1 << 64) - 1
#: Bytes of words: ASCII letters and digits, and all of other scripts.
IN_WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def word_hashes(text: str) -> np.ndarray:
    """A hash of each word of a text, from prefix sums of a polynomial."""
    data = np.frombuffer(text.lower().encode(), np.uint8)
    inside = IN_WORD[data]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    total = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(PRIME, len(data)))])
    return mixed((total[end] - total[start]) * powers(INVERSE, len(data))[start] + (end - start).astype(np.uint64))


def all_shingles(text: str) -> np.ndarray:
    """The hash of each run of five words, in order, with repeats."""
    words = word_hashes(text)
    if not len(words):
        return words
    n = max(1, len(words) - WORDS + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(WORDS, len(words))):
        out = mixed(out + STEP) + words[i : i + n]
    return mixed(out)


def shingles(text: str) -> np.ndarray:
    return np.unique(all_shingles(text))


def family(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of all texts, one after the other, and how many each has."""
    found = [all_shingles(x) for x in texts]
    return np.concatenate([np.zeros(0, np.uint64), *found]), np.fromiter(map(len, found), np.int64, len(found))


def first_arrivals(sets: list[np.ndarray], weights: list[np.ndarray], places: int) -> np.ndarray:
    """The ProbMinHash signatures (a row of ``places`` hashes each) of non-empty sets of weighted hashes."""
    item = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    own, rate = np.concatenate(sets), np.concatenate(weights)
    time, turn = np.zeros(len(own)), 0
    latest = np.full(len(sets) * places, np.inf)
    out = np.zeros(len(sets) * places, np.uint64)
    while len(own):
        turn = turn + int(STEP) & WHOLE
        draw = mixed(own + np.uint64(turn))
        # 53 bits give the waiting time, another draw the place
        time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / rate
        at = item * places + ((mixed(draw) >> np.uint64(32)) * np.uint64(places) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(latest, at, time)
        won = latest[at] == time
        out[at[won]] = own[won]
        go = time < latest.reshape(-1, places).max(1)[item]
        item, own, rate, time = item[go], own[go], rate[go], time[go]
    return out.reshape(-1, places)


def signatures(rows: int = ROWS, bands: int = BANDS):
    """From batches of (id, tag, text) to (names, buckets of each name)."""

    def keys(batches):
        for names, texts in unseen(batches):
            sets = [shingles(x) for x in texts]
            some = np.array([len(h) > 0 for h in sets])
            sets, names, at = [x for x in sets if len(x)], names[some], 0
            # few enough at a time for their signatures and shingles to stay in cache
            while at < len(sets):
                end, held = at, 0
                while end < len(sets) and (held < 60_000 or end == at):
                    held += len(sets[end])
                    end += 1
                minima = first_arrivals(sets[at:end], [np.ones(len(h)) for h in sets[at:end]], rows * bands)
                yield names[at:end], band_keys(minima, rows)
                at = end

    return keys


def signed(items: DataFrame, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """The buckets of each text of (id, tag, text), in rows of ``neardup.tied``; without a tag the id is the name."""
    items = items if "tag" in items.columns else items.withColumn("tag", F.lit(0).cast("long"))
    keys = signatures(rows, bands)
    return items.mapInArrow(lambda batches: tied(keys(batches)), STAR)


def near_classes(df: DataFrame, text: str = "text", key: str = "doc_id", carry: tuple[str, ...] = (), threshold: float = THRESHOLD, with_identity: bool = False) -> DataFrame:
    """(key, *carry, class_id, class_size, kept) for each row; class_id is the key of the row that stays."""
    whole = F.coalesce(F.col(text), F.lit(""))
    id_, tag = (c.alias(n) for c, n in zip(name_of(whole), ("id", "tag"), strict=True))
    d1, d2 = (c.alias(n) for c, n in zip(identity(F.col(key), F.col(text)), ("d1", "d2"), strict=True))
    # written once: the numbers of rows must be the same wherever they are used
    rows = cut(df.select(F.col(key).alias("own_key"), *(F.col(c).alias(f"own_{c}") for c in carry), id_, tag, d1, d2, F.monotonically_increasing_id().alias("uid")))
    items = df.select(id_, tag, whole.alias("text"))
    roots = linked(items, signatures(), family, threshold)
    # an item with near duplicates is named by its root, any other by itself
    placed = rows.join(roots, ["id", "tag"], "left").withColumn("g2", F.when(F.col("root").isNull(), F.col("tag")).otherwise(0)).withColumn("g1", F.coalesce("root", "id"))
    order = F.struct(F.col("own_key").isNull().alias("none"), F.col("own_key").alias("key"), F.col("uid").alias("uid"))
    classes = cut(placed.groupBy("g1", "g2").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))  # stored, so that Spark can split a hot class
    return placed.join(classes, ["g1", "g2"], "left").select(
        *(["d1", "d2"] if with_identity else []),
        F.col("own_key").alias(key),
        *(F.col(f"own_{c}").alias(c) for c in carry),
        F.when(F.col("n").isNull(), F.col("own_key")).otherwise(F.col("first.key")).alias("class_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("class_size"),
        (F.col("n").isNull() | (F.col("uid") == F.col("first.uid"))).alias("kept"),
    )


def keep_one(df: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df`` that stay: one of each class. They are found by their id and text; of rows alike in both one stays."""
    kept = near_classes(df, text, key, threshold=threshold, with_identity=True).where("kept").select(F.col("d1").alias("_d1"), F.col("d2").alias("_d2"))
    d1, d2 = identity(F.col(key), F.col(text))
    once, _ = split_repeats(df.withColumns({"_d1": d1, "_d2": d2}), ["_d1", "_d2"])
    return once.join(kept, ["_d1", "_d2"], "left_semi").select(df.columns)


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))
