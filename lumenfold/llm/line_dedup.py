"""Fuzzy line deduplication by MinHash.

Lines are compared without regard to case and runs of white space. The signature of a line is the least of each of
56 permutations of its eight-character shingles; bands of four give the candidates; exact Jaccard similarity of the
shingle sets verifies them; union-find over the links gives components (see ``neardup``). Copies are one item. Of
each component the first occurrence, by id of the document and place in it, stays.

Documents are told apart by 128 bits of their id and text, never by their place in the table: each pass over the
table finds the same ones however it is partitioned.

Defined results: lines of white space only are not compared and stay; lines shorter than a shingle are one shingle;
a null text stays null; a document that loses all its lines has an empty text; rows without id come last; of rows
with one id and different texts the first is told by a hash; of rows with one id and one text one keeps its lines and
the others lose all but blank ones; an empty table gives no rows; other columns pass through (text and n_chars, if
there, are those of the lines left; n_lines and n_dropped are replaced).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.common import cut, identity, split_repeats, stored, table
from lumenfold.llm.neardup import band_keys, linked, mixed, name_of, unseen

WIDTH, THRESHOLD = 8, 0.8
#: A pair at the threshold meets in some band with probability 1 - (1 - 0.8 ** 4) ** 14 = 0.9994.
ROWS, BANDS = 4, 14
#: A line of these only is blank.
BLANKS = " \t\x0b\f\r"
BASE = 0x9E3779B97F4A7C15


def plain(line: str) -> str:
    return " ".join(line.lower().split()).ljust(WIDTH, "\0")


def rolled(chars: np.ndarray) -> np.ndarray:
    """The hash of every run of eight characters, by doubling."""
    x, base, width = chars.astype(np.uint64) + np.uint64(1), BASE, 1
    while width < WIDTH:
        x = x[:-width] * np.uint64(base) + x[width:]
        base, width = base * base & (1 << 64) - 1, width * 2
    return mixed(x)


def shingles(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the shingles of all lines, one after the other, and how many each has."""
    lines = [plain(x) for x in lines]
    every = rolled(np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)) if lines else np.zeros(0, np.uint64)
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    ends = np.cumsum(sizes)
    inside = np.ones(len(every), bool)
    for i in range(1, WIDTH):
        inside[ends[:-1] - i] = False  # runs that reach into the next line
    return every[inside], sizes - WIDTH + 1


def signatures(rows: int = ROWS, bands: int = BANDS):
    """From batches of (id, tag, text) to (names, buckets of each name)."""
    draw = np.random.default_rng(29)
    factors = draw.integers(0, 1 << 31, rows * bands, np.uint32) * np.uint32(2) + np.uint32(1)
    shifts = draw.integers(0, 1 << 32, rows * bands, np.uint32)

    def keys(batches):
        for names, texts in unseen(batches):
            hashes, sizes = shingles(texts)
            hashes = (hashes >> np.uint64(32)).astype(np.uint32)
            starts = np.cumsum(sizes) - sizes
            minima, moved = np.empty((len(factors), len(texts)), np.uint32), np.empty_like(hashes)
            for j, (a, b) in enumerate(zip(factors, shifts, strict=True)):
                np.multiply(hashes, a, out=moved)
                np.add(moved, b, out=moved)
                np.minimum.reduceat(moved, starts, out=minima[j])
            yield names, band_keys(minima.T, rows)

    return keys


def dedup_lines(df: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD, prefix: str = "") -> DataFrame:
    """``df`` with the lines that stay in ``text``, and ``n_lines`` and ``n_dropped``."""
    n_lines, n_dropped = prefix + "n_lines", prefix + "n_dropped"
    names = [c for c in df.columns if c not in (n_lines, n_dropped)]
    d1, d2 = identity(F.col(key), F.col(text))
    lines = df.select(F.col(key).alias("key"), F.col(text).alias("whole"), d1.alias("d1"), d2.alias("d2"))
    id_, tag = name_of(F.col("text"))
    lines = lines.select("key", "d1", "d2", F.posexplode(F.split("whole", "\n")).alias("pos", "text")).where(F.ltrim("text", F.lit(BLANKS)) != "")
    lines = lines.select("key", "d1", "d2", "pos", id_.alias("id"), tag.alias("tag"), "text")
    items = lines.select("id", "tag", "text")
    roots = linked(items, signatures(), shingles, threshold)

    # a line with near duplicates is named by its root, any other by itself
    occurrences = lines.drop("text").join(roots.hint("shuffle_hash"), ["id", "tag"], "left")
    occurrences = stored(occurrences.select("key", "d1", "d2", "pos", F.coalesce("root", "id").alias("g1"), F.when(F.col("root").isNull(), F.col("tag")).otherwise(0).alias("g2")))
    order = F.struct(F.col("key").isNull().alias("none"), "key", "d1", "d2", "pos")
    first = occurrences.groupBy("g1", "g2").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = cut(first.select("g1", "g2", F.col("first.d1").alias("f1"), F.col("first.d2").alias("f2"), F.col("first.pos").alias("p")))  # stored, so that Spark can split a hot line
    repeated = occurrences.select("d1", "d2", "pos", "g1", "g2").join(first.hint("shuffle_hash"), ["g1", "g2"])
    dropped = cut(repeated.where("d1 <> f1 OR d2 <> f2 OR pos <> p").groupBy("d1", "d2").agg(F.collect_set("pos").alias("drop")))

    once, later = split_repeats(df.select(F.struct(*names).alias("doc"), d1.alias("d1"), d2.alias("d2")), ["d1", "d2"])
    found = once.join(dropped.hint("shuffle_hash"), ["d1", "d2"], "left").select("doc", F.split(f"doc.{text}", "\n").alias("parts"), F.coalesce("drop", F.array().cast("array<int>")).alias("drop"))
    if later is not None:
        blank: Column = F.filter(F.sequence(F.lit(0), F.size("parts") - 1), lambda i: F.ltrim(F.get(F.col("parts"), i), F.lit(BLANKS)) != "")
        found = found.union(later.select("doc", F.split(f"doc.{text}", "\n").alias("parts")).select("doc", "parts", F.coalesce(blank, F.array().cast("array<int>")).alias("drop")))
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), "drop"), lambda i: F.get(F.col("parts"), i))
    field = F.when(F.size("drop") > 0, F.array_join(left, "\n")).otherwise(F.col(f"doc.{text}"))
    found = found.select("doc", "parts", "drop", field.alias("left"))
    new = {text: F.col("left"), **({"n_chars": F.length("left").cast("long")} if "n_chars" in names else {})}
    return found.select(
        *(new.get(c, F.col(f"doc.{c}")).alias(c) for c in names),
        F.when(F.col("parts").isNull(), 0).otherwise(F.size("parts")).alias(n_lines),
        F.size("drop").alias(n_dropped),
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))
