"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

Each shard owns ``nodes`` places on a ring of 64-bit hashes. A key belongs to the arc that ends at the next place
clockwise. A shard has a capacity; keys that reach a full shard go on clockwise to the next shard with room. With
``slack`` 0 the capacities are the counts themselves (at most one apart), so balance is exact; with more slack fewer
keys move.

The rows of one key are a group and stay together wherever the capacities let them:

1. Groups of more than a 64th of a capacity, of which there are at most 64 for each shard, are placed one by one, the
   largest first, each on the first shard clockwise that has room for all of it.
2. Smaller groups go by the place of their first row. Only counts are needed to tell where that is: the arcs (a fixed
   number) are swept clockwise, twice, with the load of each shard and the queue of rows still on their way. An arc
   keeps its first rows while its shard has room; the later ones join the queue, and a shard with room left takes from
   its front. A 32nd of each capacity stays free here, since a group at an edge isn't cut.
3. Single rows fill the shards by the same sweep. So do groups that fit nowhere as a whole (larger than any room left):
   these alone are cut, where a shard is full.

Rows are written once, without their texts, with a number; slots count by the partition that wrote them, so no window
holds more than such a partition, whatever the keys.

Defined results: a null text has no bytes and the group of the empty text; null keys are one group; repeated rows
count each; an empty table gives no rows; columns named shard or slot are replaced, others pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.llm.common import cut, table
from lumenfold.llm.neardup import name_of

BUCKETS = 512  # of the ring, to find a key's arc among a few places
SALTS = 16  # parts of an arc that are ranked by themselves


def ring(spark: SparkSession, shards: int, nodes: int) -> DataFrame:
    """One row: ``arcs``, the places on the ring in order, as (arc, pos, shard)."""
    places = spark.range(0, shards * nodes, 1, 1).select(F.xxhash64(F.lit("place"), "id").alias("pos"), F.floor(F.col("id") / nodes).cast("int").alias("shard"))
    return places.agg(F.sort_array(F.collect_list(F.struct("pos", "shard"))).alias("a")).select(
        F.transform("a", lambda x, i: F.struct(i.alias("arc"), x.pos.alias("pos"), x.shard.alias("shard"))).alias("arcs")
    )


def bucket_of(pos: Column) -> Column:
    return (F.shiftright(pos, 55) + BUCKETS // 2).cast("int")


def with_arc(keyed: DataFrame, places: DataFrame) -> DataFrame:
    """``keyed`` (with ``h``) with its arc. The lookup table has BUCKETS rows."""
    wide = places.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(BUCKETS - 1))))
    inside = F.filter("arcs", lambda a: bucket_of(a.pos) == F.col("bucket"))
    after = F.filter("arcs", lambda a: bucket_of(a.pos) > F.col("bucket"))
    lookup = wide.select("bucket", inside.alias("inside"), F.coalesce(F.get(after, F.lit(0)), F.get("arcs", F.lit(0))).arc.alias("after"))
    found = keyed.withColumn("bucket", bucket_of(F.col("h"))).join(F.broadcast(lookup), "bucket")
    return found.withColumn("arc", F.coalesce(F.get(F.filter("inside", lambda a: a.pos >= F.col("h")), F.lit(0)).arc, F.col("after"))).drop("bucket", "inside", "after")


def sweep(counts: DataFrame, places: DataFrame, caps: list[int]) -> DataFrame:
    """(arc, own, keep, own_slot, over, pieces): the first ``keep`` rows of an arc go to its shard ``own``; the others
    have the ranks from ``over`` on in the queue, of which ``pieces`` tell ranges and shards."""
    arcs = places.select(F.inline("arcs")).join(counts, "arc", "left").select(F.struct("arc", "shard", F.coalesce("n", F.lit(0)).alias("n")).alias("a"))
    held = arcs.agg(F.sort_array(F.collect_list("a")).alias("arcs"))  # one row
    laps = "concat(" + ", ".join(f"transform(arcs, a -> named_struct('lap', {lap}, 'arc', a.arc, 'shard', a.shard, 'n', bigint({n})))" for lap, n in ((1, "a.n"), (2, "0"))) + ")"
    ready = held.selectExpr(f"array({', '.join(f'{c}L' for c in caps)}) AS caps", f"{laps} AS steps")
    room = "(caps[a.shard] - acc.loads[a.shard])"
    keep = f"least(a.n, {room})"
    take = f"least(acc.queue, {room} - {keep})"
    state = "STRUCT<loads: ARRAY<BIGINT>, queue: BIGINT, gone: BIGINT, over: BIGINT, kept: ARRAY<STRUCT<arc: INT, shard: INT, keep: BIGINT, over: BIGINT, n: BIGINT>>, takes: ARRAY<STRUCT<a: BIGINT, b: BIGINT, shard: INT>>>"
    step = f"""named_struct(
        'loads', transform(acc.loads, (x, i) -> IF(i = a.shard, x + {keep} + {take}, x)),
        'queue', acc.queue - {take} + a.n - {keep},
        'gone', acc.gone + {take},
        'over', acc.over + a.n - {keep},
        'kept', IF(a.lap = 1, concat(acc.kept, array(named_struct('arc', a.arc, 'shard', a.shard, 'keep', {keep}, 'over', acc.over, 'n', a.n))), acc.kept),
        'takes', IF({take} > 0, concat(acc.takes, array(named_struct('a', acc.gone, 'b', acc.gone + {take}, 'shard', a.shard))), acc.takes))"""
    empty = f"named_struct('loads', array_repeat(0L, {len(caps)}), 'queue', 0L, 'gone', 0L, 'over', 0L, 'kept', array(), 'takes', array())"
    swept = ready.selectExpr(f"aggregate(steps, CAST({empty} AS {state}), (acc, a) -> CAST({step} AS {state})) AS s")
    arcs = swept.selectExpr("explode(s.kept) AS k", "s.takes AS takes")
    return arcs.selectExpr("k.arc", "k.shard AS own", "k.keep", "k.over", "IF(k.n > k.keep, filter(takes, t -> t.b > k.over AND t.a < k.over + k.n - k.keep), filter(takes, t -> false)) AS pieces")


def one_by_one(large: DataFrame, places: DataFrame, caps: list[int]) -> DataFrame:
    """(h, h2, shard) of few groups (h, h2, arc, n): the first shard clockwise with room for all of a group, else null."""
    held = large.groupBy().agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("less"), "h", "h2", "arc", "n"))).alias("groups"))  # one row
    owners = places.select(F.transform("arcs", lambda a: a.shard).alias("owners"))
    # two frames of one row each meet by a constant
    both = held.withColumn("one", F.lit(1)).join(F.broadcast(owners.withColumn("one", F.lit(1))), "one").selectExpr("groups", "owners", f"array({', '.join(f'{c}L' for c in caps)}) AS caps")
    at = "owners[(g.arc + i) % size(owners)]"
    first = f"filter(sequence(0, size(owners) - 1), i -> caps[{at}] - acc.loads[{at}] >= g.n)"
    shard = f"transform(slice({first}, 1, 1), i -> {at})"
    state = "STRUCT<loads: ARRAY<BIGINT>, found: ARRAY<STRUCT<h: BIGINT, h2: BIGINT, shard: INT>>>"
    step = f"""transform(array({shard}), s -> named_struct(
        'loads', transform(acc.loads, (x, i) -> IF(array_contains(s, i), x + g.n, x)),
        'found', concat(acc.found, array(named_struct('h', g.h, 'h2', g.h2, 'shard', get(s, 0))))))[0]"""
    empty = f"named_struct('loads', array_repeat(0L, {len(caps)}), 'found', array())"
    return both.selectExpr(f"inline(aggregate(groups, CAST({empty} AS {state}), (acc, g) -> CAST({step} AS {state})).found)")


def ranked(groups: DataFrame, places: DataFrame, caps: list[int]) -> DataFrame:
    """``groups`` (h, h2, arc, n) with ``start``, the place of their first row in their arc, and the law of the arc."""
    salted = groups.withColumn("salt", F.pmod(F.xxhash64("h", F.lit("salt")), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy("arc", "salt").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("arc").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("arc", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    arcs = sweep(parts.groupBy("arc").agg(F.sum("n").alias("n")), places, caps)
    law = F.broadcast(starts.join(F.broadcast(arcs), "arc"))  # at most shards * nodes * SALTS rows
    within = Window.partitionBy("arc", "salt").orderBy("h", "h2").rowsBetween(Window.unboundedPreceding, -1)
    return salted.withColumn("start", F.coalesce(F.sum("n").over(within), F.lit(0))).join(law, ["arc", "salt"]).withColumn("start", F.col("before") + F.col("start")).drop("before", "salt")


def shard_at(rank: Column) -> Column:
    """The shard of a place in an arc, by the arc's law; null beyond all room."""
    queued = F.col("over") + rank - F.col("keep")
    piece = F.get(F.filter("pieces", lambda t: (t.a <= queued) & (queued < t.b)), F.lit(0))
    return F.when(rank < F.col("keep"), F.col("own")).otherwise(piece.shard).cast("int")


def room_left(caps: list[int], placed: DataFrame) -> list[int]:
    loads = {r["shard"]: r["n"] for r in placed.where("shard IS NOT NULL").groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # a row for each shard
    return [c - loads.get(i, 0) for i, c in enumerate(caps)]


def assign(df: DataFrame, shards: int, key: str | list[str] = "doc_id", nodes: int = 64, slack: float = 0.0) -> DataFrame:
    """``df`` with ``shard`` and ``slot`` (gapless from 0 in each shard). The columns of ``df`` are stored and shuffled: select what is needed first."""
    places = ring(df.sparkSession, shards, nodes)
    names = [c for c in df.columns if c not in ("shard", "slot")]
    keys = [key] if isinstance(key, str) else key
    own = [x for c in keys for x in (F.col(c).isNull(), F.col(c))]
    rows = cut(df.select(F.xxhash64(*own).alias("h"), F.xxhash64(F.lit(5), *own).alias("h2"), F.struct(*names).alias("row"), F.monotonically_increasing_id().alias("uid")))
    rows = rows.withColumn("part", F.shiftright("uid", 33))
    groups = cut(with_arc(rows.groupBy("h", "h2").agg(F.count(F.lit(1)).alias("n")), places))
    total = groups.agg(F.sum("n")).first()[0] or 0
    caps = [total // shards + (i < total % shards) for i in range(shards)] if slack == 0 else [math.ceil(total * (1 + slack) / shards)] * shards

    few = max(1, total // (shards * 64))
    alone = cut(one_by_one(groups.where(f"n > {few} AND n <= {max(caps)}"), places, caps).join(groups, ["h", "h2"]).where("shard IS NOT NULL").select("h", "h2", "n", "shard"))
    left = room_left(caps, alone)
    rest = groups.join(F.broadcast(alone.select("h", "h2")), ["h", "h2"], "left_anti")  # at most 64 rows for each shard
    small = cut(ranked(rest.where(f"n > 1 AND n <= {few}"), places, [max(0, x - 2 * few) for x in left]).select("h", "h2", "n", shard_at(F.col("start")).alias("shard")).where("shard IS NOT NULL"))
    left = room_left(left, small)
    last = cut(ranked(rest.join(small, ["h", "h2"], "left_anti"), places, left))

    whole = alone.select("h", "h2", "shard").union(small.select("h", "h2", "shard")).union(last.where("n = 1").select("h", "h2", shard_at(F.col("start")).alias("shard")))
    placed = rows.join(cut(whole), ["h", "h2"]).select("row", "uid", "part", "shard")
    split = last.where("n > 1")
    if not split.isEmpty():  # groups that no shard can take whole
        parted = cut(rows.groupBy("h", "h2", "part").agg(F.count(F.lit(1)).alias("rows")).join(split.select("h", "h2"), ["h", "h2"]))
        before = Window.partitionBy("h", "h2").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        offsets = cut(parted.select("h", "h2", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first")).join(split, ["h", "h2"]))
        number = F.row_number().over(Window.partitionBy("h", "h2", "part").orderBy("uid")) - 1
        cut_up = rows.join(offsets, ["h", "h2", "part"]).withColumn("number", number)
        placed = placed.union(cut_up.select("row", "uid", "part", shard_at(F.col("start") + F.col("first") + F.col("number")).alias("shard")))
    placed = cut(placed)
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("rows")).select("shard", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))
    number = F.row_number().over(Window.partitionBy("shard", "part").orderBy("uid")) - 1
    numbered = placed.withColumn("number", number).join(offsets, ["shard", "part"])
    return numbered.select("row.*", "shard", (F.col("first") + F.col("number")).cast("long").alias("slot"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    t1, t2 = name_of(text)
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.lit("rows").alias("law"),
        t1.alias("t1"),
        t2.alias("t2"),
    )
    return assign(docs, 24, ["t1", "t2"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
