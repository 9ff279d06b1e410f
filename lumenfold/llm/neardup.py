"""From candidate buckets to verified components: what the near-duplicate operators share.

Items are distinct texts, named by 128 bits of their content (``id`` and ``tag``), so that copies are one item from
the start. The items that share a bucket with another get numbers, from which on names can't collide at all.

1. Each member of a bucket is compared with the bucket's smallest member (a star; never all pairs of a bucket). Where
   texts are signed, the members that a task holds of a bucket are tied to their smallest one, and only this one is
   shuffled to the bucket: a hot bucket gets a row from each task, not one from each member.
2. Verified links form components, by union-find within tasks and star contraction between them.
3. A bucket whose members all lie in one component is done. In the others the pairs across components are verified
   too and the components joined once more. Buckets with one smallest member are taken together and their members
   dealt into blocks of bounded size, a large component into blocks of its own that don't meet each other; a task
   compares two blocks by a matrix product, so that no row is made for a pair; of the buckets that two members share,
   the one of the lowest band verifies them. So every pair that shares a bucket is either verified or already in one
   component: no link between candidates is lost.

A family of shingles is a function from texts to (hashes, how many each text has), with repeats.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import cut, stored

Family = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]

#: Members and characters of a block of a bucket, and characters of small buckets that share a task's call.
BLOCK, BLOCK_CHARS, LOT_CHARS = 1024, 1_000_000, 1_000_000
#: Characters that are signed or verified at a time, and band rows that a task holds before it ties them.
CHUNK, HELD = 400_000, 400_000
#: Texts of a chunk at most; a text's number takes the 16 high bits of a key, its shingle the 48 low ones.
TEXTS, LOW = 1 << 16, np.uint64((1 << 48) - 1)
#: Links that one task joins at last, 16 bytes each; more are joined by rounds of star contraction first.
FINISH = 500_000
#: Bytes of band rows that a task meets at a time, and of band rows for a byte of a Parquet file of texts (of lines, at
#: most); places for each partition at most.
PLACE_BYTES, BAND_BYTES, MOST_PLACES = 256 << 20, 16, 4096
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
STAR = "bucket long, id long, tag long, rid long, rtag long"


def name_of(text: Column) -> tuple[Column, Column]:
    """128 bits of a text. The seed comes first: a hash that ends with it would follow from the other one."""
    return F.xxhash64(text), F.xxhash64(F.lit(5), text)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every bit of the input reaches every bit of the result."""
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


def band_keys(minima: np.ndarray, rows: int) -> np.ndarray:
    """The bucket of each item (a row of rows * bands values) in each band; the band stands in the low bits."""
    values = minima.astype(np.uint64).reshape(len(minima), -1, rows)
    keys = np.broadcast_to(np.arange(1, values.shape[1] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), values.shape[:2]).copy()
    for i in range(rows):
        keys = mixed(keys ^ values[:, :, i]) + np.uint64(0x9E3779B97F4A7C15)
    return (keys & ~np.uint64(63) | np.arange(values.shape[1], dtype=np.uint64)).view(np.int64)


def unseen(batches, limit: int = 100_000):
    """(names, texts) of a task's items without those it has just had: a hot item is signed once in a task."""
    seen: set[int] = set()
    for batch in batches:
        ids, tags, texts = batch.column("id").to_pylist(), batch.column("tag").to_pylist(), batch.column("text")
        own, held, out = [], [], 0
        for i, x in enumerate(zip(ids, tags, strict=True)):
            if (key := x[0] << 64 ^ x[1]) not in seen:
                seen.add(key)
                text = texts[i].as_py()
                own.append(x)
                held.append(text)
                out += len(text)
                if out > CHUNK:
                    yield np.array(own, np.int64), held
                    own, held, out = [], [], 0
        if own:
            yield np.array(own, np.int64), held
        if len(seen) > limit:
            seen.clear()


def ties(bucket: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of rows whose bucket repeats, and for each that of the smallest (a, b) of its bucket."""
    order = np.argsort(bucket)
    same = np.diff(bucket[order], prepend=0, append=0) == 0
    same[[0, -1]] = False
    at = order[same[1:] | same[:-1]] if len(bucket) else order
    at = at[np.lexsort((b[at], a[at], bucket[at]))]
    new = np.diff(bucket[at], prepend=0) != 0
    new[:1] = True
    return at, at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]


def _star_batch(rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[:, i]) for i in range(5)], names=[n.split()[0] for n in STAR.split(", ")])


def _tied(parts):
    """(loose, stars) from (names, buckets of each name) parts. loose: rows (bucket, id, tag) that go to their bucket;
    stars: rows of STAR, members that are tied to the smallest name that the task holds of their bucket."""
    names, keys, held = [], [], 0

    def out():
        bucket = np.concatenate([k.reshape(-1) for k in keys])
        name = np.concatenate([np.repeat(n, k.shape[1], 0) for n, k in zip(names, keys, strict=True)])
        at, first = ties(bucket, name[:, 0], name[:, 1])
        member = at != first
        other = member & (name[at] != name[first]).any(1)
        alone = np.ones(len(bucket), bool)
        alone[at[member]] = False
        at, first = at[other], first[other]
        return np.column_stack([bucket[alone], name[alone]]), np.column_stack([bucket[at], name[at], name[first]])

    for n, k in parts:
        names.append(n)
        keys.append(k)
        held += k.size
        if held >= HELD:
            yield out()
            names, keys, held = [], [], 0
    if held:
        yield out()


def tied(parts):
    """The rows of ``_tied`` as batches of STAR, loose ones without ``rid``."""
    for loose, stars in _tied(parts):
        yield _star_batch(stars)
        none = pa.nulls(len(loose), pa.int64())
        yield pa.RecordBatch.from_arrays([*(pa.array(loose[:, i]) for i in range(3)), none, none], names=["bucket", "id", "tag", "rid", "rtag"])


def packed(parts, places: int):
    """The rows of ``_tied`` as (place, loose, stars): those of one place in one row, so that few rows are shuffled."""
    for found in _tied(parts):
        cut_up = []
        for rows, key in zip(found, (found[0][:, 0], found[1][:, 1]), strict=True):
            place = (mixed(key.view(np.uint64)) % np.uint64(places)).astype(np.int32)
            order = np.argsort(place, kind="stable")
            ends = np.searchsorted(place[order], np.arange(places + 1))
            cut_up.append([x.tobytes() for x in np.split(rows[order], ends[1:-1])])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(places, dtype=np.int32)), *(pa.array(x, pa.binary()) for x in cut_up)], names=["place", "loose", "stars"])


def _meet(batches):
    """The rows of a partition of places, which come one after the other: ties pass, the loose ones of a place are tied
    to the smallest of their bucket. One place is held at a time."""
    held, own = [], None

    def met():
        rows = np.concatenate(held)
        held.clear()
        at, first = ties(*rows.T)
        other = (rows[at, 1:] != rows[first, 1:]).any(1)
        at, first = at[other], first[other]
        for i in range(0, len(at), 100_000):
            yield _star_batch(np.concatenate([rows[at[i : i + 100_000]], rows[first[i : i + 100_000], 1:]], 1))

    for batch in batches:
        for place, loose, stars in zip(*(batch.column(c).to_pylist() for c in ("place", "loose", "stars")), strict=True):
            if place != own and held:
                yield from met()
            own = place
            held.append(np.frombuffer(loose, np.int64).reshape(-1, 3))
            if stars:
                yield _star_batch(np.frombuffer(stars, np.int64).reshape(-1, 5))
    if held:
        yield from met()


def places_for(items: DataFrame, partitions: int) -> int:
    """How many places the buckets of some texts are dealt into: a multiple of the partitions, so that the band rows of
    a place (BAND_BYTES for a byte of the texts' files, as Spark tells them) fit into PLACE_BYTES."""
    size = int(str(items._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:  # rows that Spark knows nothing of
        size = (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 3
    return partitions * max(1, min(MOST_PLACES, -(-size * BAND_BYTES // (PLACE_BYTES * partitions))))


def least_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For 0 to n - 1 the smallest of its component under the links (a, b)."""
    parent = np.arange(n)
    while len(a):
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent = up
        a, b = parent[a], parent[b]
        a, b = a[go := a != b], b[go]
    return parent


def _forest(batches, limit: int = 1_000_000):
    """The links of a task as links from each item to the smallest of its component there."""

    def reduced(a, b):
        items, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = least_roots(at[: len(a)], at[len(a) :], len(items))
        up = root != np.arange(len(items))
        return items[up], items[root[up]]

    held, n = [], 0
    for batch in batches:
        held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
        n += batch.num_rows
        if n > limit:
            held = [reduced(*map(np.concatenate, zip(*held, strict=True)))]
            n = len(held[0][0])
            limit = max(limit, 2 * n)
    if n:
        a, b = reduced(*map(np.concatenate, zip(*held, strict=True)))
        for i in range(0, len(a), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(a[i : i + 100_000]), pa.array(b[i : i + 100_000])], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(id, root) for each item with a link (a, b): the root is the smallest item of its component.

    Tasks reduce their links to forests; rounds of star contraction join these. Once the links left are few enough for
    a task, one forest ends it.
    """
    edges = cut(links.select("a", "b").mapInArrow(_forest, "a long, b long"))
    state = None
    while (n := edges.count()) > FINISH:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))  # stored, so that Spark can split a hub
        large = cut(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        edges = cut(small.where("a <> b").distinct().mapInArrow(_forest, "a long, b long").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    if n <= FINISH:
        edges = cut(edges.coalesce(1).mapInArrow(_forest, "a long, b long"))
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())


def unique_keys(texts: list[str], family: Family) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of some texts as sorted keys (number of the text, 48 bits of the hash), and where each text's begin; fewer than TEXTS of them."""
    values, sizes = family(texts)
    keys = np.repeat(np.arange(len(texts), dtype=np.uint64) << np.uint64(48), sizes) | values >> np.uint64(16)
    keys.sort()
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
    return keys, np.searchsorted(keys, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(48))


def common(keys: np.ndarray, start: np.ndarray, left: np.ndarray, right: np.ndarray, most: int = 2_000_000) -> np.ndarray:
    """How many shingles the texts left[i] and right[i] share."""
    size = np.diff(start)
    out, done, ends = np.zeros(len(left), np.int64), 0, np.cumsum(size[left] + size[right])
    while done < len(left):
        end = max(done + 1, min(int(np.searchsorted(ends, (ends[done - 1] if done else 0) + most)), done + TEXTS))
        parts = []
        for x in (left[done:end], right[done:end]):
            n = size[x]
            at = np.arange(n.sum()) + np.repeat(start[x] - np.cumsum(n) + n, n)
            parts.append(np.repeat(np.arange(end - done, dtype=np.uint64) << np.uint64(48), n) | keys[at] & LOW)
        both = np.concatenate(parts)
        both.sort()
        hit = both[1:][both[1:] == both[:-1]] >> np.uint64(48)
        out[done:end] = np.bincount(hit.astype(np.int64), minlength=end - done)
        done = end
    return out


def similar(both: np.ndarray, x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Whether sets of sizes x and y that share so much have the Jaccard similarity; empty sets have none."""
    return (both > 0) & (both >= threshold * (x + y - both))


def verified(pairs: DataFrame, family: Family, threshold: float) -> DataFrame:
    """The pairs (a, b) of (a, b, ta, tb) whose shingle sets (of the whole texts) have so large a Jaccard similarity."""

    def run(batches):
        for batch in batches:
            names, texts = [batch.column("a").to_numpy(), batch.column("b").to_numpy()], [batch.column("ta"), batch.column("tb")]
            hit, done = np.zeros(batch.num_rows, bool), 0
            while done < batch.num_rows:
                at, held, chars, end = {}, [], 0, done  # a star's centre comes many times
                places = []
                while end < batch.num_rows and chars < CHUNK and len(held) < TEXTS - 2:
                    for n, t in zip(names, texts, strict=True):
                        if (place := at.setdefault(int(n[end]), len(held))) == len(held):
                            held.append(t[end].as_py())
                            chars += len(held[-1])
                        places.append(place)
                    end += 1
                left, right = np.array(places).reshape(-1, 2).T
                keys, start = unique_keys(held, family)
                size = np.diff(start)
                hit[done:end] = similar(common(keys, start, left, right), size[left], size[right], threshold)
                done = end
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(hit)), batch.column("b").filter(pa.array(hit))], names=["a", "b"])

    return pairs.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def linked(items: DataFrame, keys: Callable, family: Family, threshold: float) -> DataFrame:
    """(id, tag, root) for the items that have a near duplicate. items: (id, tag, text), where names may repeat; keys:
    from batches of items to (names, buckets of each name)."""
    partitions = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places = places_for(items, partitions)
    bands = items.mapInArrow(lambda batches: packed(keys(batches), places), "place int, loose binary, stars binary")
    dealt = bands.repartitionById(partitions, (F.col("place") % partitions).cast("int"))
    starred = stored((dealt.sortWithinPartitions("place") if places > partitions else dealt).mapInArrow(_meet, STAR))
    reps = starred.select(F.col("rid").alias("id"), F.col("rtag").alias("tag"))
    names = starred.select("id", "tag").union(reps).distinct()
    # copies are collapsed before they are shuffled
    whole = items.groupBy("id", "tag").agg(F.first("text").alias("text"))
    texts = stored(whole.join(names, ["id", "tag"], "left_semi").withColumn("n", F.monotonically_increasing_id()))
    own = texts.select("id", "tag", F.col("n").alias("a"), F.col("text").alias("ta"))
    centre = texts.select(F.col("id").alias("rid"), F.col("tag").alias("rtag"), F.col("n").alias("b"), F.col("text").alias("tb"))
    links = cut(verified(starred.drop("bucket").distinct().join(own, ["id", "tag"]).join(centre, ["rid", "rtag"]), family, threshold))
    roots = cut(components(links))

    named = texts.select("id", "tag", "n")
    members = starred.select("bucket", "id", "tag").union(starred.select("bucket", "rid", "rtag")).distinct()
    placed = members.join(named, ["id", "tag"]).join(roots.withColumnRenamed("id", "n"), "n", "left").select("bucket", F.col("n").alias("id"), F.coalesce("root", "n").alias("c"))
    placed = stored(placed)
    open_ = cut(placed.groupBy("bucket").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count(F.lit(1)).alias("n"), F.min("id").alias("rep")).where("c0 <> c1 AND n > 2").select("bucket", "rep"))
    rest = cut(placed.join(open_, "bucket"))
    if not rest.isEmpty():
        again = cut(across(rest, texts.select(F.col("n").alias("id"), "text"), family, threshold))
        if not again.isEmpty():
            roots = cut(components(links.union(again)))
    return named.join(roots.withColumnRenamed("id", "n"), "n").select("id", "tag", "root")


def across(rest: DataFrame, texts: DataFrame, family: Family, threshold: float) -> DataFrame:
    """The verified pairs (a, b) of different components within buckets. rest: (bucket, id, c, rep); texts: (id, text)."""
    own = rest.groupBy("id").agg(F.collect_list(F.struct("bucket", "rep")).alias("buckets")).join(texts, "id")  # at most one bucket for each band
    sized = texts.select("id", F.length("text").alias("chars"))
    units = cut(rest.select("rep", "id", "c").distinct().join(sized, "id"))
    weight = F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("chars") / BLOCK_CHARS)
    # a component that fills half a block has blocks of its own, the others of a bucket share theirs
    parts = cut(units.groupBy("rep", "c").agg(weight.alias("w")).withColumn("g", F.when(F.col("w") >= 0.5, F.col("c"))))
    groups = parts.groupBy("rep", "g").agg(F.ceil(F.sum("w")).cast("int").alias("blocks"))
    layout = cut(groups.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("g", "blocks"))).alias("groups")))  # an entry for each half block at most
    base = F.aggregate(F.filter("groups", lambda x: ~x.g.eqNullSafe(F.col("g")) & (x.g.isNull() | F.coalesce(x.g < F.col("g"), F.lit(False)))), F.lit(0), lambda s, x: s + x.blocks)
    mine = F.filter("groups", lambda x: x.g.eqNullSafe(F.col("g")))[0].blocks
    total = F.aggregate("groups", F.lit(0), lambda s, x: s + x.blocks)
    placed = units.join(parts.select("rep", "c", "g"), ["rep", "c"]).join(layout, "rep").select("rep", "id", "c", "g", "chars", base.alias("base"), mine.alias("mine"), total.alias("blocks"))
    placed = placed.withColumn("block", F.col("base") + F.pmod(F.xxhash64("id"), F.col("mine")).cast("int"))
    other = F.explode(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.col("g").isNull() | (i < F.col("base")) | (i >= F.col("base") + F.col("mine"))))
    # units of one block share tasks by lots; each pair of blocks of a larger one is a task
    lots = max(1, int((placed.where("blocks = 1").agg(F.sum("chars")).first()[0] or 0) // LOT_CHARS))
    lot = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("rep"), F.lit(lots))).otherwise(F.col("rep"))
    cells = placed.select("rep", "id", "c", "blocks", "block", other.alias("other"))
    cells = cells.select("rep", "id", "c", lot.alias("lot"), (F.col("blocks") == 1).alias("small"), "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")).join(own, "id")

    def unit(rep: int, low: int, high: int, block, c, ids, buckets, texts) -> tuple[np.ndarray, np.ndarray]:
        left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
        keys, mine = np.zeros((len(ids), 64), np.int64), np.zeros((len(ids), 64), bool)
        for i, row in enumerate(buckets):
            for x in row:
                keys[i, x["bucket"] & 63] = x["bucket"]
                mine[i, x["bucket"] & 63] = x["rep"] == rep
        may, seen = np.zeros((len(left), len(right)), bool), np.zeros((len(left), len(right)), bool)
        for k in np.flatnonzero((keys != 0).any(0)):
            both = (keys[left, k][:, None] == keys[right, k]) & (keys[left, k] != 0)[:, None] & ~seen
            may |= both & mine[left, k][:, None]
            seen |= both
        may &= c[left][:, None] != c[right]
        if low == high:
            may &= np.tri(len(left), k=-1, dtype=bool)
        if not may.any():
            return ids[:0], ids[:0]
        need = np.zeros(len(ids), bool)
        need[left[may.any(1)]] = need[right[may.any(0)]] = True
        place = np.cumsum(need) - 1
        shingles, start = unique_keys([texts[i] for i in np.flatnonzero(need)], family)
        a, b = np.nonzero(may)
        a, b = left[a], right[b]
        met = common(shingles, start, place[a], place[b]) if len(a) < 4 * len(ids) else shared(shingles, start, place[a], place[b])
        size = np.diff(start)
        hit = similar(met, size[place[a]], size[place[b]], threshold)
        return ids[a[hit]], ids[b[hit]]

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("rep")
        reps, low, high = rows.column("rep").to_numpy(), rows.column("low")[0].as_py(), rows.column("high")[0].as_py()
        block, c, ids = (rows.column(x).to_numpy() for x in ("block", "c", "id"))
        starts = [*np.flatnonzero(np.concatenate([[True], np.diff(reps) != 0])), len(reps)]
        out = []
        for a, b in zip(starts, starts[1:], strict=False):
            part = rows.slice(a, b - a)
            out.append(unit(int(reps[a]), low, high, block[a:b], c[a:b], ids[a:b], part.column("buckets").to_pylist(), part.column("text").to_pylist()))
        return pa.table([pa.array(np.concatenate([x[i] for x in out])) for i in (0, 1)], names=["a", "b"])

    return cells.groupBy("lot", "small", "low", "high").applyInArrow(run, "a long, b long")


def shared(keys: np.ndarray, start: np.ndarray, a: np.ndarray, b: np.ndarray, columns: int = 2048) -> np.ndarray:
    """What ``common`` gives, for many pairs of few texts: by a matrix product of texts and shingles."""
    n = len(start) - 1
    item, order = (keys >> np.uint64(48)).astype(np.int64), np.argsort(keys & LOW, kind="stable")
    value, item = (keys & LOW)[order], item[order]
    often = np.diff(value, prepend=value[:1] - np.uint64(1)) == 0
    often[:-1] |= often[1:]  # of several texts
    item, value = item[often], value[often]
    at = np.cumsum(np.diff(value, prepend=value[:1]) != 0)
    both = np.zeros((n, n), np.float32)
    for first in range(0, int(at[-1]) + 1 if len(at) else 0, columns):
        i, j = np.searchsorted(at, [first, first + columns])
        x = np.zeros((n, columns), np.float32)
        x[item[i:j], at[i:j] - first] = 1
        both += x @ x.T
    return both[a, b].astype(np.int64)
