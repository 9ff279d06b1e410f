"""A Merkle manifest of a dataset: one SHA-256 root over all rows, with proofs, as a tree of midstates.

A node is the hash of the digests of up to ``FAN`` children, written as 64 hexadecimal characters each: exactly one block
of SHA-256. So the state of the hash before a child's slot is 32 bytes, and a parent keeps a copy of it for every slot.
To fold a changed child, the matching state is resumed with the replacement and the siblings to its right only; those to
its left are never hashed again. The states are columns like any other, so a fold runs in another task, or another job,
than the one that built the tree. The compression function works on whole columns of states in numpy.

On Spark: rows are hashed where they are read (built-in functions), and only ids and digests are sorted, by ranges. They
get their places from the counts of the sorted partitions, so that a group of any size is never in one task. A level is
an aggregate of at most ``FAN`` children each; paths come down the levels by joins on unique keys, and the rows of a
lowest parent are folded together. The loop over levels runs on the driver, which sees the largest count and the root.

Defined results: a null field is written ``-``; the null group comes first, as does a null id; rows with the same id are
ordered by their digests; repeated rows count each; a group of one row has its leaf as its root; texts are hashed whole;
an empty table gives no rows; of clashing names only the named columns are read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.llm.common import cut, placed, table

FAN = 16
AT_ONCE = 512  # parents that are folded at a time

_PRIMES = [p for p in range(2, 312) if all(p % q for q in range(2, math.isqrt(p) + 1))]


def _cube_root(n: int) -> int:
    root = round(n ** (1 / 3))
    while root**3 > n:
        root -= 1
    while (root + 1) ** 3 <= n:
        root += 1
    return root


# The constants of SHA-256: 32 bits of the fractional parts of the roots of the first primes.
_START = np.array([math.isqrt(p << 64) & 0xFFFFFFFF for p in _PRIMES[:8]], np.uint32)
_ADDED = np.array([_cube_root(p << 96) & 0xFFFFFFFF for p in _PRIMES], np.uint32)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> n) | (x << (32 - n))


def compressed(states: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """SHA-256's states (8, n) after one more block (n, 64 bytes) each."""
    w = list(np.ascontiguousarray(blocks).view(">u4").astype(np.uint32).T)
    a, b, c, d, e, f, g, h = states
    for t in range(64):
        if t >= 16:
            x, y = w[t - 15], w[t - 2]
            w.append(w[t - 16] + (_turn(x, 7) ^ _turn(x, 18) ^ (x >> 3)) + w[t - 7] + (_turn(y, 17) ^ _turn(y, 19) ^ (y >> 10)))
        one = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + ((e & f) ^ (~e & g)) + _ADDED[t] + w[t]
        two = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) ^ (a & c) ^ (b & c))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return states + np.stack([a, b, c, d, e, f, g, h])


def finished(states: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Digests (n, 64 hexadecimal characters) of messages of so many whole blocks."""
    end = np.zeros((len(blocks), 64), np.uint8)
    end[:, 0] = 0x80
    end[:, 56:] = (blocks.astype(np.uint64) * 512).astype(">u8").view(np.uint8).reshape(-1, 8)
    out = compressed(states, end).T.astype(">u4").tobytes().hex().encode()
    return np.frombuffer(out, np.uint8).reshape(-1, 64)


def _more(states: np.ndarray, blocks: np.ndarray, rows: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """States after the blocks ``first`` to ``last`` - 1 of ``blocks[rows]``, each its own number of them."""
    states = states.copy()
    for step in range(int((last - first).max(initial=0))):
        own = np.flatnonzero(first + step < last)
        states[:, own] = compressed(states[:, own], blocks[rows[own], first[own] + step])
    return states


def _digests(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Lists of digests as (rows, FAN, 64 characters) and their lengths."""
    sizes = np.diff(lists.offsets.to_numpy())
    flat = np.frombuffer("".join(lists.flatten().to_pylist()).encode(), np.uint8).reshape(-1, 64)
    out = np.zeros((len(sizes), max(FAN, int(sizes.max(initial=0))), 64), np.uint8)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out, sizes


def _states(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u4").astype(np.uint32).reshape(-1, 8).T


@F.arrow_udf(T.StructType().add("digest", "string").add("states", T.ArrayType(T.BinaryType())))
def parent(children: pa.Array) -> pa.Array:
    """The digest of each list of children, and the state of the hash before each child."""
    blocks, sizes = _digests(children)
    state, kept = np.repeat(_START[:, None], len(sizes), 1), []
    for slot in range(int(sizes.max(initial=0))):
        kept.append(state)
        own = np.flatnonzero(sizes > slot)
        state = state.copy()
        state[:, own] = compressed(state[:, own], blocks[own, slot])
    digests = [d.tobytes().decode() for d in finished(state, sizes)]
    flat = [kept[s][:, i].astype(">u4").tobytes() for i, n in enumerate(sizes) for s in range(n)]
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.StructArray.from_arrays([pa.array(digests, pa.string()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.binary()))], ["digest", "states"])


PATH = "array<struct<state: binary, before: string, after: string, children: int>>"


@F.arrow_udf(T.ArrayType(T.StructType().add("folded", "string").add("proof", "string")))
def fold(children: pa.Array, replaced: pa.Array, states: pa.Array, path: pa.Array) -> pa.Array:
    """For each child the root that follows from its replacement, and the hash of all its siblings up to the root.

    ``states`` is empty for a lone child, which is its own parent; ``path`` leads from the parent to the root.
    """
    parts = []
    for at in range(0, len(children), AT_ONCE):
        some = slice(at, at + AT_ONCE)
        parts.append(_folded(*(x[some] for x in (children, replaced, states, path))))
    kind = pa.struct([("folded", pa.string()), ("proof", pa.string())])
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(kind))


def _folded(children: pa.Array, replaced: pa.Array, states: pa.Array, path: pa.Array) -> pa.Array:
    blocks, sizes = _digests(children)
    new, _ = _digests(replaced)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    slots = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    now = new[rows, slots]
    held = np.diff(states.offsets.to_numpy())[rows] > 0
    if held.any():
        state = compressed(_states(states.flatten()), now[held])
        state = _more(state, blocks, rows[held], slots[held] + 1, sizes[rows[held]])
        now[held] = finished(state, sizes[rows[held]])
    steps = path.to_pylist()
    for level in range(max(map(len, steps), default=0)):
        there = np.array([i for i, s in enumerate(steps) if len(s) > level])
        elements = [steps[i][level] for i in there]
        after = [e["after"] for e in elements]
        right, count = _digests(pa.array([[x[k : k + 64] for k in range(0, len(x), 64)] for x in after], pa.list_(pa.string())))
        place = np.full(len(sizes), -1)
        place[there] = np.arange(len(there))
        own = np.flatnonzero(place[rows] >= 0)
        of = place[rows[own]]
        state = compressed(_states(pa.array([e["state"] for e in elements], pa.binary()))[:, of], now[own])
        state = _more(state, right, of, np.zeros(len(of), int), count[of])
        now[own] = finished(state, np.array([e["children"] for e in elements])[of])
    above = ["".join(e["before"] + e["after"] for e in s).encode() for s in steps]
    proofs = []
    for row, slot in zip(rows, slots, strict=True):
        beside = blocks[row, :slot].tobytes() + blocks[row, slot + 1 : sizes[row]].tobytes()
        proofs.append(hashlib.sha256(beside + above[row]).hexdigest())
    flat = pa.StructArray.from_arrays([pa.array([x.tobytes().decode() for x in now], pa.string()), pa.array(proofs, pa.string())], ["folded", "proof"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), flat)


def leaf(fields: list[Column]) -> Column:
    """The hash of a row: each field as its length in bytes, a colon and its value, or ``-``."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def level(nodes: DataFrame) -> DataFrame:
    """(tree, at, n, kids, digest, states) above nodes (tree, at, n, digest, item), n nodes in each tree. A lone node is its own parent."""
    kids = F.sort_array(F.collect_list(F.struct("at", "digest", "item"))).alias("kids")
    grouped = nodes.groupBy("tree", F.floor(F.col("at") / FAN).alias("at"), "n").agg(kids)
    hashed = grouped.withColumn("node", parent(F.col("kids.digest")))
    alone = F.col("n") == 1
    return hashed.select("tree", "at", F.ceil(F.col("n") / FAN).alias("n"), "kids", F.when(alone, F.col("kids")[0].digest).otherwise(F.col("node.digest")).alias("digest"), F.when(alone, F.slice("node.states", 1, 0)).otherwise(F.col("node.states")).alias("states"))


def levels(nodes: DataFrame, largest: int) -> list[DataFrame]:
    """The levels above nodes of trees with at most ``largest`` of them, until each tree has one."""
    out = [cut(level(nodes))]
    while (largest := -(-largest // FAN)) > 1:
        out.append(cut(level(out[-1].where("n > 1").select("tree", "at", "n", "digest", F.lit(None).cast("int").alias("item")))))
    return out


def below(parents: DataFrame) -> DataFrame:
    """The children of parents (tree, at, kids, states, path, root): (tree, at, item, path, root)."""
    spread = parents.select("tree", "path", "root", "kids", "states", F.posexplode("kids").alias("slot", "kid"))
    joined = lambda a, n: F.array_join(F.transform(F.slice("kids", a, n), lambda k: k.digest), "")
    own = F.struct(F.get("states", F.col("slot")).alias("state"), joined(F.lit(1), F.col("slot")).alias("before"), joined(F.col("slot") + 2, F.size("kids")).alias("after"), F.size("kids").alias("children"))
    step = F.when(F.size("states") > 0, F.concat(F.array(own), F.col("path"))).otherwise(F.col("path"))
    return spread.select("tree", F.col("kid.at").alias("at"), F.col("kid.item").alias("item"), step.alias("path"), "root")


def with_paths(built: list[DataFrame], roots: DataFrame) -> DataFrame:
    """The lowest level with ``path`` and ``root``; ``roots`` (tree, path, root) has those of the trees' own roots."""
    found = None
    for nodes in reversed(built):
        own = nodes.where("n = 1").join(roots.hint("merge"), "tree")
        if found is not None:
            own = own.unionByName(nodes.where("n > 1").join(found.drop("item").hint("merge"), ["tree", "at"]))
        if nodes is not built[0]:
            found = below(own)
    return own


def manifest(rows: DataFrame, fields: list[str], key: str = "doc_id", group: str = "source", tampered: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) for each row.

    Rows of a group are the leaves of its tree, by ``key``; the groups' roots are the leaves of the last tree. A row for
    which ``where`` holds is folded with the fields of ``tampered`` in place of its own.
    """
    tampered = tampered or {}
    tree = F.struct(F.col(group).isNotNull().alias("known"), F.coalesce(F.col(group).cast("string"), F.lit("")).alias("name"))
    changed = leaf([tampered.get(f, F.col(f)) for f in fields])
    own = leaf([F.col(f) for f in fields])
    leaves = cut(rows.select(tree.alias("tree"), F.col(key).alias("key"), own.alias("digest"), F.when(where if where is not None else F.lit(False), changed).alias("replaced")))
    leaves = placed(leaves, "tree", ["key", "digest", "replaced"]).withColumnRenamed("total", "n")
    largest = leaves.agg(F.max("n")).first()[0]
    if largest is None:
        kind = rows.schema[key].dataType.simpleString()
        return rows.sparkSession.createDataFrame([], f"`{key}` {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    built = levels(leaves.select("tree", "at", "n", "digest", F.struct("key", "replaced").alias("item")), largest)

    subroots = built[0].where("n = 1").select("tree", "digest")
    for nodes in built[1:]:
        subroots = subroots.union(nodes.where("n = 1").select("tree", "digest"))
    subroots = cut(subroots)
    whole = F.struct(F.lit(True).alias("known"), F.lit("").alias("name"))
    groups = placed(subroots.select(whole.alias("tree"), F.col("tree").alias("key"), "digest"), "tree", ["key"]).withColumnRenamed("total", "n")
    top = levels(groups.select("tree", "at", "n", "digest", F.col("key").alias("item")), subroots.count())
    root = top[-1].where("n = 1").first()["digest"]  # one row

    none = F.from_json(F.lit("[]"), PATH)
    ends = top[-1].where("n = 1").select("tree", none.alias("path"), F.col("digest").alias("root"))
    of_groups = below(with_paths(top, ends)).select(F.col("item").alias("tree"), "path").join(subroots.withColumnRenamed("digest", "root").hint("merge"), "tree")
    lowest = with_paths(built, of_groups)
    replaced = F.transform("kids", lambda k: F.coalesce(k.item.replaced, k.digest))
    folded = lowest.select("kids", F.col("root").alias("subroot"), fold(F.col("kids.digest"), replaced, F.col("states"), F.col("path")).alias("found"))
    out = folded.select("subroot", F.explode(F.arrays_zip("kids", "found")).alias("z"))
    return out.select(
        F.col("z.kids.item.key").alias(key),
        F.col("z.kids.digest").alias("leaf"),
        "subroot",
        F.lit(root).alias("root"),
        F.col("z.found.proof").alias("proof_sha256"),
        F.col("z.found.folded").alias("folded_root"),
        (F.col("z.found.folded") == root).alias("verified"),
    )


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    lower = F.translate("text", UPPER, UPPER.lower())
    return manifest(docs, docs.columns, tampered={"text": lower}, where=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)


def _field(c: str) -> str:
    return f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"


_HEAD = " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars")))
_CRC = """xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::UBIGINT)),
  lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda x, z: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END))), 4294967295::UBIGINT)"""


def _up(name: str, start: str) -> str:
    return f"{name} AS ({start} UNION ALL SELECT lvl + 1, tree, pos // {FAN}, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + {FAN - 1}) // {FAN} FROM {name} WHERE n > 1 GROUP BY lvl, tree, pos // {FAN})"


def _walk(name: str, nodes: str, start: str) -> str:
    return f"""{name} AS ({start} UNION ALL SELECT num, w.lvl + 1, w.tree, w.pos // {FAN}, sha256(string_agg(CASE WHEN k.pos = w.pos THEN now ELSE k.digest END, '' ORDER BY k.pos)),
      any_value(proof) || coalesce(string_agg(k.digest, '' ORDER BY k.pos) FILTER (k.pos <> w.pos), ''), (any_value(w.n) + {FAN - 1}) // {FAN}
      FROM {name} w JOIN {nodes} k ON k.tree = w.tree AND k.lvl = w.lvl AND k.pos // {FAN} = w.pos // {FAN} WHERE w.n > 1 GROUP BY num, w.lvl, w.tree, w.pos)"""


OP13_SQL = f"""
WITH RECURSIVE h AS (SELECT doc_id, coalesce('s' || source, '') AS tree, sha256({_HEAD} || {_field("text")}) AS leaf,
    CASE WHEN {_CRC} % 5 = 0 THEN sha256({_HEAD} || {_field(f"translate(text, '{UPPER}', '{UPPER.lower()}')")}) END AS changed FROM documents),
  d AS (SELECT *, coalesce(changed, leaf) AS now, row_number() OVER (ORDER BY tree, doc_id NULLS FIRST, leaf) AS num, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM h),
  {_up("nodes", "SELECT 0 AS lvl, tree, pos, leaf AS digest, n FROM d")},
  subs AS (SELECT tree, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
  {_up("tops", "SELECT 0 AS lvl, '' AS tree, pos, subroot AS digest, n FROM subs")},
  {_walk("w1", "nodes", "SELECT num, 0 AS lvl, tree, pos, now, '' AS proof, n FROM d")},
  {_walk("w2", "tops", "SELECT num, 0 AS lvl, '' AS tree, s.pos, now, proof, s.n FROM w1 JOIN subs s ON s.tree = w1.tree WHERE w1.n = 1")}
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, w2.now AS folded_root, w2.now = root AS verified
FROM d JOIN w2 USING (num) JOIN subs s ON s.tree = d.tree JOIN (SELECT digest AS root FROM tops WHERE n = 1) ON true WHERE w2.n = 1
"""
