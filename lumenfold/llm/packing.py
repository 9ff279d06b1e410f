"""Packing token streams: concatenate and cut.

Pass one encodes each text once, in scan order and some 16 MB at a time, and writes its ids (16 bits each) with its place: the number of its
partition and the tokens before it there. The token totals of the partitions (one row for each partition) give, by a
prefix sum, the tokens before each partition. Pass two adds both to a global offset and cuts each document where a
window of fixed length ends; a document that crosses such a boundary, or that of a partition, yields a piece on each
side. All sequences but the last are full. No text or token is shuffled.

Defined results: a null or empty text is the end mark alone; repeated rows are packed as often as they stand there;
an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.llm.bpe import by_size, default_path, encoder
from lumenfold.llm.common import cut, table

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"


def tokens(df: DataFrame, text: str, key: str, path: str, end_id: int) -> DataFrame:
    """(key, part, before, n, ids): ids as little-endian 16 bits with the end mark, before = tokens before it in its partition."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        bpe, part, before = encoder(path), TaskContext.get().partitionId(), 0
        for rows in by_size(batches, text):
            offsets, ids = bpe.encode_many(rows.column(text), end_id)
            held = pa.Array.from_buffers(pa.binary(), rows.num_rows, [None, pa.py_buffer((offsets * 2).astype(np.int32)), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays(
                [rows.column(key), pa.array(np.full(rows.num_rows, part)), pa.array(before + offsets[:-1]), pa.array(np.diff(offsets)), held],
                names=[key, "part", "before", "n", "ids"],
            )
            before += int(offsets[-1])

    return df.select(key, text).mapInArrow(run, f"{key} {kind}, part long, before long, n long, ids binary")


def with_offsets(found: DataFrame) -> DataFrame:
    """``tokens`` with ``at``, the tokens before each document in the whole table."""
    totals = found.groupBy("part").agg(F.sum("n").alias("total"))
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("part", F.coalesce(F.sum("total").over(whole), F.lit(0)).alias("base"))
    # one row for each partition of the scan: bounded by the number of tasks
    return found.join(F.broadcast(before), "part").withColumn("at", F.col("base") + F.col("before"))


def cut_windows(placed: DataFrame, window: int, key: str = "doc_id", with_ids: bool = True) -> DataFrame:
    names = [x.split()[0] for x in PIECES.split(", ")]
    names = names if with_ids else names[:-1]
    kind = placed.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            keys, ats, ns, ids = (batch.column(c) for c in (key, "at", "n", "ids"))
            rows, cols = [], [[] for _ in range(6)]
            pieces = []
            for i in range(batch.num_rows):
                at, n = ats[i].as_py(), ns[i].as_py()
                own = np.frombuffer(ids[i].as_buffer(), dtype="<u2").astype("<u4")
                start = 0
                while start < n:
                    sequence, offset = divmod(at + start, window)
                    length = min(n - start, window - offset)
                    piece = own[start : start + length]
                    rows.append(i)
                    for col, value in zip(cols, (start, length, zlib.crc32(piece.tobytes()), n, sequence, offset), strict=True):
                        col.append(value)
                    if with_ids:
                        pieces.append(piece.astype(np.int32))
                    start += length
            out = [keys.take(pa.array(rows, pa.int64())), *(pa.array(c, pa.int64()) for c in cols)]
            yield pa.RecordBatch.from_arrays(out + [pa.array(pieces, pa.list_(pa.int32()))] * with_ids, names=names)

    schema = PIECES if with_ids else PIECES.removesuffix(", ids array<int>")
    return placed.select(key, "at", "n", "ids").mapInArrow(run, schema.replace("doc_id long", f"{key} {kind}").replace("doc_id", key))


def pack(df: DataFrame, window: int = 2048, text: str = "text", key: str = "doc_id", path: str | None = None, end_id: int = 1, with_ids: bool = True) -> DataFrame:
    """The pieces of all documents in sequences of ``window`` tokens, with their ids."""
    found = cut(tokens(df, text, key, path or default_path(), end_id))
    return cut_windows(with_offsets(found), window, key, with_ids)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), with_ids=False)
