"""Web archives as Zstandard frames: a writer and a reader for .warc.zst content.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds a dictionary; each record is a frame of its
own. The writer trains the dictionary on the first records of each archive. Spark's own text writer stores the
frames, through its commit protocol and into any file system: the line separator is an empty skippable frame, which
every reader passes over. The reader gets whole archives from Spark's binaryFile source, loads the dictionary, finds
the frames by their block headers, decodes one frame for each record, and validates headers, lengths and digests;
what fails gets a row with ``error``.

Rows are shuffled once, by the digest of their payload, to tell the response (the smallest id) from its revisits;
a hot payload is split by Spark's skew handling, since the join needs no rows together. An archive ends after
``ARCHIVE_BYTES`` or ``ARCHIVE_FRAMES``, whichever comes first; the writer begins a file after that many rows, so what
is missing is filled up with empty ones. After a damaged frame the reader goes on at the next separator.

Defined results: null html is an empty payload; rows that repeat the smallest id of a payload are all responses;
rows without id revisit one with id; an empty table gives no archives and no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.common import scratch, table

DICTIONARY, SKIPPABLE, FRAME = 0x184D2A5D, 0x184D2A50, 0xFD2FB528
#: An empty skippable frame: four bytes of magic, four of length.
SEPARATOR = struct.pack("<II", SKIPPABLE, 0).decode("ascii")
TRAIN_BYTES, TRAIN_RECORDS, DICTIONARY_BYTES = 2_000_000, 5000, 64_000
#: Of an archive at most (but for one record that is larger by itself).
ARCHIVE_BYTES, ARCHIVE_FRAMES = 64_000_000, 20_000
BATCH_BYTES = 8_000_000
URN = "urn:lumenfold:page:"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A response, or a revisit of ``refers_to`` with the head of the response only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{URN}{'none' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url:
        head.append("WARC-Target-URI: " + " ".join(url.split()))
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <{URN}{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest_of(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def frames(records):
    """The frames of one archive: its dictionary (if one can be trained), then one for each record."""
    first, held = [], 0
    for x in records:
        first.append(x)
        held += len(x)
        if held >= TRAIN_BYTES or len(first) >= TRAIN_RECORDS:
            break
    options = {"level": 3, "write_checksum": True, "write_content_size": True}
    try:
        if len(first) < 16:
            raise zstandard.ZstdError("too few records for a dictionary")
        trained = zstandard.train_dictionary(min(DICTIONARY_BYTES, held // 10 + 256), [x[:16_000] for x in first])
    except zstandard.ZstdError:
        packer = zstandard.ZstdCompressor(**options)
    else:
        packed = zstandard.ZstdCompressor(level=9).compress(trained.as_bytes())
        yield struct.pack("<II", DICTIONARY, len(packed)) + packed
        packer = zstandard.ZstdCompressor(dict_data=trained, **options)
    for x in first:
        yield packer.compress(x)
    for x in records:
        yield packer.compress(x)


def archives(records, most_bytes: int = ARCHIVE_BYTES, most_frames: int = ARCHIVE_FRAMES):
    """The frames of as many archives as it takes, each but the last filled up to ``most_frames`` with empty strings."""
    records, n, size = iter(records), 0, 0

    def own(head):
        yield head
        for _ in range(most_frames - 2):  # beside the dictionary
            if size >= most_bytes or (x := next(records, None)) is None:
                return
            yield x

    for head in records:
        if n:
            yield from [b""] * (most_frames - n)
        n = size = 0
        for frame in frames(own(head)):
            n, size = n + 1, size + len(frame)
            yield frame


def frame_size(data: memoryview) -> int:
    """Bytes of the frame at the start of ``data``, by its block headers."""
    head = bytes(data[:18])
    at = zstandard.frame_header_size(head)
    while True:
        word = int.from_bytes(data[at : at + 3], "little")
        at += 3 + (1 if word >> 1 & 3 == 1 else word >> 3)
        if at > len(data):
            raise ValueError("a frame is cut off")
        if word & 1:
            return at + 4 * zstandard.get_frame_parameters(head).has_checksum


def records_of(data: bytes):
    """(record, None) for each frame of an archive; (None, error) for what can't be read up to the next separator."""
    view, at, unpacker = memoryview(data), 0, zstandard.ZstdDecompressor()
    while at < len(view):
        try:
            magic, size = struct.unpack_from("<II", view, at) if at + 8 <= len(view) else (0, 0)
            if magic & 0xFFFFFFF0 == SKIPPABLE:
                body = bytes(view[at + 8 : at + 8 + size])
                if len(body) < size:
                    raise ValueError("a skippable frame is cut off")
                if magic == DICTIONARY and at == 0:
                    if body[:4] == struct.pack("<I", FRAME):
                        body = unpacker.decompress(body)
                    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body))
                at += 8 + size
            elif magic == FRAME:
                size = frame_size(view[at:])
                yield unpacker.decompress(bytes(view[at : at + size])), None
                at += size
            else:
                raise ValueError("neither a frame nor a skippable frame")
        except (ValueError, zstandard.ZstdError) as error:
            yield None, f"at byte {at}: {error}"
            if (at := data.find(SEPARATOR.encode("ascii"), at + 1)) < 0:
                return


def heads(data: bytes, first: bytes) -> tuple[dict[str, str], int]:
    """The header lines of a WARC record or HTTP message and where its block begins."""
    end = data.find(b"\r\n\r\n")
    if end < 0 or not data.startswith(first):
        raise ValueError(f"no {first.decode()} header")
    lines = data[:end].decode().split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}, end + 4


def parse(data: bytes) -> dict:
    """The fields of a record; a ValueError says what is wrong with it."""
    head, at = heads(data, b"WARC/1.")
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in head:
            raise ValueError(f"no {name}")
    length = int(head["content-length"])
    if len(data) != at + length + 4 or data[at + length :] != b"\r\n\r\n":
        raise ValueError(f"content-length {length} doesn't fit the record")
    http, start = heads(data[at : at + length], b"HTTP/1.")
    size, kind, digest = int(http.get("content-length", -1)), head["warc-type"], head.get("warc-payload-digest", "").removeprefix("sha1:")
    payload = data[at + start : at + length] if kind == "response" else None
    if payload is not None and (size != len(payload) or digest != digest_of(payload)):
        raise ValueError("length or digest of the payload differs")
    refers = head.get("warc-refers-to", "").strip("<>").removeprefix(URN)
    own = head["warc-record-id"].strip("<>").removeprefix(URN)
    if kind == "revisit" and not refers:
        raise ValueError("a revisit without warc-refers-to")
    return {
        "page_id": int(own) if own != "none" else None, "url": head.get("warc-target-uri"), "record_type": kind, "payload_bytes": size,
        "payload_digest": digest, "refers_to": int(refers) if refers else None, "payload": payload, "error": None,
    }


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", most_frames: int = ARCHIVE_FRAMES) -> None:
    """Archives below ``path``, one or more for each partition. Payloads of at least ``least_bytes`` are stored once."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("html"), F.unhex(F.sha1(payload.cast("binary"))).alias("digest"))
    first = rows.where(F.octet_length("html") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"))
    joined = rows.join(first, "digest", "left").select("page_id", "url", "html", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to"))

    def run(batches):
        rows = ((i.as_py(), u.as_py(), h.as_py().encode(), r.as_py()) for b in batches for i, u, h, r in zip(*(b.column(c) for c in ("page_id", "url", "html", "refers_to")), strict=True))
        out, held = [], 0
        for frame in archives((record(*x, date) for x in rows), most_frames=most_frames):
            out.append(frame)
            held += len(frame)
            if held >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])

    framed = joined.mapInArrow(run, "frame binary")
    framed.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", most_frames).text(path)


RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, error string"


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of all archives below ``path``, in rows of RECORDS."""
    schema = RECORDS if payload else RECORDS.replace("payload binary, ", "")
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = pa.schema([(n, types[t]) for n, t in (x.split() for x in schema.split(", "))])

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                out, held = [], 0
                for data, error in records_of(content.as_py()):
                    try:
                        row = {"error": error} if data is None else parse(data)
                    except ValueError as wrong:
                        row = {"error": str(wrong)}
                    out.append(row)
                    held += len(data or b"") if payload else 200
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(out, fields)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, fields)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(run, schema)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "archives")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")


_BITS = "('0x' || substr(h, 5 * i + 1, 5))::BIGINT"
OP4_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, upper(sha1(coalesce(html, ''))) AS h FROM pages),
d AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first,
      array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform([15, 10, 5, 0],
        lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((({_BITS}) >> s) & 31) + 1, 1)), '')), '') AS digest FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN first = page_id OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id OR page_id IS NULL THEN first END AS refers_to, NULL::VARCHAR AS error
FROM d
"""
