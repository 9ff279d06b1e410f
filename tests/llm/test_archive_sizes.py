"""Archives of bounded size, and reading on after damage."""

import struct

from lumenfold.llm import warc


def records(n):
    return [warc.record(i, "http://host/path", b"<html><body>some text and more " * (i % 9 + 3), None, "2024-01-01T00:00:00Z") for i in range(n)]


def test_archives_end_and_begin_anew():
    want = records(400)
    rows = list(warc.archives(iter(want), most_frames=150))
    files = [rows[i : i + 150] for i in range(0, len(rows), 150)]
    assert len(files) == 3
    out = []
    for rows in files:
        data = b"".join(x + warc.SEPARATOR.encode() for x in rows)
        assert struct.unpack("<I", data[:4])[0] == warc.DICTIONARY
        found = list(warc.records_of(data))
        assert all(e is None for _, e in found)
        out += [x for x, _ in found]
    assert out == want


def test_archives_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(warc, "TRAIN_RECORDS", 20)  # what trains the dictionary is in an archive before its size is known
    rows = list(warc.archives(iter(records(200)), most_bytes=1000, most_frames=300))
    files = [rows[i : i + 300] for i in range(0, len(rows), 300)]
    assert len(files) > 1 and [x for f in files for x, _ in warc.records_of(b"".join(x + warc.SEPARATOR.encode() for x in f))] == records(200)


def test_files_of_a_partition(spark, tmp_path):
    df = spark.range(300).selectExpr("id AS page_id", "concat('http://x/', id) AS url", "repeat(concat('page ', id % 250, ' '), 40) AS html").coalesce(1)
    warc.write_archives(df, str(tmp_path / "a"), most_frames=64)
    files = list((tmp_path / "a").glob("part-*"))
    got = warc.read_archives(spark, str(tmp_path / "a")).collect()
    assert sorted(r["page_id"] for r in got) == list(range(300)) and all(r["error"] is None for r in got)
    assert len(files) >= 2 and sum(r["record_type"] == "revisit" for r in got) == 50


def test_reading_goes_on_after_damage():
    want = records(60)
    data = bytearray(b"".join(x + warc.SEPARATOR.encode() for x in warc.frames(iter(want))))
    starts = [i for i in range(len(data) - 4) if data[i : i + 4] == struct.pack("<I", warc.FRAME)][-50:]
    data[starts[10] + 14] ^= 0xFF  # inside a frame
    data[starts[30]] ^= 0xFF  # its magic
    found = list(warc.records_of(bytes(data)))
    assert [x for x, e in found if e is None] == want[:20] + want[21:40] + want[41:] and sum(e is not None for _, e in found) == 2
