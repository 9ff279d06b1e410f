"""Damaged files among others, in a batch and in a stream that starts again."""

import os
import shutil

import numpy as np

from lumenfold.sources.envi import encode_raster
from lumenfold.streaming import raster_stream


def put(folder, name, seed, cut=0, header=True):
    data = np.random.default_rng(seed).integers(0, 50, (6, 5, 3)).astype(float)
    head, raw = encode_raster(data)
    os.makedirs(folder, exist_ok=True)
    if header:
        (folder / f"{name}.hdr").write_text(head)
    (folder / f"{name}.img").write_bytes(raw[: len(raw) - cut] if cut else raw)
    return data


def told(spark, out):
    pixels, errors = raster_stream.results(spark, str(out))
    return {(os.path.basename(r["path"]), r["y"], r["x"]): r["spectrum"] for r in pixels.collect()}, {os.path.basename(r["path"]): r["error"] for r in errors.collect()}


def expected(made):
    return {(f"{n}.img", y, x): [2 * v + 1 for v in d[y, x]] for n, d in made.items() for y in range(6) for x in range(5)}


def test_a_damaged_file_is_one_row(spark, tmp_path):
    made = {f"good{i}": put(tmp_path / "in", f"good{i}", i) for i in range(4)}
    put(tmp_path / "in", "short", 9, cut=40)
    put(tmp_path / "in", "bare", 10, header=False)
    (tmp_path / "in" / "wrong.img").write_bytes(b"x")
    (tmp_path / "in" / "wrong.hdr").write_text("ENVI\nsamples = many\n")
    raster_stream.evaluate_folder(spark, "c * 2 + 1", str(tmp_path / "in"), str(tmp_path / "out"), size=60)
    pixels, errors = told(spark, tmp_path / "out")
    assert pixels == expected(made)
    assert set(errors) == {"short.img", "bare.img", "wrong.img"} and "bytes are there" in errors["short.img"]


def test_a_stream_starts_again(spark, tmp_path):
    folder, out, at = tmp_path / "in", tmp_path / "out", str(tmp_path / "state")
    run = lambda: raster_stream.watch_rasters(spark, "c * 2 + 1", str(folder), str(out), at, once=True, files_per_trigger=2).awaitTermination()
    made = {f"a{i}": put(folder, f"a{i}", i) for i in range(3)}
    put(folder, "short", 9, cut=8)
    run()
    pixels, errors = told(spark, out)
    assert pixels == expected(made) and set(errors) == {"short.img"}
    batches = sorted(os.listdir(out))
    made |= {f"b{i}": put(folder, f"b{i}", 20 + i) for i in range(2)}
    run()
    pixels, errors = told(spark, out)
    assert pixels == expected(made) and set(errors) == {"short.img"}
    assert spark.read.parquet(str(out)).where("error IS NULL").count() >= len(pixels)
    # the last batch is lost after its results were written, before it was marked as done: it is written anew
    last = sorted((tmp_path / "state" / "commits").glob("[0-9]*"))[-1]
    os.remove(last)
    for crc in (tmp_path / "state" / "commits").glob(".*.crc"):
        if crc.name == f".{last.name}.crc":
            os.remove(crc)
    run()
    again, errors = told(spark, out)
    assert again == pixels and set(errors) == {"short.img"} and len([b for b in os.listdir(out) if b.startswith("batch")]) > len([b for b in batches if b.startswith("batch")])
    shutil.rmtree(folder)
