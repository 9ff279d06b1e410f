"""Band math over raster files as they come, or over a whole folder, where a damaged file is a row with its error.

A file's header and blocks are read in tasks; what can't be read gives one row with the error in place of pixels, and
the others go on. Results are written below ``out`` by the number of the batch, which a repeated batch writes anew, so
that a restart from a checkpoint repeats no file and loses none.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumenfold.functions.registry import Registry
from lumenfold.operators.bandmath import Image, Variable, compute
from lumenfold.sources.envi import BLOCK
from lumenfold.sources.rasters import batches_of, data_files, open_raster

ROWS = "path string, y int, x int, spectrum array<double>, error string"


def read_each(files: DataFrame, format: str | None = None, size: int = BLOCK) -> DataFrame:
    """ROWS of files (path): pixels, and a row with an error for each header or block that can't be read."""

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path in pdf["path"]:
                try:
                    raster = open_raster(path, format)
                    rows += [(path, pickle.dumps(raster.part(at, count)), at, count, None) for at, count in raster.blocks(size)]
                except Exception as e:  # whatever a damaged file leads to is told
                    rows.append((path, None, 0, 0, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "raster", "at", "lines", "error"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrong = lambda path, text: pa.record_batch([pa.array([path]), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.list_(pa.float64())), pa.array([text])], names=["path", "y", "x", "spectrum", "error"])
        for batch in batches:
            for row in batch.to_pylist():
                if row["error"] is not None:
                    yield wrong(row["path"], row["error"])
                    continue
                try:
                    parts = list(batches_of(pickle.loads(row["raster"]), row["path"], row["at"], row["lines"]))  # one block
                except Exception as e:
                    yield wrong(row["path"], f"{type(e).__name__}: {e}")
                    continue
                for part in parts:
                    yield pa.record_batch([*part.columns, pa.nulls(part.num_rows, pa.string())], names=[*part.schema.names, "error"])

    blocks = files.select("path").mapInPandas(plan, "path string, raster binary, at int, lines int, error string")
    tasks = max(1, files.sparkSession.sparkContext.defaultParallelism * 4)
    return blocks.repartition(tasks).mapInArrow(run, ROWS)


def evaluate_each(expression: str, files: DataFrame, name: str = "c", functions: Registry | None = None, format: str | None = None, size: int = BLOCK, **others: Variable) -> DataFrame:
    """(path, y, x, spectrum or value, error): an expression over each raster."""
    rows = read_each(files, format, size)
    frame = rows.withColumn("_error", F.struct("error"))
    found = compute(expression, {name: Image("cube", frame, ("path", "y", "x", "_error")), **others}, functions)
    if found.frame is None:
        raise ValueError("the expression doesn't use the rasters")
    return found.frame.withColumn("error", F.col("_error.error")).drop("_error")


def write_batch(expression: str, out: str, **options) -> Callable[[DataFrame, int], None]:
    """A sink for ``foreachBatch``, or for one whole folder: results of the files of a batch below ``out``."""

    def write(files: DataFrame, batch: int) -> None:
        evaluate_each(expression, files, **options).write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={batch:08d}")

    return write


def evaluate_folder(spark: SparkSession, expression: str, folder: str, out: str, **options) -> None:
    """All raster files of a folder as one batch."""
    write_batch(expression, out, **options)(data_files(spark, folder), 0)


def watch_rasters(spark: SparkSession, expression: str, folder: str, out: str, checkpoint: str, suffix: str = "*.{img,tif,tiff,fits,nc}", once: bool = False, files_per_trigger: int | None = None, **options) -> StreamingQuery:
    """Evaluates the raster files of a folder as they come. A file should be moved there with its header before it."""
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", suffix).option("recursiveFileLookup", "true")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    writer = reader.load(folder).select("path").writeStream.foreachBatch(write_batch(expression, out, **options)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def results(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """(results, errors): the pixels of files that could be read as a whole, and (path, error) of the others, one row each."""
    rows = spark.read.parquet(out)
    errors = rows.where("error IS NOT NULL").groupBy("path").agg(F.min("error").alias("error"))
    return rows.where("error IS NULL").join(errors.select("path"), "path", "left_anti").drop("error"), errors
