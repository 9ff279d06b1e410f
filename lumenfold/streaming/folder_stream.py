"""Band math over a folder that grows: new files are evaluated as they come (an addition to the batch mode)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenfold.functions.registry import Registry
from lumenfold.operators.bandmath import Image, Variable, evaluate


def watch(spark: SparkSession, folder: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the Parquet cubes or bands in a folder."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def evaluate_stream(expression: str, stream: DataFrame, name: str = "c", kind: str = "cube", keys: tuple[str, ...] = ("ds_id", "y", "x"), functions: Registry | None = None, **others: Variable) -> DataFrame:
    """An expression over the stream (and numbers or spectra); it is stateless, so it runs in append mode."""
    return evaluate(expression, {name: Image(kind, stream, keys), **others}, functions)[1]
