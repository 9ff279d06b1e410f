"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one where it is
    unset and Spark runs in one process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None and (held := spark.sparkContext.getCheckpointDir()) is not None:
        found = held
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, found.removeprefix("file://"), True)
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Has Spark remove an action's shuffle files at its end.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_go(spark: SparkSession):
    """An action on a frame made inside leaves no shuffle files: nothing can ask for them any more."""
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared folder, with its lineage cut there; Spark's cleaner removes it."""
    shared_dir(df.sparkSession)
    with _shuffles_go(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The same as a Parquet table, which is smaller and quicker to read again; it stays in the shared folder."""
    spark, at = df.sparkSession, scratch(df.sparkSession, "stored")
    with _shuffles_go(spark):
        df.select("*").write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def identity(key: Column, text: Column) -> tuple[Column, Column]:
    """128 bits of a row's id and text; a null is none of the values. The same row has the same ones in every pass."""
    own = (key.isNull(), key, text.isNull(), text)
    return F.xxhash64(*own), F.xxhash64(F.lit(5), *own)


def split_repeats(df: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """One row for each value of ``by``, and the other rows, if there are any. Only rows that repeat are stored."""
    again = cut(df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*by))
    if again.isEmpty():
        return df, None
    many = cut(df.join(again, by, "left_semi").withColumn("_number", F.monotonically_increasing_id()))
    first = cut(many.groupBy(*by).agg(F.min("_number").alias("_first")))
    many = many.join(first, by)
    one, others = (many.where(c).select(df.columns) for c in ("_number = _first", "_number <> _first"))
    return df.join(again, by, "left_anti").unionByName(one), others


def bounded_sample(df: DataFrame, on: Column, share: float) -> DataFrame:
    """The rows whose hash of ``on`` falls below ``share``: the same rows at any partitioning."""
    return df.where(F.pmod(F.xxhash64(on), F.lit(1_000_003)) < F.lit(int(min(1.0, share) * 1_000_003)))


def placed(df: DataFrame, group: str, order: list[str], amount: Column | None = None) -> DataFrame:
    """``df`` with ``at``, the sum of ``amount`` (1 for each row by default) over the earlier rows of its group in an order,
    and ``total``, that of the whole group, which may be of any size; ``group`` holds no null.

    Rows are sorted by ranges, whose totals give the offsets; rows that are equal in all columns are split by a number.
    """
    spread = df.withColumn("_amount", amount if amount is not None else F.lit(1).cast("long")).withColumn("_tie", F.monotonically_increasing_id())
    rows = cut(spread.orderBy(group, *order, "_tie").drop("_tie").withColumn("_uid", F.monotonically_increasing_id()))
    rows = rows.withColumn("_part", F.shiftright("_uid", 33))
    whole = Window.partitionBy(group)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(group, "_part").agg(F.sum("_amount").alias("_sum"))
    parts = parts.select(group, "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"), F.sum("_sum").over(whole).alias("total"))
    within = Window.partitionBy(group, "_part").orderBy("_uid").rowsBetween(Window.unboundedPreceding, -1)
    numbered = rows.withColumn("_within", F.coalesce(F.sum("_amount").over(within), F.lit(0))).join(parts.hint("merge"), [group, "_part"])  # sorted by these already
    return numbered.withColumn("at", F.col("_before") + F.col("_within")).drop("_amount", "_uid", "_part", "_before", "_within")
