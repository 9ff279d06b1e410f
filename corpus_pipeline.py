"""The corpus pipeline: stages over the documents, each written as Parquet and read again as the next one's input.

Defined results: documents without text, or whose text has no letter, have no language and go in the second stage;
rows repeated in id and text become one row in the third or fourth; rows without id are kept like others (of a class
of near duplicates they go first); an empty table gives an empty result; all stages but the last return the columns
they got, whatever their names, and of these change only text and n_chars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenfold.llm import language, line_dedup, minhash_dedup, packing, toxicity
from lumenfold.llm.common import scratch, table


def free(docs: DataFrame) -> str:
    """A prefix that no column of the documents has."""
    prefix = "_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix += "_"
    return prefix


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model, trained on the labels, calls toxic go."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.grade(docs, model, prefix=(p := free(docs))).where(f"NOT {p}toxic").select(docs.columns)


def unknown_language_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language no class claims with enough confidence go."""
    return language.predict(docs, language.train(docs), prefix=(p := free(docs))).where(f"{p}accepted").select(docs.columns)


def lines_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of lines that are near duplicates the first stays; documents that lose all their lines go."""
    found = line_dedup.dedup_lines(docs, prefix=(p := free(docs)))
    return found.where(rf"{p}n_dropped = 0 OR text RLIKE '\\S'").select(docs.columns)


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return minhash_dedup.keep_one(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return packing.pack(docs, with_ids=False)


STAGES = [
    ("toxicity", toxic_out),
    ("language", unknown_language_out),
    ("line_dedup", lines_once),
    ("near_dedup", near_duplicates_out),
    ("packing", packed),
]
#: Trained classifiers and tokens are beyond SQL; tests/llm/test_pipeline.py holds each stage and the whole against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        at = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return STAGES[-1][1](spark, docs, sf_dir)
