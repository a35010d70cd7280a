"""The corpus pipeline: quality classifier, quality rules, near-duplicates, repeated passages, packing.

Each stage works on all that the one before it kept. Documents that the classifier or the rules reject go; of every class
of near-duplicates its first document stays; of a passage that repeats, the first occurrence stays, and documents of which
nothing is left go; what remains is packed into batches.

Defined results: an empty table gives no batches. Rows with a null text or without words are rejected by the rules. Ids are unique
and not null, as the table's are; other columns than those of COLUMNS aren't read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import classifier, ordermin, packing, phrases, rules
from quantloom.llm.common import delete, fresh_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return classifier.keep(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rules.keep(docs.select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ordermin.keep_first(docs.select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return phrases.drop_repeats(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("bigint"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, packing.n_words(F.col("text")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("packing", pack),
]

#: The classifier is fitted and the near-duplicates are found by hashing: SQL can't say which rows they give.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            delete(spark, before)
        before = path
    packed = STAGES[-1][1](spark, docs, sf_dir)  # packing has its own table of lengths by now
    delete(spark, before)
    return packed
