"""Corpus pipeline: quality classifier, line dedup, n-gram Jaccard join, benchmark decontamination, packing.

Each stage calls one operator on all that the stage before kept. Stages are written as Parquet and read again, so
that a later stage never repeats an earlier one; what a stage writes on its way is removed when it is done, and what
it returned when the next one is.

Defined results, beside those of the operators: null and empty texts go where the classifier scores them below its
threshold; a document that loses all its lines stays with an empty text; n_chars follows the text where the table has
it; documents without words are no near duplicates of each other, unless whole rows are equal; ties between copies go
to the least id, null first; rows that repeat an id are told apart by their text; texts are taken whole at any
length; an empty table gives no rows; other columns pass through all stages but the last.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.llm import decontaminate, jaccard, line_dedup, packing, quality
from wayfare.llm.common import remove, scratch, shared_dir
from wayfare.llm.queries import read, tokenizer_file


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars follows the text, where the table has it."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(line_dedup.dedup_lines(docs).select(*docs.columns))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_contaminated(docs, read(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_file())


STAGES = [
    ("quality", good_quality),
    ("line_dedup", distinct_lines),
    ("near_dedup", distinct_documents),
    ("decontamination", clean_of_benchmark),
    ("packing", packed),
]

#: Trained, hashed and tokenized stages have no SQL form; tests hold each stage's rows against a plain form of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents``."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/wayfare/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        out = f"{folder}/{name}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if before:
            remove(spark, before)
        before = out
    return docs
