"""A training corpus from raw documents, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and read again as
the next stage's ``docs``. All but the last return the columns of ``documents``; the last returns each kept
document's source, words, source weight, number of readings and block.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.common import table
from gridloom.session import keep_until_end, shared_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    from gridloom.llm.quality_model import keep_good

    return keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of recurring templates."""
    from gridloom.llm.line_templates import drop_lines

    return drop_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: five-word shingles, similarity 0.8 or more."""
    from gridloom.llm.jaccard_join import one_of_each

    return one_of_each(docs, size=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    from gridloom.llm.decontamination import clean_documents

    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Readings of each document under the mixture: every document at least once, none more than four times."""
    from gridloom.llm.mixing import mixture as mixed

    return mixed(docs, max_epochs=4.0)


STAGES = [
    ("quality_classifier", quality), ("line_dedup", lines), ("ngram_jaccard", near_duplicates),
    ("decontamination", benchmark), ("mixing", mixture),
]
#: Classifier, template tree and components over texts are not expressible in SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole ``documents`` table; each stage is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline/{uuid.uuid4().hex}/{name}"
        keep_until_end(path)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
