"""From documents to a training mix in five stages, each on all rows that the one before it kept.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last one
return the columns of ``docs``. ``run`` writes each result to the shared folder and reads
it again for the next stage, so a lost executor repeats a part of one stage only.

quality      documents that the classifier rejects go (fitted on the labels that are not held out)
near_copies  one document of each SimHash group (operator 5: three-word shingles, two bits) stays, the one with the least id
benchmark    documents that hold a benchmark item go
secrets      secrets in the texts give way to a mark; all documents stay
mixture      source-balanced selection: one row for each time that a document is taken
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from srclens.llm import decontaminate, mixing, neardup, quality, secret_scan
from srclens.llm.common import table
from srclens.session import written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_least(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("quality", good_quality),
    ("near_copies", near_copies),
    ("benchmark", benchmark),
    ("secrets", secrets),
    ("mixture", mixture),
]

ORACLE_SQL = None
"""SQL cannot fit the classifier nor compute the fingerprints; tests hold the stages against brute force."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
