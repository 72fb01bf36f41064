"""The corpus pipeline: documents in, a clean and mixed corpus out.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and
read again as the next stage's ``docs``. All stages but the last return the columns of ``documents``:

1. quality: documents that the classifier rejects go;
2. near duplicates: one document of each group stays, the one with the smallest id;
3. benchmark: documents that hold a test item, exactly or edited, go;
4. personal data: confirmed spans are replaced by the name of their kind;
5. mixing: how often each remaining document is taken, so that sources meet their target weights.

NULL ids cannot be told apart and pass stage 2; NULL texts are empty texts; columns beyond those
of ``documents`` pass through stages 1 to 4.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.decontaminate import drop_contaminated
from tidemark.llm.mixing import mix
from tidemark.llm.neardup import keep_firsts
from tidemark.llm.pii import redact
from tidemark.llm.quality import keep_good
from tidemark.session import written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_firsts(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", without_near_duplicates),
    ("benchmark decontamination", without_benchmark),
    ("PII", without_personal_data),
    ("mixing sources to target weights", mixed),
]

ORACLE_SQL = None  # a learned classifier has no SQL; tests compare with a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "corpus")
    return docs
