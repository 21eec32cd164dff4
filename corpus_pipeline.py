"""From documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a
DataFrame; run() writes each stage's result to the shared folder and reads it back as the next one's docs.

Cases: null or empty texts are scored like any other, have no lines to cut, are near no other document, are never taken by the
mix and so do not reach packing. Ties of scores are kept together; rows that repeat count as documents until near-duplicates leave one
of them. Further columns, clashing or not, are dropped by the first stage, as all stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.llm import line_dedup, minhash, mixing, packing, quality_classifier
from leafmark.llm.common import materialize, small_batches

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by importance resampling; the others go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_classifier.resample(docs, labels).where("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated three-line windows are cut; a document that loses all of its lines goes."""
    left = line_dedup.dedup_lines(docs).where("n_removed = 0 or n_removed < n_lines")
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    return minhash.keep_one(docs).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in as many copies as the balanced mix of sources takes."""
    return mixing.mix(docs).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training windows: the pieces of all documents with their token ids and places."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("minhash near-dedup", near_duplicates),
    ("mixing", mixed),
    ("packing", packed),
]

#: The classifier, the sketches and the packing are not expressible in SQL: tests hold each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with small_batches(spark, 500):
            docs = materialize(stage(spark, docs, sf_dir))
    return docs
