"""Quality classifier by importance resampling.

Two generative models over hashed word n-grams are counted: one on documents that labels call good
(the target), one on the whole corpus (raw). A document's log importance weight is the sum over its
n-grams of log p_target / p_raw. Adding Gumbel noise and taking the k largest keys draws k documents
without replacement in proportion to their weights; k defaults to the target's share of the labels
times the number of documents. The noise comes from a hash of the document, so reruns agree.

Cases: a null or empty text has no n-grams and weight 0; a null doc_id draws its noise from the text
alone; equal rows draw equal noise and are kept or rejected together, and so are rows that tie at the
k-th key (all stay). Labels that are null, or whose document is missing, are ignored. Without a good label
the target is unknown: every weight is 0 and, with k unset, everything stays. An empty table gives an
empty result. Further columns pass through; those named log_weight, gumbel_key or kept are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.llm.common import materialize, mix64, ngram_hashes, small_batches, word_hashes


def buckets_of(text: str | None, n_buckets: int) -> np.ndarray:
    """The buckets of a text's words and word pairs, lower-cased, one entry per occurrence."""
    words = word_hashes(text)
    return (np.concatenate([mix64(words), ngram_hashes(words, 2)]) & np.uint64(n_buckets - 1)).astype(np.int64)


@dataclass(frozen=True)
class ImportanceModel:
    """log p_target / p_raw for each bucket, and the share of good documents among the labelled."""

    log_ratio: np.ndarray
    target_share: float


def _counts(docs: DataFrame, n_buckets: int) -> DataFrame:
    def count(batches):
        raw, target = np.zeros(n_buckets, np.int64), np.zeros(n_buckets, np.int64)
        for pdf in batches:
            for text, good in zip(pdf["text"], pdf["good"], strict=True):
                c = np.bincount(buckets_of(text, n_buckets), minlength=n_buckets)
                raw += c
                if good:
                    target += c
        seen = np.flatnonzero(raw)
        yield pd.DataFrame({"bucket": seen, "raw": raw[seen], "target": target[seen]})

    return docs.mapInPandas(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def fit(docs: DataFrame, labels: DataFrame, *, n_buckets: int = 1 << 14, max_labels: int = 200_000, smoothing: float = 1.0) -> ImportanceModel:
    """Count both models in one pass over all documents.

    At most about max_labels labelled ids, chosen by hash, define the target: that bound is what
    makes the broadcast of the ids safe. The raw model counts every document. Only the counts of the
    n_buckets buckets reach the driver.
    """
    seen = labels.where("doc_id is not null and quality is not null")
    n, good = seen.agg(F.count("*"), F.sum((F.col("quality") == 1).cast("long"))).first()
    share = (good / n) if n else 0.0
    part = min(1.0, max_labels / n) if n else 1.0
    chosen = (
        seen.where((F.col("quality") == 1) & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(part * (1 << 20))))
        .select("doc_id")
        .distinct()
        .withColumn("good", F.lit(True))
    )
    flagged = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))
    with small_batches(docs.sparkSession, 500):
        counts = _counts(flagged, n_buckets).toPandas()
    raw, target = np.zeros(n_buckets), np.zeros(n_buckets)
    raw[counts["bucket"]], target[counts["bucket"]] = counts["raw"], counts["target"]
    if not target.sum():
        return ImportanceModel(np.zeros(n_buckets), share or 1.0)
    ratio = np.log((target + smoothing) / (target.sum() + smoothing * n_buckets)) - np.log((raw + smoothing) / (raw.sum() + smoothing * n_buckets))
    return ImportanceModel(ratio, share)


def score(docs: DataFrame, model: ImportanceModel, *, seed: int = 11) -> DataFrame:
    """docs with log_weight and gumbel_key; the texts go to Python, nothing but a number comes back."""
    table = docs.sparkSession.sparkContext.broadcast(model.log_ratio)

    @F.pandas_udf("double")
    def log_weight(texts: pd.Series) -> pd.Series:
        ratio = table.value
        return pd.Series([float(ratio[buckets_of(t, len(ratio))].sum()) for t in texts], dtype="float64")

    # 52 bits of a hash, moved into the open interval (0, 1).
    uniform = (F.pmod(F.xxhash64(F.lit(seed), "doc_id", F.when(F.col("doc_id").isNull(), F.col("text"))), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return docs.withColumn("log_weight", log_weight("text")).withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(uniform)))


def kth_largest(keys: DataFrame, col: str, k: int) -> float:
    """The exact k-th largest value of a double column.

    Histograms of 4096 bins narrow down the interval that holds it until few distinct values are left,
    so the driver sees at most 4096 counts at a time.
    """
    low, high, n = keys.agg(F.min(col), F.max(col), F.count(col)).first()
    if k <= 0 or not n:
        return float("inf")
    if k >= n:
        return low
    while low < high:
        inside = keys.where(F.col(col).between(low, high))
        width = (high - low) / 4096
        bins = (
            inside.groupBy(F.least(F.floor((F.col(col) - low) / width), F.lit(4095)).alias("bin"))
            .agg(F.count("*").alias("n"), F.min(col).alias("low"), F.max(col).alias("high"))
            .orderBy(F.desc("bin"))
            .collect()
        )
        for b in bins:
            if k <= b["n"]:
                break
            k -= b["n"]
        if (b["low"], b["high"]) == (low, high):
            break
        low, high = b["low"], b["high"]
        if k == 1:
            return high
        if k == b["n"]:
            return low
    return low


def select(docs: DataFrame, labels: DataFrame, *, k: int | None = None, **options) -> tuple[DataFrame, ImportanceModel, float]:
    """Fit, score every document once and find the key of the k-th.

    Returns the written scores (doc_id, log_weight, gumbel_key, kept), the model and the threshold:
    score() with that model and threshold repeats the decisions on the documents themselves.
    """
    model = fit(docs, labels, **options)
    with small_batches(docs.sparkSession, 500):
        keys = materialize(score(docs.select("doc_id", "text"), model).select("doc_id", "log_weight", "gumbel_key"))
    wanted = k if k is not None else round(model.target_share * keys.count())
    threshold = kth_largest(keys, "gumbel_key", wanted)
    return keys.withColumn("kept", F.col("gumbel_key") >= threshold), model, threshold


def resample(docs: DataFrame, labels: DataFrame, *, k: int | None = None, **options) -> DataFrame:
    """docs with log_weight, gumbel_key and kept: the k documents drawn have kept true."""
    _, model, threshold = select(docs, labels, k=k, **options)
    return score(docs, model).withColumn("kept", F.col("gumbel_key") >= threshold)


def op3_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return select(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))[0]
