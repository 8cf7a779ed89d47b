"""Importance resampling of documents towards a target set.

Two bag-of-n-grams models over hashed unigrams and bigrams (lower-cased words) are fitted: one
to the target documents, one to all raw documents. A document's log importance weight is the
sum over its n-grams of log p_target - log p_raw; adding Gumbel noise drawn by a hash of the
id and taking the k largest keys samples k documents without replacement in proportion to
the weights. The k-th key is found by refining histograms of the keys, so nothing is sorted
or collected whole.

Null texts are empty (log weight 0), a null doc_id is a document like any other, repeated rows
have equal keys and may all be drawn, other columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridspark.llm.common import Scratch, WordHash, mix64, slices, text_of, words

BUCKETS = 10_000
#: The target model is fitted on so many labelled documents at most, drawn by a hash of the id.
TARGET_DOCUMENTS = 20_000
_HASH = WordHash(seed=23, lower=True)


def ngram_buckets(buf: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each unigram and bigram of the texts, and its row."""
    starts, ends, rows = words(buf, offsets)
    one = _HASH.of(buf, starts, ends)
    same = rows[1:] == rows[:-1]
    two = mix64(one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:])[same]
    return (np.concatenate([one, two]) % np.uint64(buckets)).astype(np.int64), np.concatenate([rows, rows[1:][same]])


def model_counts(texts: DataFrame, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """N-grams by bucket, of all documents and of those with ``is_target``."""

    def count(batches):
        total = np.zeros((2, buckets), np.int64)
        for rows, buf, offsets in slices(batches):
            target = rows.column(1).to_numpy(zero_copy_only=False).astype(bool)
            bucket, row = ngram_buckets(buf, offsets, buckets)
            total[0] += np.bincount(bucket, minlength=buckets)
            total[1] += np.bincount(bucket[target[row]], minlength=buckets)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), pa.array(total[0]), pa.array(total[1])], ["bucket", "raw", "target"])

    parts = texts.select("text", "is_target").mapInArrow(count, "bucket bigint, raw bigint, target bigint")
    raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for b, r, t in parts.groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect():  # one row for each bucket
        raw[b], target[b] = r, t
    return raw, target


def log_ratio(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log p_target - log p_raw by bucket, with one added to each count."""
    return np.log((target + 1) / (target.sum() + len(target))) - np.log((raw + 1) / (raw.sum() + len(raw)))


def gumbel(doc_id: Column, text: Column, seed: int) -> Column:
    """A document's noise, drawn by its id, or by its text where it has none."""
    drawn = F.when(doc_id.isNull(), F.xxhash64(text, F.lit(seed))).otherwise(F.xxhash64(doc_id, F.lit(seed)))
    u = (F.shiftrightunsigned(drawn, 11).cast("double") + 0.5) * F.lit(2.0**-53)
    return -F.log(-F.log(u))


def largest(scored: DataFrame, k: int, key: str, together: int = 50_000, bins: int = 2048) -> DataFrame:
    """The rows with the k largest keys, ties by doc_id; ``scored`` should be a written table, as it is read a few times."""
    lo, hi, n = scored.agg(F.min(key), F.max(key), F.count(key)).first()
    if k >= n:
        return scored
    if k <= 0:
        return scored.limit(0)
    need = k
    for _ in range(40):
        width = (hi - lo) / bins
        if n <= together or not width or lo + width == lo:
            break
        inside = scored.where(F.col(key).between(lo, hi)).groupBy(F.least(F.floor((F.col(key) - lo) / width), F.lit(bins - 1)).alias("bin"))
        for b, count, least, most in sorted(inside.agg(F.count("*"), F.min(key), F.max(key)).collect(), reverse=True):
            if count >= need:
                lo, hi, n = least, most, count
                break
            need -= count
    # what is left at the boundary is few rows, or rows with one key
    edge = scored.where(F.col(key).between(lo, hi)).withColumn("_rank", F.row_number().over(Window.orderBy(F.desc(key), F.asc_nulls_first("doc_id"))))
    return scored.where(F.col(key) > hi).unionByName(edge.where(F.col("_rank") <= need).drop("_rank"))


def resample(docs: DataFrame, target_ids: DataFrame, k: int, seed: int = 7, buckets: int = BUCKETS) -> DataFrame:
    """k of ``docs``: doc_id, log_weight, key. ``target_ids`` (doc_id) names the target documents. Documents without an id draw by their texts."""
    few = target_ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(TARGET_DOCUMENTS)
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    texts = texts.withColumn("noise", gumbel(F.col("doc_id"), F.col("text"), seed))
    marked = texts.join(F.broadcast(few.withColumn("is_target", F.lit(True))), "doc_id", "left").withColumn("is_target", F.coalesce("is_target", F.lit(False)))
    ratio = log_ratio(*model_counts(marked, buckets))

    def weigh(batches):
        for rows, buf, offsets in slices(batches):
            bucket, row = ngram_buckets(buf, offsets, buckets)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.bincount(row, ratio[bucket], len(offsets) - 1)), rows.column(2)], ["doc_id", "log_weight", "noise"])

    weighed = texts.mapInArrow(weigh, "doc_id bigint, log_weight double, noise double")
    scored = Scratch(docs.sparkSession, "resampling").table(weighed.select("doc_id", "log_weight", (F.col("log_weight") + F.col("noise")).alias("key")), "scored")
    return largest(scored, k, "key")


def op6_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the documents, drawn towards those labelled as of good quality."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    return resample(docs, good, math.ceil(docs.count() / 2))
