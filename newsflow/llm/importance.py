"""Quality selection by importance resampling.

Two generative models over hashed words and word pairs, one of target text and
one of all text, give a document the weight p(document | target) / p(document |
raw). Documents are drawn without replacement in proportion to their weights by
the Gumbel trick: the k largest of log weight + Gumbel noise. The noise is a
hash of the id, so reruns draw the same. The k-th largest key is found by
nested histograms, not by a sort.

The target model is fitted on at most ``target_docs`` labelled documents; the
raw model counts every document.

Null text: weight 1 (log 0). A null id takes its noise from an empty id.
Documents with equal keys are drawn or left together. Without target documents
all weights are 1. An empty table gives an empty result. Extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from newsflow.llm.blocks import column
from newsflow.llm.mixing import thresholds
from newsflow.llm.words import Words, fold, pieces, window_hashes, words_of
from newsflow.operators.shipping import ship_package
from newsflow.operators.staging import Staging, staging_for

BUCKETS = 1 << 16
TARGET_DOCS = 5000
SHARE = 0.8
SMOOTHING = 1.0


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of every word and word pair."""
    hashes, texts, pairs = words.hashes(), words.texts(), words.window_starts(2)
    both = window_hashes(hashes, 2)[pairs] if len(pairs) else hashes[:0]
    return (np.concatenate([hashes, both]) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate([texts, texts[pairs]])


def bucket_counts(docs: DataFrame) -> DataFrame:
    """(bucket, n) over all texts: at most one row per bucket and task is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for piece in pieces(batch, "text"):
                total += np.bincount(features(words_of(piece.column("text"), lower=True))[0], minlength=BUCKETS)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["bucket", "n"])

    return docs.select("text").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def _model(counts: DataFrame) -> np.ndarray:
    """Log probability per bucket; BUCKETS numbers whatever the corpus."""
    n = np.full(BUCKETS, SMOOTHING)
    for row in counts.collect():
        n[row["bucket"]] += row["n"]
    return np.log(n / n.sum())


def resample(
    docs: DataFrame,
    target_ids: DataFrame,
    share: float = SHARE,
    target_docs: int = TARGET_DOCS,
    seed: int = 1,
    doc_id: str = "doc_id",
    text: str = "text",
    staging: Staging | None = None,
) -> DataFrame:
    """(doc_id, log_weight, gumbel_key, kept): ``share`` of all documents is drawn.

    ``target_ids`` (doc_id) names documents of the target kind.
    """
    spark = docs.sparkSession
    ship_package(spark)
    staging = staging_for(docs, staging)
    kind = docs.schema[doc_id].dataType.simpleString()
    docs = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    named = docs.withColumn("name", F.xxhash64(F.col("doc_id").cast("string")))
    chosen = target_ids.select(F.col("doc_id").alias("wanted")).filter("wanted is not null").distinct()
    chosen = staging.table(chosen.orderBy(F.xxhash64("wanted"), "wanted").limit(target_docs), "chosen")
    target = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("wanted"), "left_semi")
    raw, wanted = _model(bucket_counts(docs)), _model(bucket_counts(target))
    shared = spark.sparkContext.broadcast(wanted - raw if not chosen.isEmpty() else np.zeros(BUCKETS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = shared.value
        for batch in batches:
            for piece in pieces(batch, "text"):
                bucket, owner = features(words_of(piece.column("text"), lower=True))
                weight = np.bincount(owner, ratio[bucket], minlength=piece.num_rows)
                name = column(piece, "name").astype(np.uint64)
                uniform = (fold(name, np.full(len(name), seed)) >> np.uint64(11)).astype(np.float64) + 0.5
                key = weight - np.log(-np.log(uniform / float(1 << 53)))
                # Order-preserving integers, largest key first, in 60 bits.
                bits = key.view(np.int64)
                rising = np.where(bits < 0, ~bits, bits | np.int64(-(1 << 63))).view(np.uint64)
                place = ((~rising) >> np.uint64(4)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(weight), pa.array(key), pa.array(place)], ["doc_id", "log_weight", "gumbel_key", "place"]
                )

    scored = staging.table(named.mapInArrow(run, f"doc_id {kind}, log_weight double, gumbel_key double, place bigint"), "scored")
    rows = scored.select(F.lit("all").alias("source"), "place", F.lit(1).cast("bigint").alias("size"))
    budget = scored.agg(F.floor(F.count(F.lit(1)) * share).cast("double").alias("budget")).select(F.lit("all").alias("source"), "budget")
    cut = thresholds(rows, budget, staging).first()["below"]
    return scored.select("doc_id", "log_weight", "gumbel_key", (F.col("place") < cut).alias("kept"))
