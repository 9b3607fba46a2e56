"""Quality by importance resampling.

Words and word pairs are hashed to BUCKETS features. A target model is fitted to labelled good
documents (a bounded sample), a raw model to the whole corpus; the target's counts are smoothed by
SMOOTHING counts drawn from the raw model, so that a feature too rare to judge has ratio 1. A document
weighs the ratio of both models' probabilities of all its features. Gumbel noise, fixed by doc_id and
seed, is added to the ratio's logarithm, and the top k documents are the sample: drawn without
replacement in proportion to the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, frugal, hash_words, rolling, small_batches, split_words, stored

BUCKETS = 1 << 18
#: Labelled documents that the target model is fitted to, at most: those of the smallest hash.
LABELLED = 50_000
SMOOTHING = 10.0
SEED = 17
_BATCH_WORDS = 1 << 19


def _features(texts: list[str | None], known: WordHashes) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs [a, b) of texts: the buckets of all their features and where each text's start (one entry more)."""
    a = 0
    while a < len(texts):
        lists, size, b = [], 0, a
        while b < len(texts) and size < _BATCH_WORDS:
            lists.append(split_words(texts[b]))
            size += len(lists[-1])
            b += 1
        flat, ends = hash_words(lists, known)
        one = (flat % np.uint64(BUCKETS)).astype(np.int64)
        two = np.empty(len(flat), dtype=np.int64)
        if len(flat):
            two[:-1] = (rolling(flat, 2) % np.uint64(BUCKETS)).astype(np.int64)
            two[ends[1:][ends[1:] > ends[:-1]] - 1] = -1  # a text's last word starts no pair
        both = np.stack([one, two], axis=1).ravel()
        yield a, b, both, ends * 2
        a = b


def _target_ids(labels: DataFrame, limit: int) -> list[int]:
    good = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).filter("q = 1 and coalesce(t, 0) = 0")
    return [r["doc_id"] for r in good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).select("doc_id").collect()]


def fit(docs: DataFrame, labels: DataFrame, limit: int = LABELLED) -> np.ndarray:
    """Logarithm of target over raw probability of each bucket; the raw counts cover all documents."""
    target = docs.sparkSession.sparkContext.broadcast(frozenset(_target_ids(labels, limit)))

    @frugal
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, raw, good = WordHashes(), np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for a, b, both, ends in _features(batch.column(1).to_pylist(), known):
                raw += np.bincount(both[both >= 0], minlength=BUCKETS)
                for i in range(a, b):
                    if ids[i] in target.value:
                        own = both[ends[i - a] : ends[i - a + 1]]
                        good += np.bincount(own[own >= 0], minlength=BUCKETS)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(good[at])], names=["b", "raw", "good"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "b int, raw long, good long")
    counts = np.zeros((2, BUCKETS))
    for r in rows.groupBy("b").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).collect():
        counts[:, r["b"]] = r["raw"], r["good"]
    raw, good = counts
    expected = good.sum() * raw / max(raw.sum(), 1.0)
    return np.log(good + SMOOTHING) - np.log(expected + SMOOTHING)


def weigh(docs: DataFrame, ratio: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, log_weight and sort_key (log_weight plus Gumbel noise) of every row.

    log_weight: the logarithm of target over raw probability of the whole text. A null text or one
    without words has no features and is as likely in both models: 0.
    """
    # Whole multiples of 2**-32: sums are exact, whatever rows a task works through together.
    whole = np.round(ratio * 2.0**32).astype(np.int64)
    table = docs.sparkSession.sparkContext.broadcast(np.append(whole, 0))

    @frugal
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            out = np.empty(batch.num_rows)
            for a, b, both, ends in _features(batch.column(1).to_pylist(), known):
                sums = np.concatenate([[0], np.cumsum(table.value[both])])
                out[a:b] = (sums[ends[1:]] - sums[ends[:-1]]) * 2.0**-32
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["doc_id", "log_weight"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id long, log_weight double")
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.lit(-1)), F.col("doc_id").isNull()), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return rows.withColumn("sort_key", F.col("log_weight") - F.log(-F.log(uniform)))


def _threshold(rows: DataFrame, k: int) -> float | None:
    """The k-th largest sort_key, found by counting in ever finer bins; only bin counts come to the driver."""
    low, high, n = rows.agg(F.min("sort_key"), F.max("sort_key"), F.count(F.lit(1))).first()
    if k <= 0 or not n:
        return None
    if k >= n:
        return low
    above, bins = 0, 4096
    while low < high:
        step = (high - low) / bins
        part = rows.filter(F.col("sort_key").between(low, high))
        if step <= 0 or low + step == low:
            break
        at = F.least(F.floor((F.col("sort_key") - low) / step), F.lit(bins - 1)).cast("int")
        counts = {r["at"]: (r["n"], r["lo"], r["hi"]) for r in part.groupBy(at.alias("at")).agg(F.count(F.lit(1)).alias("n"), F.min("sort_key").alias("lo"), F.max("sort_key").alias("hi")).collect()}
        for b in sorted(counts, reverse=True):
            if above + counts[b][0] >= k:
                _, low, high = counts[b]
                break
            above += counts[b][0]
        if above + counts[b][0] == k:
            return low
    return low


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = SEED, limit: int = LABELLED) -> DataFrame:
    """One row for each row of docs: doc_id, log_weight, sort_key, kept (whether it is in the sample).

    k: documents to draw; by default as many as the labels' share of good ones (quality 1, not toxic)
    in the corpus. Rows that tie with the k-th are kept with it. Rows with a null doc_id are weighed
    like others, share their noise, and cannot be labelled. Without labels the weights are those of an
    empty target model, and all rows are kept. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    rows = stored(weigh(docs, fit(docs, labels, limit), seed), "weights")
    if k is None:
        by_doc = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
        share = by_doc.agg(F.avg(F.expr("cast(q = 1 and coalesce(t, 0) = 0 as int)"))).first()[0]
        k = round((1.0 if share is None else float(share)) * rows.count())
    limit_key = _threshold(rows, k)
    kept = F.lit(False) if limit_key is None else F.col("sort_key") >= F.lit(limit_key)
    return rows.withColumn("kept", kept)
