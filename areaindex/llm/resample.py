"""Quality by importance resampling.

Two generative models of hashed word unigrams and bigrams, BUCKETS shares each, are counted by Spark:
``target`` over the documents that labels call good, ``raw`` over all documents.  A document's log
weight is the sum over its grams of log(target share / raw share).  Adding Gumbel noise, drawn by a hash of
the id, and keeping the k largest keys samples k documents without replacement in proportion to
their weights.  The k-th key is found by counting keys in ever finer ranges.

Defined cases: a null or empty text has no grams and log weight 0; a document with several labels is
good if none of them is bad; null labels say nothing; without a good label both models are the same;
ties of keys go to the smaller doc_id; rows that repeat an id share its key and fate; rows with a
null id have a null key and are not kept; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaindex.llm.common import join_small, land, rebatch, space_words, texts
from areaindex.llm.near_dedup import WordHashes

BUCKETS = 1 << 16
KEEP = 0.8
SEED = 17

#: Added to each bucket count of both models after the raw counts are scaled to the target's total, so
#: that grams too rare to say anything weigh next to nothing.
SMOOTHING = 5.0


def grams(text: bytes, seen: WordHashes, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of the words and of the pairs of neighbouring words."""
    words = space_words(text)
    h = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
    pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
    both = np.concatenate([h, pairs ^ (pairs >> np.uint64(31))])
    return (both % np.uint64(buckets)).astype(np.int64)


def _count(batches, buckets):
    seen = WordHashes()
    raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for batch in rebatch(batches):
        for text, good in zip(texts(batch), batch.column("good").to_pylist(), strict=True):
            counts = np.bincount(grams(text, seen, buckets), minlength=buckets)
            raw += counts
            if good:
                target += counts
    yield pa.RecordBatch.from_pydict({"bucket": np.arange(buckets), "raw": raw, "target": target})


def _weigh(batches, ratio):
    seen = WordHashes()
    for batch in rebatch(batches):
        weights = [float(ratio[grams(t, seen, len(ratio))].sum()) for t in texts(batch)]
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").cast(pa.int64()), "log_weight": pa.array(weights, pa.float64())})


def good_documents(labels: DataFrame) -> DataFrame:
    """doc_id and good of each labelled document: of quality and not toxic."""
    good = F.coalesce((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), F.lit(True))
    known = labels.filter("doc_id is not null and (quality is not null or toxic is not null)")
    return known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(good).alias("good"))


def fit(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Log ratio of the target's share to the raw share of every bucket."""
    good = land(good_documents(labels), "good")
    rows = join_small(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), good, ["doc_id"], "left").select("text", "good")
    counted = rows.mapInArrow(lambda it: _count(it, buckets), "bucket long, raw long, target long")
    counts = np.zeros((2, buckets))
    for r in counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():  # a row per bucket
        counts[:, r["bucket"]] = r["target"], r["raw"]
    if not counts[0].any():
        return np.zeros(buckets)
    counts[1] *= counts[0].sum() / counts[1].sum()
    return np.log((counts[0] + SMOOTHING) / (counts[1] + SMOOTHING))


def kth_largest(rows: DataFrame, column: str, k: int, bins: int = 1024, few: int = 4096):
    """The k-th largest value of a column, from 1: counts in ``bins`` ranges, then in the bins of the one
    that holds it, until ``few`` rows are left or the range can't be cut."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    inside = rows
    while low < high and inside.limit(few + 1).count() > few:
        step = (high - low) / bins
        if low + step <= low:
            break
        place = F.least(F.floor((F.col(column) - low) / step), F.lit(bins - 1))
        counts = dict(inside.groupBy(place.alias("p")).count().collect())  # at most ``bins`` rows
        for p in sorted(counts, reverse=True):
            if k <= counts[p]:
                break
            k -= counts[p]
        inside = inside.filter(place == p)
        low, high = inside.agg(F.min(column), F.max(column)).first()
    if low == high:
        return low
    return sorted((r[0] for r in inside.select(column).collect()), reverse=True)[k - 1]


def resample(docs: DataFrame, labels: DataFrame, keep: float = KEEP, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """Per row of ``docs``: doc_id, log_weight, key, and kept, for the ceil(keep * documents) largest keys."""
    ratio = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, buckets))  # ``buckets`` numbers
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    weighed = rows.mapInArrow(lambda it: _weigh(it, ratio.value), "doc_id long, log_weight double")
    even = (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    noise = -F.log(-F.log(even))
    keyed = land(weighed.withColumn("key", F.when(F.col("doc_id").isNotNull(), F.col("log_weight") + noise)), "keys")
    ranked = keyed.filter("key is not null")
    k = math.ceil(keep * ranked.count())
    if k == 0:
        return keyed.withColumn("kept", F.lit(False))
    cut = kth_largest(ranked, "key", k)
    left = k - ranked.filter(F.col("key") > cut).count()
    last = -kth_largest(ranked.filter(F.col("key") == cut).select((-F.col("doc_id")).alias("place")), "place", left)
    kept = (F.col("key") > cut) | ((F.col("key") == cut) & (F.col("doc_id") <= last))
    return keyed.withColumn("kept", F.coalesce(kept, F.lit(False)))
