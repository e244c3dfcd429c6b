"""Quality classifier: importance resampling by hashed n-gram generative models, Gumbel top-k.

Two models over the same hashed buckets of words and word pairs: one of the target (labelled good
documents), one of the raw text (all documents). A document's log weight is the sum of its n-grams' log
ratios of the two. Documents are drawn without replacement in proportion to the weights: each gets its log
weight plus Gumbel noise, and the k highest stay."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import by_bytes, materialize, renamed, table, text_bytes, thrifty

BUCKETS = 1 << 16
#: Words whose hashes a Python worker remembers at most (about 20 MB).
WORDS_HELD = 100_000
#: Parts that a round of the search for the k-th highest key divides a range into.
_BINS = 4096
_RESULTS = ("log_weight", "sample_key", "kept")


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_HELD:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 11)
        return h


def ngram_buckets(text: bytes | None, known: dict, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of the lower-cased words of a text and of its pairs of neighbours."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.int64)
    w = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    pairs = w[:-1] * np.uint64(0x9E3779B97F4A7C15) + w[1:]
    pairs ^= pairs >> np.uint64(29)
    pairs *= np.uint64(0xBF58476D1CE4E5B9)
    half = np.uint64(buckets // 2)
    return np.concatenate([w >> np.uint64(32), pairs >> np.uint64(32)]).__mod__(half).astype(np.int64) + np.repeat([0, buckets // 2], [len(w), len(pairs)])


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all texts and in those marked ``target``: two rows of counts.

    A task sends one row per bucket at most, the driver gets one per bucket.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = _Ids(), np.zeros((2, buckets), np.int64)
        for b in by_bytes(batches, 0, 2 << 20):
            for t, target in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = ngram_buckets(t, known, buckets)
                np.add.at(total[0], own, 1)
                if target:
                    np.add.at(total[1], own, 1)
        some = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[0, some]), pa.array(total[1, some])], names=["bucket", "n", "target"])

    out = np.zeros((2, buckets), np.int64)
    counted = docs.select(text_bytes("text").alias("text"), "target").mapInArrow(thrifty(run), "bucket long, n long, target long")
    for k, n, target in counted.groupBy("bucket").agg(F.sum("n"), F.sum("target")).collect():
        out[:, k] = n, target
    return out


def log_ratios(counts: np.ndarray, smoothing: float = 0.5) -> np.ndarray:
    """log p_target / p_raw of each bucket; words and pairs are models of their own."""
    out = []
    for part in np.split(counts.astype(float), 2, axis=1):
        p = (part + smoothing) / (part.sum(axis=1, keepdims=True) + smoothing * part.shape[1])
        out.append(np.log(p[1]) - np.log(p[0]))
    return np.concatenate(out)


def log_weights(docs: DataFrame, ratios: np.ndarray, text_col: str = "text", name: str = "log_weight") -> DataFrame:
    """``docs`` with a column ``name``: the sum of the log ratios of a text's n-grams (null or empty: 0)."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios.astype(np.float64))  # one double a bucket
    names, at = [*docs.columns, name], docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, r = _Ids(), shared.value
        for b in by_bytes(batches, at, 2 << 20):
            # the text's own bytes: a view, so that no text is sent twice
            found = [float(r[ngram_buckets(t, known, len(r))].sum()) for t in b.column(at).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.float64())], names=names)

    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])
    return docs.mapInArrow(thrifty(run), schema)


def sample_key(id_col: str, text_col: str, weight: str, seed: int, temperature: float) -> Column:
    """Log weight plus Gumbel noise that only depends on a row's id, its text and the seed."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), F.xxhash64(F.col(f"`{text_col}`"))), 11).cast("double") + 0.5) / float(1 << 53)
    return F.col(weight) - temperature * F.log(-F.log(u))


def kth_highest(scored: DataFrame, score: str, k: int) -> float:
    """The k-th highest score (infinity for k < 1, minus infinity for k over the number of rows).

    It is found by counting: each round divides the range that holds it into 4096, so only that many
    counts reach the driver and nothing is sorted.
    """
    n, low, high = scored.agg(F.count(score), F.min(score), F.max(score)).first()
    if k < 1:
        return float("inf")
    if k > n:
        return float("-inf")
    while low < high:
        width = (high - low) / _BINS
        place = F.least(F.floor((F.col(score) - low) / width), F.lit(_BINS - 1)) if width else F.when(F.col(score) > low, 1).otherwise(0)
        bins = scored.where(F.col(score).between(low, high)).groupBy(place.alias("p")).agg(F.count("*"), F.min(score), F.max(score)).collect()
        for _, count, low, high in sorted(bins, reverse=True):
            if count >= k:
                break
            k -= count
        if count == k:
            break
    return low


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, reject: float = 0.01, temperature: float = 0.25, target_rows: int = 100_000) -> tuple[np.ndarray, float]:
    """Log ratios of the buckets and the sample key that the drawn documents reach.

    The raw model counts every text, the target model the labelled documents of quality 1 that aren't toxic,
    but for a quarter of them (by a hash of the id). k is how many documents weigh at least as much as the
    ``reject`` quantile of that held-out quarter. Without target or held-out documents all are drawn.
    Of the labelled good documents at most ``target_rows`` are used, those with the smallest hashes of their
    ids; they are broadcast (two longs each), so no text is shuffled.
    """
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("__k")).agg(F.min(F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False))).alias("good"))
    draw = marks.where("good").select("__k", F.xxhash64(F.lit(seed), "__k").alias("__h")).orderBy("__h", "__k").limit(target_rows)
    good = materialize(draw.select("__k", (F.pmod("__h", F.lit(4)) == 0).alias("held")))
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).join(F.broadcast(good), F.col("doc_id") == F.col("__k"), "left").drop("__k")
    counts = bucket_counts(own.select("text", F.coalesce(~F.col("held"), F.lit(False)).alias("target")))
    if not counts[1].any():
        return np.zeros(BUCKETS), float("-inf")
    ratios = log_ratios(counts)
    weighed = materialize(log_weights(own, ratios).select("held", sample_key("doc_id", "text", "log_weight", seed, temperature).alias("key"), "log_weight"))
    held = weighed.where("held")
    n = held.count()
    if not n:
        return ratios, float("-inf")
    # found by counting, so that partitions don't decide who stays
    cut = kth_highest(held, "log_weight", n - int(reject * n))
    return ratios, kth_highest(weighed, "key", weighed.where(F.col("log_weight") >= cut).count())


def importance_resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, reject: float = 0.01, temperature: float = 0.25) -> DataFrame:
    """``docs`` with ``log_weight, sample_key, kept``; ``kept`` are the k documents with the highest keys.

    Documents are drawn without replacement in proportion to their weights to the power 1 / ``temperature``.
    No text moves: the last pass weighs each document where it is read and compares it with the k-th key.
    Null and empty texts have no n-grams and weight 0 in logarithm; rows with null ids or labels aren't
    targets; repeated rows get equal keys and stay or go alike; an empty table gives no rows; texts of any length are
    weighed whole. Columns of ``docs`` named like the three results give way to them; other names may be any.
    """
    wide, at = renamed(docs)
    named = labels.select(F.col(id_col).alias(at[id_col]), "quality", "toxic")
    ratios, least = fit(wide, named, at[id_col], at[text_col], seed, reject, temperature)
    found = log_weights(wide, ratios, at[text_col]).withColumn("sample_key", sample_key(at[id_col], at[text_col], "log_weight", seed, temperature)).withColumn("kept", F.col("sample_key") >= least)
    return found.select(*[F.col(k).alias(c) for c, k in at.items() if c.lower() not in _RESULTS], *_RESULTS)


def resampled(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The kept rows and the columns of ``docs``, whatever their names."""
    wide, at = renamed(docs)
    named = labels.withColumnRenamed("doc_id", at["doc_id"])
    return importance_resample(wide, named, at["doc_id"], at["text"], **options).where("kept").select(*wide.columns).toDF(*docs.columns)


def op6_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return importance_resample(docs, table(spark, sf_dir, "labels")).select("doc_id", "log_weight", "sample_key", "kept")
