"""Corpus pipeline: stages of the training-data operators, each over all that its predecessor kept.

All stages take null and empty texts, null and repeated ids and repeated rows, very long texts and empty tables; but for
the last they return the columns of their input, whatever further ones it has. As their results are lazy, stages that send
text to Python leave the session with Arrow batches of at most ``BATCH``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookfold.llm import importance, packing, pii, simhash, substring
from bookfold.storage import new_path

#: The stages draw, hash and permute, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None
#: Key of the pseudonyms; a deployment sets its own.
PII_KEY = "public example key"
COUNT = "values replaced by the pii stage"
#: Bytes of an Arrow batch for Python; Spark's own bound is 10,000 rows, whatever their texts.
BATCH = "2m"
#: Words that packing remembers, a sixth of its own bound: it is slower so, but its Python workers are those of all stages.
WORDS_HELD = 50_000


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling towards the labelled good ones draws. Texts without words have an even
    weight; repeated rows stay or go together."""
    _small_batches(spark)
    return importance.resampled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates (5-word shingles, similarity 0.8), the one with the smallest id:
    SimHash pairs, confirmed by their sets, and the pairs that fingerprints are too coarse for. Texts without words are
    equal; of repeated rows one stays."""
    _small_batches(spark)
    return simhash.near_dedup(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of 20-word windows that also start earlier. Null texts stay null; repeated rows stay."""
    _small_batches(spark)
    found = substring.substring_dedup(docs)
    changed = {"text": F.col("kept"), "n_chars": F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("row.n_chars"))}
    return found.select(*[changed.get(c, F.col(f"row.`{c}`") if c != "text" else None).alias(c) for c in docs.columns])


def pii_pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms for personal data. Null texts stay null."""
    found = pii.pseudonymise(docs, PII_KEY, count_col=COUNT)
    return found.withColumn("n_chars", F.when(F.col(COUNT) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).drop(COUNT)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens; a null text is empty."""
    import public_tokenizers

    _small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), words_held=WORDS_HELD)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("pii", pii_pseudonyms), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each from a table that the one before has written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_path(spark, "corpus-pipeline")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs.write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
    return docs
