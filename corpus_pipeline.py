"""The corpus pipeline: five stages, each calling one operator on all its predecessor kept.

``run`` writes what a stage returns to the shared folder and reads it again as the next one's
documents, so that no stage is computed twice and a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.llm import bpe, decontam, language, neardup, pii, queries, textkit
from tallybook.llm.shared import stored
from tallybook.session import importable

#: A document whose best language has less than this share of the posterior is rejected.
LEAST_SHARE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognised language stay; those without a letter or a clear language go."""
    textkit.small_batches(spark)
    model = language.fit(docs.where(language.training_rows(docs)))
    label, share = textkit.fresh(docs, "lang_pred", "share")
    found = language.predict(docs, model, tuple(docs.columns), (label, share))
    return found.where((F.col(label) != "und") & (F.col(share) >= LEAST_SHARE)).select(*textkit.quoted(docs.columns))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    textkit.small_batches(spark)
    return neardup.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    textkit.small_batches(spark)
    return decontam.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked in the texts, and n_chars counted anew."""
    return pii.masked(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text (little-endian unsigned 32 bit) and a digest of the decoded text."""
    textkit.small_batches(spark)
    found = bpe.encode_documents(docs, queries.vocabulary_path())
    return found.select("doc_id", "n_tokens", "ids", F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("bpe", bpe_stage),
]
#: Trained models, min-hashes and byte pairs are beyond SQL; the tests check which rows of a small table
#: each stage keeps, and operators by themselves; there is no brute-force version of run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of ``sf_dir``."""
    importable(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
