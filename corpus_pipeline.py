"""A training-corpus pipeline over documents: toxicity, copies, near copies, secrets, packing.

Every stage but the last returns the columns of its input, whatever their
names, and each is written as Parquet before the next reads it.

Defined cases, for every stage: null and empty texts are clean, all alike for
exact deduplication (one of them stays), wordless for near deduplication (which
leaves them), without secrets, and packed as the separator alone; null ids come
after all others; rows that repeat an id are rows of their own, and of rows
that repeat both id and text one stays; ties go to the smallest id; a text may
be of any length; an empty table gives an empty result.  What a run writes lies
in the folder of spark.checkpoint.dir; ``run`` removes a stage's rows as soon as
the next stage is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from netloom.llm.exact_dedup import drop_copies
from netloom.llm.near_dup import keep_one
from netloom.llm.packing import pack
from netloom.llm.session import remove, shared_path
from netloom.llm.secret_scans import redact_secrets
from netloom.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores below 0.7."""
    return drop_toxic(spark, docs, sf_dir)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_copies(docs)


def near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a 5-word shingle Jaccard of 0.8 or more."""
    return keep_one(docs, k=5, percent=80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced."""
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents and their places in sequences of 2048 tokens."""
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard_join", near_dup),
    ("secret_scans", secrets),
    ("best_fit_packing", packing),
]

#: Models, graph search and tokenisation are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents, each stage's rows written as Parquet and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
