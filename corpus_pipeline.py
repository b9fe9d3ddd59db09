"""From raw documents to token ids: toxic texts, copies, near copies and benchmark passages go, the rest is encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of `docs`. A stage reads all
that the one before it kept, as a written table. Null texts, repeated rows, empty tables and further columns are treated as
the operators' docstrings say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sunloom.llm import bpe, decontaminate, exact, near, toxicity
from sunloom.llm.common import benchmark, documents, fresh, run_folder, staged

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Some stages learn or are no relational operation: there is no SQL for the whole.
ORACLE_SQL = None


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier scores below its threshold; it learns from the labels that aren't held out."""
    labels = spark.read.schema("doc_id bigint, toxic int").parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    score = fresh(docs.columns, "toxicity")
    return toxicity.scored(docs, toxicity.fit(docs, labels), out=score).where(F.col(score) < toxicity.THRESHOLD).drop(score)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one with the smallest id."""
    return exact.deduplicated(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 80 % or more of its shingles of five words, the one with the smallest id."""
    return near.deduplicated(docs, size=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ten benchmark words."""
    return decontaminate.clean(docs, benchmark(spark, sf_dir))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text."""
    ranks = public_tokenizers.path(RANKS)
    found = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), ranks, public_tokenizers.PATTERN)
    same = F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return found.select("doc_id", "lang", "source", "n_tokens", "ids", same.alias("round_trip"))


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("decontaminate", without_benchmark),
    ("byte_level_bpe", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each result written and read again."""
    folder, docs = run_folder(spark, "pipeline"), documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), folder, name)
    return STAGES[-1][1](spark, docs, sf_dir)
