"""Text tables to word-window chunks and hashed term vectors."""

from __future__ import annotations

import os

from pyspark.ml import PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sunloom import config

# Characters that separate words: Unicode white space and the four ASCII separators.
SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"

# The same for Spark's matcher, which looks up single characters below 256 in a table and asks for the others only beyond 1680.
SPLIT = (r"[ \t\n\x{0b}\f\r\x{1c}\x{1d}\x{1e}\x{1f}\x{85}\x{a0}[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}"
         r"\x{205f}\x{3000}]]]+")


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPLIT), "")


def word_windows(every: Column, size: int = config.CHUNK_WORDS, overlap: int = config.CHUNK_OVERLAP,
                 min_chars: int = config.CHUNK_MIN_CHARS) -> Column:
    """ARRAY of overlapping windows of `size` words; windows of `min_chars` characters or fewer are left out.

    `every` must be a stored column of words: an expression would be evaluated again for every window.
    """
    step = max(size - overlap, 1)
    starts = F.when(F.size(every) > 0, F.sequence(F.lit(0), F.size(every) - 1, F.lit(step))).otherwise(
        F.array().cast("array<int>"))
    windows = F.transform(starts, lambda s: F.array_join(F.slice(every, s + 1, size), " "))
    return F.filter(windows, lambda w: F.length(w) > min_chars)


def chunk_table(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Rows (key, chunk_id, chunk) over whole texts.

    The outer form of the generator: the inner one would have the optimiser test the array in a filter of its
    own first, so every text would be cut twice.
    """
    split = docs.select(key, words(F.col(text)).alias("__words"))
    cut = split.select(key, F.posexplode_outer(word_windows(F.col("__words"), **options)).alias("chunk_id", "chunk"))
    return cut.where(F.col("chunk").isNotNull())


def _counter(size: int) -> HashingTF:
    return HashingTF(inputCol="terms", outputCol="tf", numFeatures=size)


def counted(texts: DataFrame, column: str = "chunk", size: int = 256) -> DataFrame:
    """`texts` with their hashed term frequencies `tf`: stored, they let an encoder be fitted and applied without counting again."""
    return _counter(size).transform(texts.withColumn("terms", words(F.lower(column)))).drop("terms")


def fit_embedder(texts: DataFrame, column: str = "chunk", size: int = 256) -> PipelineModel:
    """Hashed term frequencies weighted by rarity, unit length. Any other encoder can take its place as a column."""
    counts = texts if "tf" in texts.columns else counted(texts, column, size)
    return PipelineModel([_counter(size), IDF(inputCol="tf", outputCol="weighted").fit(counts), Normalizer(inputCol="weighted", outputCol="unit")])


def save_store(chunks: DataFrame, model: PipelineModel, folder: str) -> None:
    """Chunks with their vectors, and the encoder that made them, for later searches."""
    model.write().overwrite().save(os.path.join(folder, "encoder"))
    chunks.write.mode("overwrite").parquet(os.path.join(folder, "chunks"))


def load_store(spark: SparkSession, folder: str) -> tuple[DataFrame, PipelineModel]:
    return spark.read.parquet(os.path.join(folder, "chunks")), PipelineModel.load(os.path.join(folder, "encoder"))


def embed(texts: DataFrame, model: PipelineModel, column: str = "chunk", out: str = "vector") -> DataFrame:
    counts = texts if "tf" in texts.columns else model.stages[0].transform(texts.withColumn("terms", words(F.lower(column)))).drop("terms")
    return PipelineModel(model.stages[1:]).transform(counts).withColumn(out, vector_to_array("unit")).drop("tf", "weighted", "unit")
