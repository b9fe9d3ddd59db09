"""Tables between pipeline stages, and the small sinks."""

from __future__ import annotations

import math
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESULT_SCHEMA = ("map<string, struct<display_name: string, provider: string, model_id: string, results: array<struct<"
                 "task: string, scenario_name: string, risk_class: string, response: string, latency_seconds: double, "
                 "input_tokens: int, output_tokens: int, error: string, evaluation: struct<overall_score: double, "
                 "json_validity: struct<score: double>, hallucination: struct<score: double>, "
                 "urgency_accuracy: struct<score: double>, completeness: struct<score: double>, "
                 "response_quality: struct<score: double>>>>>>")


def save_stage(df: DataFrame, folder: str, stage: str) -> DataFrame:
    """Write a stage and return it read back, so the next stage starts from files."""
    path = os.path.join(folder, stage)
    df.write.mode("overwrite").option("compression", "gzip").parquet(path)
    return df.sparkSession.read.parquet(path)


def load_stage(spark: SparkSession, folder: str, stage: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, stage))


def append_rows(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Append to a fact table, partitioned for pruning when `by` is given."""
    writer = df.write.mode("append")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_jdbc(spark: SparkSession, url: str, name: str, key: str, low: int, high: int, parts: int, **options) -> DataFrame:
    """A database table read in parallel ranges of a numeric key."""
    return (spark.read.format("jdbc").options(url=url, dbtable=name, partitionColumn=key, lowerBound=low,
                                              upperBound=high, numPartitions=parts, **options).load())


def read_quarantined(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """CSV rows that fit the schema and those that do not, with their raw text.

    Cells are read as text and cast here: Spark's own mark of a broken record looks only at the columns a query reads.
    """
    fields = T._parse_datatype_string(schema).fields
    texts = T.StructType([T.StructField(f.name, T.StringType()) for f in fields] + [T.StructField("_bad", T.StringType())])
    raw = (spark.read.schema(texts).option("header", True).option("mode", "PERMISSIVE").option("columnPruning", False)
           .option("columnNameOfCorruptRecord", "_bad").csv(path))
    typed = [F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in fields]
    fits = F.col("_bad").isNull()
    for f, value in zip(fields, typed):
        fits = fits & (F.col(f"`{f.name}`").isNull() | value.isNotNull())
    line = F.coalesce("_bad", F.to_csv(F.struct(*[F.col(f"`{f.name}`") for f in fields])))
    marked = raw.select(*typed, line.alias("_bad"), fits.alias("_fits"))
    return marked.where("_fits").drop("_bad", "_fits"), marked.where("NOT _fits").drop("_fits")


def write_results(results: DataFrame, path: str, per_document: int = 1000) -> None:
    """Study results as nested JSON documents keyed by model.

    A model with many responses gets several documents, so that no group grows with the data.
    """
    largest = results.groupBy("model").count().agg(F.max("count")).first()[0] or 1
    part = F.pmod(F.xxhash64("response", "task", "scenario_name", "latency_seconds"), F.lit(math.ceil(largest / per_document)))
    nested = results.groupBy("model", "display_name", "provider", "model_id", part.alias("part")).agg(
        F.collect_list(F.struct("task", "scenario_name", "risk_class", "response", "latency_seconds", "input_tokens",
                                "output_tokens", "error", "evaluation")).alias("results"))
    doc = F.to_json(F.create_map("model", F.struct("display_name", "provider", "model_id", "results")))
    nested.select(doc.alias("value")).write.mode("overwrite").text(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Study results back as one row per response."""
    docs = spark.read.option("wholetext", False).text(path).select(F.from_json("value", RESULT_SCHEMA).alias("doc"))
    models = docs.select(F.explode("doc").alias("model", "m"))
    return models.select("model", "m.display_name", "m.provider", "m.model_id", F.inline("m.results"))
