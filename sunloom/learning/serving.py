"""Stored risk models: training writes model, scaler, inputs and parameters, scoring jobs read them and grade readings."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sunloom.functions import grading
from sunloom.learning import boosting, scale

READING = ["module_temp", "irradiation", "dc_voltage", "dc_current", "ac_power", "alarm_code"]


@dataclass
class LinearModel:
    """Class margins as weighted sums of scaled inputs; probabilities by softmax."""
    weights: list[list[float]]
    biases: list[float]

    def probabilities(self, columns: list[str]) -> Column:
        margins = [sum((F.col(c) * F.lit(float(w)) for c, w in zip(columns, row)), F.lit(float(b))) for row, b in zip(self.weights, self.biases)]
        top = F.greatest(*margins)
        powers = [F.exp(m - top) for m in margins]
        total = sum(powers[1:], powers[0])
        return F.array(*[p / total for p in powers])


@dataclass
class RiskModel:
    """All that scoring needs: a boosted or a linear model, the scaler's one row, the inputs in order, the parameters."""
    model: boosting.Boosted | LinearModel
    scaler: DataFrame
    columns: list[str]
    params: dict

    def predict(self, scaled: DataFrame) -> DataFrame:
        """Adds `probabilities`."""
        if isinstance(self.model, LinearModel):
            return scaled.withColumn("probabilities", self.model.probabilities(self.columns))
        return boosting.predict(self.model, scaled, self.columns).drop("predicted")


def save_model(bundle: RiskModel, folder: str) -> None:
    """Everything below `folder`; a description is written last, so a folder with one is complete."""
    spark = bundle.scaler.sparkSession
    bundle.scaler.write.mode("overwrite").parquet(os.path.join(folder, "scaler"))
    about = {"columns": bundle.columns, "params": bundle.params}
    if isinstance(bundle.model, LinearModel):
        about["linear"] = {"weights": bundle.model.weights, "biases": bundle.model.biases}
    else:
        boosting.save(bundle.model, spark, os.path.join(folder, "model"))
    line = spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1)
    line.write.mode("overwrite").text(os.path.join(folder, "about"))


def load_model(spark: SparkSession, folder: str) -> RiskModel:
    about = json.loads(spark.read.text(os.path.join(folder, "about")).first()["value"])
    model = LinearModel(**about["linear"]) if "linear" in about else boosting.load(spark, os.path.join(folder, "model"))
    return RiskModel(model, spark.read.parquet(os.path.join(folder, "scaler")), about["columns"], about["params"])


def graded(rows: DataFrame, probabilities: Column) -> DataFrame:
    """Class, confidence, grade, fault wording and faulty flag of rows with class probabilities; works on streams and tables."""
    index = grading.best_class(probabilities)
    rows = rows.withColumns({"predicted_class": grading.class_name(index), "confidence": F.round(F.array_max(probabilities), 4),
                             "category": grading.grade(index, probabilities)})
    fault = grading.fault_text(F.col("category"), {n: F.col(n) for n in READING if n in rows.columns})
    return rows.withColumns({"fault_type": fault, "is_faulty": grading.is_faulty(F.col("category"))})


def score_readings(rows: DataFrame, bundle: RiskModel, mode: str = "manual") -> DataFrame:
    """`rows` with probabilities (four decimals), class, confidence, grade and fault.

    `manual` builds the inputs from the six core readings, others sit at their training means; `full` takes a feature table,
    absent features count as raw 0. Inputs are computed beside the rows' own columns of the same names and dropped again.
    """
    own = F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("__own")
    build = {"manual": scale.manual_vector, "full": scale.full_vector}[mode]
    inputs = build(rows.withColumn("__own", own), bundle.scaler, bundle.columns)
    scored = bundle.predict(inputs).select("__own", "probabilities").select("__own.*", "probabilities")
    scored = graded(scored, F.col("probabilities"))
    return scored.withColumn("probabilities", F.transform("probabilities", lambda p: F.round(p, 4)))
