"""The training pipeline as stages: each reads the table before it and writes its own, so any stage can be rerun."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession

from sunloom import config
from sunloom.learning import attribution, boosting, forest, serving, tree_values, tuning
from sunloom.operators import anomaly, clean, features, labels
from sunloom.sources import ingest, stages

STAGES = ["ingest", "clean", "features", "labels", "anomaly", "train"]
DEFAULT_PARAMS = boosting.PARAMS


def run_stage(spark: SparkSession, name: str, source: str, folder: str, share: float = 1.0, **options) -> DataFrame:
    """Run one stage and return its stored table. `options` reach the stage's functions."""
    def before() -> DataFrame:
        return stages.load_stage(spark, folder, STAGES[STAGES.index(name) - 1])

    if name == "ingest":
        result = ingest.ingest(spark, source, share)
    elif name == "clean":
        result = clean.clean(before())
    elif name == "features":
        result = features.add_features(before(), frames=options.get("frames"), periods=options.get("periods"),
                                       daily=options.get("daily", "24h"))
    elif name == "labels":
        result = labels.add_labels(before(), rows=options.get("lookahead"), daily=options.get("daily", "24h"))
    elif name == "anomaly":
        scored = anomaly.add_zscores(before(), options.get("daily", "24h"))
        result = forest.add_isolation(scored, "row_id", trees=options.get("trees", config.FOREST_TREES))
    elif name == "train":
        return train(spark, before(), folder, **options)
    else:
        raise ValueError(f"unknown stage {name}")
    return stages.save_stage(result, folder, name)


def train(spark: SparkSession, table: DataFrame, folder: str, params: dict | None = None, trials: int = 0, **options) -> DataFrame:
    """Folds, optional search, metric report, the stored model and the five most important features as CSV."""
    columns = [c for c in clean.feature_columns(table) if c != "row_id"]
    prepared = tuning.prepare_folds(table, "risk_label", columns, "row_id", "timestamp", k=options.get("folds", config.FOLDS))
    params = params or DEFAULT_PARAMS
    if trials:
        params, _ = tuning.search(prepared["folds"], "risk_label", columns, trials, space=options.get("space", tuning.SEARCH_SPACE))
    report = stages.save_stage(tuning.fold_report(prepared, "risk_label", columns, params), folder, "train")
    model = boosting.fit(prepared["train"], "risk_label", columns, params)
    serving.save_model(serving.RiskModel(model, prepared["scaler"], columns, params), os.path.join(folder, "model"))
    credits = tree_values.attributions(model, prepared["test"], "row_id")
    stages.write_csv(attribution.top_features(attribution.global_importance(credits)), os.path.join(folder, "top_features"))
    return report


def run(spark: SparkSession, source: str, folder: str, only: str | None = None, share: float = 1.0, **options) -> DataFrame:
    """All stages, or one of them over the stored tables."""
    result = None
    for name in [only] if only else STAGES:
        result = run_stage(spark, name, source, folder, share, **options)
    return result


def main() -> None:
    parser = argparse.ArgumentParser(description="inverter risk pipeline")
    parser.add_argument("source")
    parser.add_argument("folder")
    parser.add_argument("--stage", choices=STAGES)
    parser.add_argument("--sample-frac", type=float, default=1.0)
    args = parser.parse_args()
    run(SparkSession.builder.getOrCreate(), args.source, args.folder, args.stage, args.sample_frac)


if __name__ == "__main__":
    main()
