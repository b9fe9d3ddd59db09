"""Scores of model replies, guardrail findings and fallback rows, as columns of the reply table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sunloom import config
from sunloom.functions import grading, texts
from sunloom.retrieval.chunks import words

FALSY = ["", "false", "0", "0.0", "[]", "{}", "null"]


def _given(reply: Column) -> Column:
    return F.coalesce(reply != "", F.lit(False))


def _truthy(fields: Column, name: str) -> Column:
    value = F.try_element_at(fields, F.lit(name))
    return F.coalesce(~value.isin(FALSY), F.lit(False))


def _filled(fields: Column, name: str) -> Column:
    value = F.try_element_at(fields, F.lit(name))
    return F.coalesce(~value.isin("", "[]", "{}"), F.lit(False))


def _per_task(task: Column, by_task: dict, default) -> Column:
    rule = F.when(F.lit(False), F.lit(None))
    for name, value in by_task.items():
        rule = rule.when(task == name, value)
    return rule.otherwise(default)


def json_validity(reply: Column, fields: Column, task: Column) -> Column:
    """0 without one JSON object, else half plus half the share of required fields. Parsing comes first, so a
    plain chat answer scores 0."""
    ratios = {t: F.size(F.array_intersect(F.map_keys(fields), F.array(*[F.lit(n) for n in names]))) / F.lit(float(len(names)))
              for t, names in config.REQUIRED_FIELDS.items()}
    score = 0.5 + 0.5 * _per_task(task, ratios, F.lit(1.0))
    return F.when(_given(reply) & fields.isNotNull(), F.round(score, 3)).otherwise(0.0)


def unknown_features(reply: Column, known: Column) -> Column:
    return F.array_except(texts.mentioned_features(reply), known)


def odd_temperatures(reply: Column, raw: Column) -> Column:
    """Temperatures in the reply that are half a degree or more from every temperature given."""
    actual = F.transform(F.filter(raw, lambda e: e["feature"].contains("temp")), lambda e: e["value"])
    far = F.filter(texts.mentioned_degrees(reply), lambda t: ~F.exists(actual, lambda a: F.abs(t - a) < 0.5))
    return F.when(F.size(actual) > 0, far).otherwise(F.array().cast("array<double>"))


def hallucination(reply: Column, known: Column, raw: Column) -> Column:
    issues = F.size(unknown_features(reply, known)) + F.size(odd_temperatures(reply, raw))
    return F.when(_given(reply), F.round(F.greatest(F.lit(0.0), 1.0 - issues * 0.2), 3)).otherwise(0.0)


def urgency(reply: Column, fields: Column, risk: Column, task: Column) -> Column:
    """1 for an expected urgency, 0.3 for a valid other one, 0 else; tasks other than explanation pass."""
    said = F.trim(F.lower(F.coalesce(F.try_element_at(fields, F.lit("urgency")), F.lit(""))))
    expected = reduce(lambda a, b: a | b, [(risk == c) & said.isin(v) for c, v in config.EXPECTED_URGENCY.items()])
    score = (F.when(~_given(reply) | fields.isNull(), 0.0).when(expected, 1.0)
             .when(said.isin(config.URGENCIES), 0.3).otherwise(0.0))
    return F.when(task != "explanation", 1.0).otherwise(score)


def completeness(reply: Column, fields: Column, task: Column) -> Column:
    """Share of the task's checks that pass."""
    low, number = F.lower(reply), reply.rlike(r"\d")
    checks = {
        "explanation": [_truthy(fields, "summary"), _filled(fields, "key_factors"), _filled(fields, "recommended_actions"),
                        _truthy(fields, "urgency"), _truthy(fields, "estimated_impact"), number,
                        texts.contains_any(low, ["shap", "feature", "impact", "factor"])],
        "ticket": [_truthy(fields, "title"), _truthy(fields, "priority"),
                   F.coalesce(F.length(F.try_element_at(fields, F.lit("description"))) > 20, F.lit(False)),
                   _truthy(fields, "root_cause_analysis"), _filled(fields, "recommended_actions"), _filled(fields, "safety_notes"),
                   F.coalesce(F.array_contains(F.map_keys(fields), "parts_needed"), F.lit(False))],
        "chat": [F.length(reply) > 50, number,
                 texts.contains_any(low, ["recommend", "suggest", "should", "action", "check", "inspect"]),
                 texts.contains_any(low, ["risk", "score", "sensor", "inverter"]), F.length(reply) < 2000],
    }
    shares = {t: sum((c.cast("int") for c in cs[1:]), cs[0].cast("int")) / F.lit(float(len(cs))) for t, cs in checks.items()}
    return F.when(_given(reply), F.round(_per_task(task, shares, F.lit(0.0)), 3)).otherwise(0.0)


def response_quality(reply: Column) -> Column:
    """1 minus a quarter per issue: refusal wording, an error-like start, fewer than 30 or more than 1500 words."""
    low, n = F.lower(reply), F.size(words(reply))
    issues = (texts.contains_any(low, config.REFUSALS).cast("int")
              + texts.contains_any(F.substring(low, 1, 100), config.ERROR_WORDS).cast("int")
              + ((n < 30) | (n > 1500)).cast("int"))
    return F.when(_given(reply), 1.0 - issues * 0.25).otherwise(0.0)


def overall(scores: dict[str, Column]) -> Column:
    weighted = [scores[name] * weight for name, weight in config.SCORE_WEIGHTS.items()]
    return F.round(sum(weighted[1:], weighted[0]), 3)


def evaluate(replies: DataFrame, reply: str = "response", known: str = "known", raw: str = "raw") -> DataFrame:
    """All scores of every reply; the reply is parsed once."""
    parsed = replies.withColumn("fields", texts.json_fields(F.col(reply)))
    text, fields, task = F.col(reply), F.col("fields"), F.col("task")
    scored = parsed.withColumns({
        "json_validity": json_validity(text, fields, task),
        "hallucination": hallucination(text, F.col(known), F.col(raw)),
        "urgency_accuracy": urgency(text, fields, F.col("risk_class"), task),
        "completeness": completeness(text, fields, task), "response_quality": response_quality(text)})
    return scored.withColumn("overall_score", overall({n: F.col(n) for n in config.SCORE_WEIGHTS})).drop("fields")


def violations(fields: Column, provided: Column) -> Column:
    """Cited factors that match no provided feature name, even in part, and an urgency that is not allowed."""
    cited = F.transform(F.from_json(F.try_element_at(fields, F.lit("key_factors")), "array<struct<feature:string>>"),
                        lambda f: f["feature"])
    bad = F.filter(F.coalesce(cited, F.array().cast("array<string>")),
                   lambda f: (F.coalesce(f, F.lit("")) != "") & ~F.exists(provided, lambda p: p.contains(f)))
    said = F.try_element_at(fields, F.lit("urgency"))
    wrong = F.when(~F.lower(F.coalesce(said, F.lit(""))).isin(config.URGENCIES),
                   F.concat(F.lit("invalid urgency: "), F.coalesce(said, F.lit("none"))))
    notes = F.transform(bad, lambda f: F.concat(F.lit("unknown factor: "), f))
    return F.array_compact(F.concat(notes, F.array(wrong)))


def parsed_or_fallback(reply: Column, fields: Column, chars: int = 500) -> Column:
    """The parsed explanation, or a row that carries the start of the raw text."""
    def get(name, default):
        return F.when(fields.isNull(), F.lit(default)).otherwise(F.coalesce(F.try_element_at(fields, F.lit(name)), F.lit("")))

    return F.struct(
        F.when(fields.isNull(), F.substring(reply, 1, chars)).otherwise(
            F.coalesce(F.try_element_at(fields, F.lit("summary")), F.lit(""))).alias("summary"),
        get("recommended_actions", '["Review raw model output manually."]').alias("recommended_actions"),
        F.when(fields.isNull(), F.lit("scheduled")).otherwise(
            F.coalesce(F.try_element_at(fields, F.lit("urgency")), F.lit("scheduled"))).alias("urgency"),
        fields.isNull().alias("is_fallback"))


def ticket_or_fallback(reply: Column, fields: Column, inverter: Column, score: Column, chars: int = 600) -> Column:
    """The parsed maintenance ticket, or one made from the score that carries the start of the raw text."""
    def get(name: str, default: Column) -> Column:
        return F.when(fields.isNull(), default).otherwise(F.coalesce(F.try_element_at(fields, F.lit(name)), F.lit("")))

    return F.struct(
        get("title", F.concat(F.lit("Risk Alert – "), inverter)).alias("title"),
        get("priority", grading.ticket_priority(score)).alias("priority"),
        get("description", F.substring(reply, 1, chars)).alias("description"),
        get("root_cause_analysis", F.lit("See description above.")).alias("root_cause_analysis"),
        get("recommended_actions", F.lit('["Manual review required."]')).alias("recommended_actions"),
        get("estimated_downtime", F.lit("TBD")).alias("estimated_downtime"), get("parts_needed", F.lit("[]")).alias("parts_needed"),
        get("safety_notes", F.lit('["Follow standard safety procedures."]')).alias("safety_notes"),
        F.when(fields.isNull(), score > 0.8).otherwise(
            F.lower(F.coalesce(F.try_element_at(fields, F.lit("escalation_needed")), F.lit("false"))) == "true").alias("escalation_needed"),
        fields.isNull().alias("is_fallback"))


# --------------------------------------------------------------------------- study tables
MEANS = {"avg_overall": "overall_score", "avg_json": "json_validity", "avg_hallucination": "hallucination",
         "avg_urgency": "urgency_accuracy", "avg_completeness": "completeness", "avg_quality": "response_quality",
         "avg_latency": "latency_seconds"}


def model_metrics(scored: DataFrame) -> DataFrame:
    """Per model over the replies without an error: means of scores, latency and tokens, share of usable JSON."""
    return (scored.groupBy("model").agg(F.count(F.lit(1)).alias("n_total"), *[
        F.avg(F.when(F.col("error").isNull(), F.col(c))).alias(n) for n, c in MEANS.items()],
        *[F.avg(F.when(F.col("error").isNull(), F.coalesce(f"{s}_tokens", F.lit(0)))).alias(f"avg_{s}_tokens")
          for s in ("input", "output")],
        F.count_if(F.col("error").isNull()).alias("n_valid"),
        F.avg(F.when(F.col("error").isNull(), (F.col("json_validity") >= 0.5).cast("int"))).alias("json_rate"))
        .where(F.col("n_valid") > 0))


def task_means(scored: DataFrame, tasks: tuple[str, ...] = ("explanation", "ticket", "chat")) -> DataFrame:
    """Mean overall score and latency per model, one column per task."""
    good = scored.where(F.col("error").isNull())
    return good.groupBy("model").agg(*[
        F.avg(F.when(F.col("task") == t, F.col(c))).alias(f"avg_{n}_{t}")
        for t in tasks for n, c in (("overall", "overall_score"), ("latency", "latency_seconds"))])


def leaderboard(metrics: DataFrame) -> DataFrame:
    """Models by mean score, and which is fastest. One row per model reaches the window."""
    one = Window.partitionBy(F.lit(1))
    return metrics.withColumn("rank", F.row_number().over(one.orderBy(F.desc("avg_overall"), "model"))).withColumn(
        "is_fastest", F.col("model") == F.min_by("model", F.struct("avg_latency", "model")).over(one))
