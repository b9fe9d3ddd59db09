"""Prompt tables: the text a model would get, one row per prediction and task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunloom import config
from sunloom.functions import texts

INSTRUCTIONS = {
    "explanation": "Explain the prediction to a plant operator from the given values only. Reply with a JSON object "
                   "holding summary, key_factors, recommended_actions, urgency and estimated_impact.",
    "ticket": "Draft a maintenance ticket from the given values only. Reply with a JSON object holding title, priority, "
              "description, root_cause_analysis, recommended_actions, estimated_downtime, parts_needed, safety_notes "
              "and escalation_needed.",
    "chat": "Answer the operator's question from the given values only.",
}


def user_prompt(rows: dict[str, Column]) -> Column:
    """Identity, score, ranked factors, first raw values and context, in fixed sections."""
    return F.concat_ws(
        "\n", F.concat(F.lit("Inverter: "), rows["inverter_id"]), F.concat(F.lit("Plant: "), rows["plant"]),
        F.format_string("Risk: %.4f (%s)", rows["risk_score"], rows["risk_class"]), F.lit("Factors:"),
        texts.signed_lines(texts.top_by_size(rows["shap"], 10), rows["raw"]), F.lit("Readings:"),
        texts.raw_lines(rows["raw"]), F.lit("Manual:"), rows["context"])


def chat_line(rows: dict[str, Column]) -> Column:
    """One inverter on one line, as chat context."""
    return F.format_string("%s | %s | risk=%.2f | class=%s | factors=[%s]", rows["inverter_id"], rows["plant"], rows["risk_score"],
                           rows["risk_class"], texts.short_factors(texts.top_by_size(rows["shap"], 3), "%+.3f"))


def retrieval_query(shap: Column, risk: Column) -> Column:
    lead = F.concat(F.lit("inverter "), risk)
    return texts.search_phrase(lead, texts.top_by_size(shap, 3), config.EXPLAIN_PHRASES)


def troubleshooting_query(shap: Column) -> Column:
    return texts.search_phrase(F.lit("troubleshooting maintenance"), texts.top_by_size(shap, 3), config.TICKET_PHRASES)


def test_cases(scenarios: DataFrame) -> DataFrame:
    """Every scenario once per task; the three tasks are exploded in the row."""
    tasks = F.array(*[F.struct(F.lit(t).alias("task"), F.lit(text).alias("system_prompt")) for t, text in INSTRUCTIONS.items()])
    return scenarios.select("*", F.inline(tasks))
