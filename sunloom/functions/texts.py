"""Text helpers: JSON in replies, feature mentions, prompt lines and sentences."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

FENCE = r"```(?:json)?\s*([\s\S]*?)```"
MENTION = r"((?:inverters|meters|sensors|smu)\[\d+\]\.\w+)"
DEGREES = r"(\d+\.?\d*)\s*°C"


def clean_id(text: Column) -> Column:
    return F.translate(F.trim(text), "<>&", "")


def contains_any(text: Column, words: list[str]) -> Column:
    return text.rlike("|".join(re.escape(w) for w in words))


def has_text(field: Column, needle: str) -> Column:
    """Case-insensitive substring search."""
    return F.lower(field).contains(needle.lower())


def json_text(reply: Column) -> Column:
    """The fenced block when there is one, else the whole reply, trimmed."""
    blank = r"^\s+|\s+$"
    body = F.when(reply.rlike(FENCE), F.regexp_extract(reply, FENCE, 1)).otherwise(reply)
    return F.regexp_replace(body, blank, "")


def json_fields(reply: Column) -> Column:
    """MAP of the reply's top-level JSON fields as text; NULL when it is not one JSON object.

    Reading the text as the only element of an array makes trailing garbage an error.
    """
    wrapped = F.from_json(F.concat(F.lit("["), json_text(reply), F.lit("]")), "array<map<string,string>>",
                          {"mode": "PERMISSIVE"})
    # a one-element transform names the parsed value, so the text is parsed once
    single = F.transform(F.array(wrapped), lambda w: F.when(F.size(w) == 1, F.get(w, F.lit(0))))
    return F.get(single, F.lit(0))


def mentioned_features(reply: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(reply, F.lit(MENTION), 1))


def mentioned_degrees(reply: Column) -> Column:
    found = F.regexp_extract_all(reply, F.lit(DEGREES), 1)
    return F.array_distinct(F.transform(found, lambda x: x.cast("double")))


def top_by_size(entries: Column, k: int) -> Column:
    """The k {feature, value} entries with the largest |value|; equal sizes go by name."""
    def order(a, b):
        left, right = F.abs(a["value"]), F.abs(b["value"])
        by_name = F.when(a["feature"] < b["feature"], -1).when(a["feature"] > b["feature"], 1).otherwise(0)
        return F.when(left > right, -1).when(left < right, 1).otherwise(by_name)

    return F.slice(F.array_sort(entries, order), 1, k)


def ranked_entries(entries: Column, k: int) -> Column:
    """Top entries with size and 1-based rank, six decimals."""
    return F.transform(top_by_size(entries, k), lambda e, i: F.struct(
        e["feature"].alias("feature"), F.round(e["value"], 6).alias("value"),
        F.round(F.abs(e["value"]), 6).alias("size"), (i + 1).alias("rank")))


def as_map(entries: Column) -> Column:
    """Lookup form of {feature, value} entries with distinct names."""
    return F.map_from_entries(F.transform(entries, lambda e: F.struct(e["feature"], e["value"])))


def signed_lines(top: Column, raw: Column) -> Column:
    """One line per factor: name, signed weight, raw value or N/A; `top` and `raw` are {feature, value} entries."""
    def raw_value(name: Column) -> Column:
        return F.get(F.filter(raw, lambda x: x["feature"] == name), F.lit(0))["value"]

    line = F.transform(top, lambda e: F.concat(
        F.lit("  • "), e["feature"], F.lit(": "), F.format_string("%+.4f", e["value"]), F.lit("  (raw value: "),
        F.coalesce(raw_value(e["feature"]).cast("string"), F.lit("N/A")), F.lit(")")))
    return F.array_join(line, "\n")


def first_raw(entries: Column, k: int = 15) -> Column:
    """The first k raw values in their given order."""
    return F.slice(entries, 1, k)


def raw_lines(entries: Column, k: int = 15) -> Column:
    """A line for each of the first k raw values."""
    line = F.transform(first_raw(entries, k), lambda e: F.concat(
        F.lit("  • "), e["feature"], F.lit(": "), e["value"].cast("string")))
    return F.array_join(line, "\n")


def short_factors(top: Column, form: str = "%+.4f") -> Column:
    return F.array_join(F.transform(top, lambda e: F.concat(
        e["feature"], F.lit(": "), F.format_string(form, e["value"]))), ", ")


def search_phrase(lead: Column, top: Column, phrases: list[tuple[str, str]]) -> Column:
    """Retrieval query: the lead plus one phrase per top factor, by the first matching rule."""
    def phrase(name):
        rule = F.when(F.lit(False), F.lit(None).cast("string"))
        for part, words in phrases:
            rule = rule.when(name.contains(part), F.lit(words))
        return rule

    words = F.array_compact(F.transform(top, lambda e: phrase(e["feature"])))
    return F.concat_ws(" ", lead, words)


def factor_sentence(entry: Column) -> Column:
    """Main contributor in words."""
    side = F.when(entry["value"] > 0, "value is significantly above normal range").otherwise(
        "value is below expected range")
    percent = F.floor(F.abs(entry["value"]) * 100 + F.lit(0.5))
    return F.format_string("%s (%d%% impact) — %s", entry["feature"], percent, side)


def disclaimer(risk: Column) -> Column:
    """Origin note; risky classes add a request to verify on site."""
    base = "Generated from model predictions and feature attributions. Readings are quoted from telemetry."
    verify = " Verify critical readings on site before acting."
    return F.concat(F.lit(base), F.when(risk.isin("shutdown_risk", "degradation_risk"), verify).otherwise(""))
