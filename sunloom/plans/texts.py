"""Queries over text: chunks, retrieval, prompts, reply scores, traces and conversations."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from sunloom import config
from sunloom.functions import texts
from sunloom.operators import fleet, rollups, series
from sunloom.plans.registry import query, r
from sunloom.plans.views import r as R
from sunloom.responses import evaluate, prompts, traces
from sunloom.retrieval import chunks, latent, search, store
from sunloom.session import shared_folder, spread
from sunloom.sources import bindings as b

SPACE = chunks.SPACE


@query(f"""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS INT) AS chunk_id, md5(chunk) AS chunk FROM
  (SELECT doc_id, s, array_to_string(w[s + 1 : s + 80], ' ') AS chunk FROM (SELECT doc_id, w, unnest(range(0, len(w), 60)) AS s
   FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '{SPACE}'), lambda x: x <> '') AS w FROM documents)))
  WHERE length(chunk) > 50""")
def chunk_text(spark, folder):
    docs = spread(b.table(spark, folder, "documents").select("doc_id", "text"))
    cut = chunks.chunk_table(docs, size=80, overlap=20)
    return cut.select("doc_id", "chunk_id", F.md5("chunk").alias("chunk"))


CENTRES = """SELECT label, list(m ORDER BY i) AS q FROM (SELECT label, i, avg(v::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS v,
  unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY label, i) GROUP BY label"""


def _centres(spark, folder):
    """One query vector per label: the mean of its vectors."""
    cells = b.table(spark, folder, "embeddings").select("label", F.posexplode("embedding").alias("i", "v"))
    means = cells.groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    vector = F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda x: x["m"])
    return means.groupBy("label").agg(vector.alias("embedding"))


@query(f"""SELECT label AS query_id, vec_id, {R('s', 6)} AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY label
  ORDER BY round(s, 12) DESC, vec_id) AS rank FROM (SELECT c.label, e.vec_id, list_inner_product(e.embedding::DOUBLE[], c.q) /
  (sqrt(list_inner_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_inner_product(c.q, c.q)) + 1e-9) AS s
  FROM embeddings e, ({CENTRES}) c)) WHERE rank <= 5""")
def cosine_topk(spark, folder):
    vectors = b.table(spark, folder, "embeddings")
    queries = _centres(spark, folder).withColumnRenamed("label", "query_id")
    return search.top_k(vectors, queries, 5).select("query_id", "vec_id", r("score", 6).alias("score"),
                                                    F.col("rank").cast("bigint").alias("rank"))


def _self_search(spark, folder, exact):
    vectors = b.table(spark, folder, "embeddings").select("vec_id", "embedding")
    path = os.path.join(shared_folder(spark), f"index-{uuid.uuid4().hex}")
    held = store.build(vectors, path)
    asked = vectors.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    hits = store.search(held, asked, 5, exact=exact, folder=path)
    return hits.select("query_id", F.col("item").alias("vec_id"), r("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(f"""SELECT query_id, vec_id, {R('s', 6)} AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id)
  AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id, list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) /
  (sqrt(list_inner_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))) AS s
  FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q)) WHERE rank <= 5""")
def index_exact(spark, folder):
    """Every twentieth vector against all by the stored index, cells asked until their bounds exclude better hits."""
    return _self_search(spark, folder, True)


@query()
def index_search(spark, folder):
    """The same from the nearest cells only, by codes and exact scores of the best."""
    return _self_search(spark, folder, False)


@query()
def retrieved_context(spark, folder):
    """Chunks of all documents embedded by hashed terms and stored; benchmark texts are the queries; context of the best three."""
    docs = chunks.chunk_table(spread(b.table(spark, folder, "documents").select("doc_id", "text")), size=200, overlap=50)
    path = os.path.join(shared_folder(spark), f"store-{uuid.uuid4().hex}")
    # the encoder is fitted and applied: texts are cut and counted once
    docs = chunks.counted(docs.select(F.concat_ws("-", "doc_id", "chunk_id").alias("key"), "chunk"))
    docs.write.parquet(f"{path}/counts")
    docs = spark.read.schema(docs.schema).parquet(f"{path}/counts")
    fitted = chunks.fit_embedder(docs)
    chunks.save_store(chunks.embed(docs, fitted).select("key", "chunk", "vector"), fitted, path)
    docs, model = chunks.load_store(spark, path)
    asked = b.table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("chunk"))
    hits = search.top_k(docs.select("key", "vector"), chunks.embed(asked, model), 5, key="key", vector="vector")
    return search.context_text(hits.join(docs.select("key", "chunk"), "key"), "query_id", queries=asked)


@query()
def latent_context(spark, folder):
    """Chunks of all documents embedded by learnt directions and indexed; context of the best three for every benchmark text."""
    root = os.path.join(shared_folder(spark), f"latent-{uuid.uuid4().hex}")
    docs = chunks.chunk_table(spread(b.table(spark, folder, "documents").select("doc_id", "text")), size=200, overlap=50)
    docs = docs.select((F.col("doc_id") * 1_000_000 + F.col("chunk_id")).alias("key"), "chunk")
    docs.write.parquet(f"{root}/chunks")
    docs = spark.read.schema(docs.schema).parquet(f"{root}/chunks")
    latent.save(latent.fit(docs, f"{root}/passes"), spark, f"{root}/model")
    model = latent.load(spark, f"{root}/model")
    # the index reads the vectors three times
    latent.embed(docs, model, keep=["key"]).write.parquet(f"{root}/vectors")
    vectors = spark.read.schema("key bigint, vector array<double>").parquet(f"{root}/vectors")
    held = store.build(vectors, f"{root}/index", "key", "vector")
    asked = b.table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("chunk"))
    hits = store.search(held, latent.embed(asked, model), 5, vector="vector").withColumnRenamed("item", "key")
    return search.context_text(hits.join(docs, "key"), "query_id", queries=asked)


@query("""SELECT conv_id, string_agg(text, chr(10) || '---' || chr(10) ORDER BY turn DESC) AS context FROM (SELECT *,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 3 GROUP BY conv_id""")
def context_concat(spark, folder):
    turns = series.keep_last(b.table(spark, folder, "conversations"), ["conv_id"], "turn", 5)
    return search.context_text(turns.withColumnRenamed("text", "chunk"), "conv_id")


@query("""SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn
  FROM conversations) WHERE rn <= 3""")
def last_n_turns(spark, folder):
    return series.keep_last(b.table(spark, folder, "conversations"), ["conv_id"], "turn", 3).select("conv_id", "turn", "role")


@query("""SELECT conv_id, turn, role, length(text) AS n_chars FROM conversations ORDER BY turn DESC, conv_id LIMIT 50 OFFSET 10""")
def chat_log_page(spark, folder):
    logs = b.table(spark, folder, "conversations").withColumn("n_chars", F.length("text").cast("bigint"))
    return fleet.page(logs, [F.desc("turn"), F.col("conv_id")], 50, 10, cap=200).select("conv_id", "turn", "role", "n_chars")


# ------------------------------------------------------------------ attribution text
@query(f"""SELECT prediction_id, feature, {R('weight')} AS weight, row_number() OVER (PARTITION BY prediction_id ORDER BY abs(weight) DESC,
  feature) AS rank FROM shap QUALIFY rank <= 5""", ("shap",))
def topk_attribution(spark, folder):
    top = texts.ranked_entries(F.col("shap"), 5)
    return spread(b.predictions(spark, folder)).select("prediction_id", F.inline_outer(top)).where(F.col("feature").isNotNull()).select(
        "prediction_id", "feature", r("value").alias("weight"), F.col("rank").cast("bigint").alias("rank"))


def _phrase(rules):
    return "CASE " + " ".join(f"WHEN contains(feature, '{a}') THEN '{w}'" for a, w in rules) + " END"


def _search_sql(lead, rules):
    return f"""SELECT prediction_id, concat_ws(' ', any_value({lead}), string_agg(p, ' ' ORDER BY rank)) AS q FROM (SELECT *, {_phrase(rules)} AS p
  FROM (SELECT *, row_number() OVER (PARTITION BY prediction_id ORDER BY abs(weight) DESC, feature) AS rank FROM shap) WHERE rank <= 3)
  GROUP BY prediction_id"""


@query(_search_sql("concat('inverter ', risk_class)", config.EXPLAIN_PHRASES), ("shap",))
def search_query(spark, folder):
    return b.predictions(spark, folder).select("prediction_id", prompts.retrieval_query(F.col("shap"), F.col("risk_class")).alias("q"))


@query(_search_sql("'troubleshooting maintenance'", config.TICKET_PHRASES), ("shap",))
def troubleshooting_query(spark, folder):
    return b.predictions(spark, folder).select("prediction_id", prompts.troubleshooting_query(F.col("shap")).alias("q"))


@query("""SELECT prediction_id, concat(feature, ' (', CAST(floor(abs(weight) * 100 + 0.5) AS INT), '% impact) — ',
  CASE WHEN weight > 0 THEN 'value is significantly above normal range' ELSE 'value is below expected range' END) AS sentence FROM
  (SELECT *, row_number() OVER (PARTITION BY prediction_id ORDER BY abs(weight) DESC, feature) AS rank FROM shap) WHERE rank = 1
  AND risk_class <> 'no_risk'""", ("shap",))
def factor_sentence(spark, folder):
    """Shown for risky predictions only."""
    top = F.get(texts.top_by_size(F.col("shap"), 1), F.lit(0))
    rows = b.predictions(spark, folder).where(F.col("risk_class") != "no_risk").withColumn("top", top)
    return rows.select("prediction_id", texts.factor_sentence(F.col("top")).alias("sentence"))


@query("""SELECT prediction_id, concat('Inverter: INV-', inverter_id, chr(10), 'Factors:', chr(10), string_agg(concat('  • ', feature, ': ',
  printf('%+.4f', weight)), chr(10) ORDER BY abs(weight) DESC, feature)) AS text FROM (SELECT *, row_number() OVER
  (PARTITION BY prediction_id ORDER BY abs(weight) DESC, feature) AS rank FROM shap) WHERE rank <= 3 GROUP BY prediction_id, inverter_id""",
       ("shap",))
def factor_lines(spark, folder):
    line = F.transform(texts.top_by_size(F.col("shap"), 3), lambda e: F.concat(
        F.lit("  • "), e["feature"], F.lit(": "), F.format_string("%+.4f", e["value"])))
    return b.predictions(spark, folder).select("prediction_id", F.concat(
        F.lit("Inverter: INV-"), F.col("inverter_id").cast("string"), F.lit("\nFactors:\n"), F.array_join(line, "\n")).alias("text"))


def _prompt_rows(rows):
    return {"inverter_id": F.concat(F.lit("INV-"), F.col("inverter_id").cast("string")),
            "plant": F.concat(F.lit("Plant "), (F.col("inverter_id") % 3 + 1).cast("string")), "risk_score": F.col("risk_score"),
            "risk_class": F.col("risk_class"), "shap": F.col("shap"), "raw": F.col("raw"),
            "context": F.lit("No inverter-manual context available.")}


_TASKS = ", ".join("('{}', '{}')".format(t, text.replace("'", "''")) for t, text in prompts.INSTRUCTIONS.items())


@query(f"""WITH f AS (SELECT prediction_id, string_agg(line, chr(10) ORDER BY rank) FILTER (rank <= 10) AS factors,
  string_agg(short, ', ' ORDER BY rank) FILTER (rank <= 3) AS few FROM (SELECT s.prediction_id, row_number() OVER (PARTITION BY s.prediction_id
   ORDER BY abs(weight) DESC, s.feature) AS rank, concat('  • ', s.feature, ': ', printf('%+.4f', weight), '  (raw value: ',
   coalesce(CAST(raw AS VARCHAR), 'N/A'), ')') AS line, concat(s.feature, ': ', printf('%+.3f', CAST(round(CAST(CAST(weight AS VARCHAR) AS DECIMAL(30, 20)), 3) AS DOUBLE))) AS short FROM shap s
   LEFT JOIN raws r ON r.prediction_id = s.prediction_id AND r.feature = s.feature) GROUP BY prediction_id),
  g AS (SELECT prediction_id, string_agg(concat('  • ', feature, ': ', CAST(raw AS VARCHAR)), chr(10) ORDER BY pos) AS readings FROM raws
   WHERE pos <= 15 GROUP BY prediction_id)
  SELECT prediction_id, task, system_prompt, CASE task WHEN 'chat' THEN concat(inverter, ' | ', plant, ' | risk=', printf('%.2f', risk_score),
   ' | class=', risk_class, ' | factors=[', few, ']') ELSE concat_ws(chr(10), concat('Inverter: ', inverter), concat('Plant: ', plant),
   concat('Risk: ', printf('%.4f', risk_score), ' (', risk_class, ')'), 'Factors:', factors, 'Readings:', readings, 'Manual:',
   'No inverter-manual context available.') END AS user_prompt FROM (SELECT *, concat('INV-', inverter_id) AS inverter,
   concat('Plant ', inverter_id % 3 + 1) AS plant FROM preds) JOIN f USING (prediction_id) JOIN g USING (prediction_id),
   (VALUES {_TASKS}) t(task, system_prompt)""", ("preds", "shap", "raws"))
def prompt_table(spark, folder):
    """Three prompts per prediction: explanation, ticket and chat."""
    cases = prompts.test_cases(spread(b.predictions(spark, folder)))
    rows = _prompt_rows(cases)
    text = F.when(F.col("task") == "chat", prompts.chat_line(rows)).otherwise(prompts.user_prompt(rows))
    return cases.select("prediction_id", "task", "system_prompt", text.alias("user_prompt"))


@query("""SELECT prediction_id, risk_class, task FROM preds, (VALUES ('explanation'), ('ticket'), ('chat')) t(task)""", ("preds",))
def test_cases(spark, folder):
    return prompts.test_cases(b.predictions(spark, folder)).select("prediction_id", "risk_class", "task")


@query("""SELECT plant, inverter_id, risk_class, floor(risk_score * 1e4 + 0.4871e0) / 1e4 AS risk_score, string_agg(concat(feature, ': ',
  printf('%+.4f', weight)), ', ' ORDER BY abs(weight) DESC, feature) AS factors FROM (SELECT *, concat('Plant ', inverter_id % 3 + 1) AS plant,
  row_number() OVER (PARTITION BY prediction_id ORDER BY abs(weight) DESC, feature) AS rank, row_number() OVER (PARTITION BY inverter_id, pos
  ORDER BY ts DESC, prediction_id DESC) AS newest FROM shap) WHERE rank <= 5 AND newest = 1 GROUP BY ALL""", ("shap",))
def plant_risk_factors(spark, folder):
    """The newest prediction of every inverter with its five main factors, per plant."""
    newest = series.latest(b.predictions(spark, folder), ["inverter_id"], "ts", "prediction_id")
    return newest.select(F.concat(F.lit("Plant "), (F.col("inverter_id") % 3 + 1).cast("string")).alias("plant"), "inverter_id",
                         "risk_class", r("risk_score").alias("risk_score"),
                         texts.short_factors(texts.top_by_size(F.col("shap"), 5)).alias("factors"))


@query("""SELECT concat('Plant ', inverter_id % 3 + 1) AS plant, risk_class, count(*) AS n, count(DISTINCT inverter_id) AS inverters
  FROM preds GROUP BY ALL""", ("preds",))
def prediction_listing(spark, folder):
    rows = b.predictions(spark, folder).select("inverter_id", "risk_class", F.concat(
        F.lit("Plant "), (F.col("inverter_id") % 3 + 1).cast("string")).alias("plant"))
    return rows.groupBy("plant", "risk_class").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("inverter_id").alias("inverters"))


# ------------------------------------------------------------------ reply scores
JSON_TEXT = r"trim(CASE WHEN regexp_matches(response, '```(?:json)?\s*([\s\S]*?)```') THEN regexp_extract(response, '```(?:json)?\s*([\s\S]*?)```', 1) ELSE response END, chr(10) || chr(9) || ' ')"
PARSED = f"""(SELECT *, CASE WHEN json_valid({JSON_TEXT}) AND json_type({JSON_TEXT}) = 'OBJECT' THEN {JSON_TEXT} END AS j FROM replies)"""


def _has(*names):
    return " + ".join(f"CAST(json_exists(j, '$.{n}') AS INT)" for n in names)


VALIDITY = f"""CASE WHEN j IS NULL THEN 0 WHEN task = 'chat' THEN 1e0
  WHEN task = 'explanation' THEN 0.5e0 + 0.5e0 * ({_has('summary', 'key_factors', 'recommended_actions', 'urgency')}) / 4
  ELSE 0.5e0 + 0.5e0 * ({_has('title', 'priority', 'description', 'root_cause_analysis', 'recommended_actions')}) / 5 END"""
BAD_FEATURES = r"len(list_filter(list_distinct(regexp_extract_all(response, '(?:inverters|meters|sensors|smu)\[\d+\]\.\w+')), lambda x: x NOT IN ('inverters[0].temp', 'inverters[1].temp', 'meters[0].pf')))"
BAD_TEMPS = r"len(list_filter(list_distinct(list_transform(regexp_extract_all(response, '(\d+\.?\d*)\s*°C', 1), lambda x: x::DOUBLE)), lambda t: abs(t - t0) >= 0.5 AND abs(t - t1) >= 0.5))"
HALLU = f"greatest(0e0, 1 - 0.2e0 * ({BAD_FEATURES} + {BAD_TEMPS}))"
SAID = "trim(lower(coalesce(json_extract_string(j, '$.urgency'), '')))"
URGENCY = f"""CASE WHEN task <> 'explanation' THEN 1 WHEN j IS NULL THEN 0 WHEN (risk_class = 'no_risk' AND {SAID} IN ('routine', 'scheduled'))
  OR (risk_class = 'degradation_risk' AND {SAID} IN ('within_24h', 'scheduled')) OR (risk_class = 'shutdown_risk' AND {SAID} IN
  ('immediate', 'within_24h')) THEN 1 WHEN {SAID} IN ('immediate', 'within_24h', 'scheduled', 'routine') THEN 0.3e0 ELSE 0 END"""


def _any(text, options):
    return "CAST(" + " OR ".join("contains({}, '{}')".format(text, w.replace("'", "''")) for w in options) + " AS INT)"


COMPLETE = f"""CASE task WHEN 'explanation' THEN (coalesce({_has('summary')}, 0) + coalesce({_has('key_factors')}, 0)
   + coalesce({_has('recommended_actions')}, 0) + coalesce({_has('urgency')}, 0) + CAST(regexp_matches(response, '\\d') AS INT)
   + {_any('lower(response)', ['shap', 'feature', 'impact', 'factor'])}) / 7e0
  WHEN 'ticket' THEN (coalesce({_has('title')}, 0) + coalesce({_has('priority')}, 0) + coalesce(CAST(length(json_extract_string(j,
   '$.description')) > 20 AS INT), 0) + coalesce({_has('recommended_actions')}, 0)) / 7e0
  ELSE (CAST(length(response) > 50 AS INT) + CAST(regexp_matches(response, '\\d') AS INT)
   + {_any('lower(response)', ['recommend', 'suggest', 'should', 'action', 'check', 'inspect'])}
   + {_any('lower(response)', ['risk', 'score', 'sensor', 'inverter'])} + CAST(length(response) < 2000 AS INT)) / 5e0 END"""
NWORDS = f"len(list_filter(regexp_split_to_array(response, '{SPACE}'), lambda x: x <> ''))"
QUALITY = f"""1 - 0.25e0 * ({_any('lower(response)', ["i cannot", "i'm sorry", "as an ai", "i don't have access", "i am unable"])}
  + {_any('left(lower(response), 100)', ['error', 'exception', 'traceback', 'undefined'])} + CAST({NWORDS} < 30 OR {NWORDS} > 1500 AS INT))"""
SCORED = f"""(SELECT *, round(0.25e0 * json_validity + 0.25e0 * hallucination + 0.1e0 * urgency_accuracy + 0.25e0 * completeness
  + 0.15e0 * response_quality, 3) AS overall_score FROM (SELECT *, round({VALIDITY}, 3) AS json_validity, {HALLU} AS hallucination,
  {URGENCY} AS urgency_accuracy, round({COMPLETE}, 3) AS completeness, {QUALITY} AS response_quality FROM {PARSED}))"""


def _replies(spark, folder):
    rows = spread(b.replies(spark, folder))
    return rows.withColumn("known", F.transform("raw", lambda e: e["feature"]))


def _scored(spark, folder):
    return evaluate.evaluate(_replies(spark, folder))


def _parsed(spark, folder):
    rows = _replies(spark, folder).withColumn("fields", texts.json_fields(F.col("response")))
    return rows, F.col("response"), F.col("fields"), F.col("task")


@query(f"SELECT conv_id, turn, {R('json_validity', 3)} AS score FROM {SCORED}", ("replies",))
def json_validity(spark, folder):
    rows, reply, fields, task = _parsed(spark, folder)
    return rows.select("conv_id", "turn", r(evaluate.json_validity(reply, fields, task), 3).alias("score"))


@query(f"SELECT conv_id, turn, {R('hallucination', 3)} AS score FROM {SCORED}", ("replies",))
def hallucination_score(spark, folder):
    score = evaluate.hallucination(F.col("response"), F.col("known"), F.col("raw"))
    return _replies(spark, folder).select("conv_id", "turn", r(score, 3).alias("score"))


@query(f"SELECT conv_id, turn, {R('urgency_accuracy', 3)} AS score FROM {SCORED}", ("replies",))
def urgency_score(spark, folder):
    rows, reply, fields, task = _parsed(spark, folder)
    return rows.select("conv_id", "turn", r(evaluate.urgency(reply, fields, F.col("risk_class"), task), 3).alias("score"))


@query(f"SELECT conv_id, turn, {R('completeness', 3)} AS score FROM {SCORED}", ("replies",))
def completeness_score(spark, folder):
    rows, reply, fields, task = _parsed(spark, folder)
    return rows.select("conv_id", "turn", r(evaluate.completeness(reply, fields, task), 3).alias("score"))


@query(f"SELECT conv_id, turn, {R('response_quality', 3)} AS score FROM {SCORED}", ("replies",))
def quality_score(spark, folder):
    return _replies(spark, folder).select("conv_id", "turn", r(evaluate.response_quality(F.col("response")), 3).alias("score"))


@query(f"""SELECT model, count(*) AS n_total, count_if(error IS NULL) AS n_valid, {', '.join(
    f"{R(f'avg(CASE WHEN error IS NULL THEN {c} END)', 3)} AS {n}" for n, c in evaluate.MEANS.items())},
  {R("avg(CASE WHEN error IS NULL THEN coalesce(output_tokens, 0) END)", 3)} AS avg_output_tokens,
  {R("avg(CASE WHEN error IS NULL THEN CAST(json_validity >= 0.5 AS INT) END)", 3)} AS json_rate FROM {SCORED} GROUP BY model""", ("replies",))
def model_metrics(spark, folder):
    names = [*evaluate.MEANS, "avg_output_tokens", "json_rate"]
    return evaluate.model_metrics(_scored(spark, folder)).select("model", "n_total", "n_valid", *[r(n, 3).alias(n) for n in names])


@query(f"""SELECT model, row_number() OVER (ORDER BY s DESC, model) AS rank, l = min(l) OVER () AS is_fastest FROM (SELECT model,
  avg(overall_score) AS s, avg(latency_seconds) AS l FROM {SCORED} WHERE error IS NULL GROUP BY model)""", ("replies",))
def model_leaderboard(spark, folder):
    board = evaluate.leaderboard(evaluate.model_metrics(_scored(spark, folder)))
    return board.select("model", F.col("rank").cast("bigint").alias("rank"), "is_fastest")


@query(f"""SELECT model, {', '.join(f"{R(f'avg(CASE WHEN task = {t!r} THEN {c} END)', 3)} AS avg_{n}_{t}" for t in
       ('explanation', 'ticket', 'chat') for n, c in (('overall', 'overall_score'), ('latency', 'latency_seconds')))}
  FROM {SCORED} WHERE error IS NULL GROUP BY model""", ("replies",))
def task_pivot(spark, folder):
    means = evaluate.task_means(_scored(spark, folder))
    return means.select("model", *[r(c, 3).alias(c) for c in means.columns if c != "model"])


@query(f"""SELECT conv_id, turn, concat_ws('; ', CASE WHEN f = 'inverters[9].temp' THEN 'unknown factor: inverters[9].temp' END,
  CASE WHEN lower(coalesce(u, '')) NOT IN ('immediate', 'within_24h', 'scheduled', 'routine') THEN
   concat('invalid urgency: ', coalesce(u, 'none')) END) AS notes FROM (SELECT *, json_extract_string(j, '$.key_factors[0].feature') AS f,
  json_extract_string(j, '$.urgency') AS u FROM {PARSED} WHERE j IS NOT NULL)""", ("replies",))
def guardrail_notes(spark, folder):
    """`power` is part of a provided name, `inverters[9].temp` is not."""
    fields = texts.json_fields(F.col("response"))
    rows = _replies(spark, folder).withColumn("fields", fields).where(F.col("fields").isNotNull())
    provided = F.concat(F.col("known"), F.array(F.lit("inverters[0].power")))
    return rows.select("conv_id", "turn", F.array_join(evaluate.violations(F.col("fields"), provided), "; ").alias("notes"))


@query(f"""SELECT conv_id, turn, j IS NULL AS is_fallback, md5(coalesce(json_extract_string(j, '$.summary'), left(response, 500))) AS summary,
  coalesce(json_extract_string(j, '$.urgency'), 'scheduled') AS urgency FROM {PARSED}""", ("replies",))
def reply_fallback(spark, folder):
    rows = _replies(spark, folder).withColumn("fields", texts.json_fields(F.col("response")))
    parsed = evaluate.parsed_or_fallback(F.col("response"), F.col("fields"))
    return rows.select("conv_id", "turn", parsed.alias("p")).select(
        "conv_id", "turn", "p.is_fallback", F.md5("p.summary").alias("summary"), "p.urgency")


@query(f"""SELECT plant, inverter_id, risk_class, floor(risk_score * 1e4 + 0.4871e0) / 1e4 AS risk_score,
  {R('max(raw) FILTER (pos = 1)', 2)} AS power, {R('max(raw) FILTER (pos = 2)', 2)} AS temp FROM (SELECT *,
  concat('Plant ', inverter_id % 3 + 1) AS plant FROM preds QUALIFY row_number() OVER (PARTITION BY inverter_id ORDER BY ts DESC,
  prediction_id DESC) = 1) JOIN raws USING (prediction_id) GROUP BY ALL""", ("preds", "raws"))
def plant_risk_report(spark, folder):
    """The newest prediction of every inverter with its power and temperature, per plant; the first device that has a value counts."""
    newest = series.latest(b.predictions(spark, folder), ["inverter_id"], "ts", "prediction_id")
    raw = texts.as_map(F.col("raw"))

    def first(name):
        return F.coalesce(*[F.try_element_at(raw, F.lit(f"inverters[{i}].{name}")) for i in (0, 1)])
    return newest.select(F.concat(F.lit("Plant "), (F.col("inverter_id") % 3 + 1).cast("string")).alias("plant"), "inverter_id", "risk_class",
                         r("risk_score").alias("risk_score"), r(first("power"), 2).alias("power"), r(first("temp"), 2).alias("temp"))


@query(f"""SELECT conv_id, turn, j IS NULL AS is_fallback, CASE WHEN j IS NULL THEN concat('Risk Alert – INV-', conv_id) ELSE
  coalesce(json_extract_string(j, '$.title'), '') END AS title, CASE WHEN j IS NULL THEN CASE WHEN key % 100 > 85 THEN 'P1-Critical'
  WHEN key % 100 > 60 THEN 'P2-High' ELSE 'P3-Medium' END ELSE coalesce(json_extract_string(j, '$.priority'), '') END AS priority,
  CASE WHEN j IS NULL THEN md5(left(response, 600)) END AS description, CASE WHEN j IS NULL THEN key % 100 > 80 END AS escalation_needed
  FROM {PARSED}""", ("replies",))
def ticket_fallback(spark, folder):
    """Tickets from replies; what is no JSON object becomes a ticket by the score."""
    rows = _replies(spark, folder).withColumn("fields", texts.json_fields(F.col("response")))
    ticket = evaluate.ticket_or_fallback(F.col("response"), F.col("fields"), F.concat(F.lit("INV-"), F.col("conv_id").cast("string")),
                                         ((F.col("conv_id") + F.col("turn")) % 100) / F.lit(100.0))
    rows = rows.select("conv_id", "turn", ticket.alias("t"))
    return rows.select("conv_id", "turn", "t.is_fallback", "t.title", "t.priority", F.when(F.col("t.is_fallback"), F.md5("t.description")).alias("description"),
                       F.when(F.col("t.is_fallback"), F.col("t.escalation_needed")).alias("escalation_needed"))


@query("""SELECT conv_id, turn, CASE WHEN risk_class = 'no_risk' THEN 0 ELSE 1 END AS asks_check FROM replies""", ("replies",))
def disclaimer_kind(spark, folder):
    note = texts.disclaimer(F.col("risk_class"))
    return _replies(spark, folder).select("conv_id", "turn", note.contains("Verify").cast("int").alias("asks_check"))


# ------------------------------------------------------------------ traces
TIMED = """(SELECT *, TRY_CAST(start_time AS TIMESTAMP) AS started, (epoch_us(TRY_CAST(end_time AS TIMESTAMP)) -
  epoch_us(TRY_CAST(start_time AS TIMESTAMP))) / 1e6 AS latency_s FROM traces)"""
STATS = f"""count(*) AS n, count_if(status = 'error') AS errors, count_if(status = 'success') AS successful, {R('avg(latency_s)')} AS avg_s,
  {R('min(latency_s)')} AS min_s, {R('max(latency_s)')} AS max_s, CAST(sum(coalesce(total_tokens, 0)) AS BIGINT) AS tokens,
  CAST(sum(coalesce(prompt_tokens, 0)) AS BIGINT) AS prompt_tokens, CAST(sum(coalesce(completion_tokens, 0)) AS BIGINT) AS completion_tokens,
  {R('avg(coalesce(total_tokens, 0))')} AS avg_tokens"""


def _stat_columns():
    whole = ["n", "errors", "successful", "tokens", "prompt_tokens", "completion_tokens"]
    return [*whole, *[r(c).alias(c) for c in ("avg_s", "min_s", "max_s", "avg_tokens")]]


@query(f"SELECT {STATS}, {R('count_if(status = $$success$$) * 100e0 / count(*)', 1)} AS success_rate FROM {TIMED}".replace("$$", "'"), ("traces",))
def trace_summary(spark, folder):
    rows = traces.summary(traces.timed(b.traces(spark, folder)))
    return rows.select(*_stat_columns(), r(F.col("successful") * 100.0 / F.col("n"), 1).alias("success_rate"))


@query(f"SELECT name, {STATS} FROM {TIMED} GROUP BY name", ("traces",))
def trace_by_name(spark, folder):
    return traces.by_name(traces.timed(b.traces(spark, folder))).select("name", *_stat_columns())


def _nearest(p):
    return f"list_sort(list(latency_s))[CAST(floor(count(latency_s) * {p}) AS INT) + 1]"


@query(f"""SELECT name, {R(_nearest('0.5e0'))} AS p50_s, {R(_nearest('0.95e0'))} AS p95_s FROM {TIMED} WHERE latency_s IS NOT NULL
  GROUP BY name""", ("traces",))
def trace_percentiles(spark, folder):
    rows = traces.percentiles(traces.timed(b.traces(spark, folder)), ["name"])
    return rows.select("name", r("p50_s").alias("p50_s"), r("p95_s").alias("p95_s"))


@query("""SELECT name, p, true AS within FROM (SELECT DISTINCT name FROM traces WHERE start_time IS NOT NULL AND end_time <> 'not a time'), (VALUES (0.5::DOUBLE), (0.95::DOUBLE)) t(p)""",
       ("traces",))
def latency_sketches(spark, folder):
    """Latency quantiles per name out of stored sketches per day; `within` says that the rank is right up to the stated bound."""
    rows = traces.timed(b.traces(spark, folder)).where(F.col("latency_s").isNotNull()).withColumn("day", F.to_date("started"))
    path = os.path.join(shared_folder(spark), f"sketches-{uuid.uuid4().hex}")
    rollups.sketched(rows, "latency_s", path, ["day", "name"])
    found = rollups.sketch_quantiles(spark.read.parquet(path), [0.5, 0.95], ["name"])
    # the share of rows at or below, and of those below, the estimate
    ranked = rows.select("name", "latency_s").join(F.broadcast(found), "name").groupBy("name", "p").agg(
        F.avg((F.col("latency_s") < F.col("value")).cast("int")).alias("below"), F.avg((F.col("latency_s") <= F.col("value")).cast("int")).alias("to"))
    inside = (F.col("below") <= F.col("p") + 0.005) & (F.col("to") >= F.col("p") - 0.005)
    return ranked.select("name", "p", inside.alias("within"))


@query(f"""SELECT run_id, name, status, {R('latency_s')} AS latency_s FROM {TIMED} WHERE is_root AND started >=
  (SELECT max(started) FROM {TIMED}) - INTERVAL 168 HOUR ORDER BY started DESC, run_id LIMIT 50""", ("traces",))
def fetch_traces(spark, folder):
    rows = b.traces(spark, folder)
    as_of = traces.timed(rows).agg(F.max("started")).scalar()
    return traces.fetch(rows, as_of, 168, 50).select("run_id", "name", "status", r("latency_s").alias("latency_s"))


@query("""SELECT p.run_id, count(c.run_id) AS n_children, string_agg(concat(c.run_id, ':', c.status), ',' ORDER BY c.run_id) AS steps
  FROM traces p LEFT JOIN traces c ON c.parent_id = p.run_id WHERE p.is_root GROUP BY p.run_id""", ("traces",))
def trace_children(spark, folder):
    line = F.transform("children", lambda c: F.concat(c["run_id"].cast("string"), F.lit(":"), c["status"]))
    return traces.with_children(b.traces(spark, folder)).select(
        "run_id", F.when(F.col("children").isNull(), 0).otherwise(F.size("children")).cast("bigint").alias("n_children"),
        F.array_join(line, ",").alias("steps"))


@query(f"SELECT run_id, start_time, {R('latency_s', 2)} AS latency_s, coalesce(total_tokens, 0) AS total_tokens FROM {TIMED}", ("traces",))
def trace_timeline(spark, folder):
    rows = traces.timeline(traces.timed(b.traces(spark, folder)))
    return rows.select("run_id", "start_time", r("latency_s", 2).alias("latency_s"),
                       F.coalesce("total_tokens", F.lit(0)).alias("total_tokens"))
