"""Queries over splits, scaling, scoring, metrics and attribution."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from sunloom import config
from sunloom.functions import grading, texts
from sunloom.functions.numeric import js_round
from sunloom.learning import attribution, boosting, forest, metrics, scale, serving, smote, tree_values, tuning
from sunloom.operators import ranking
from sunloom.plans.registry import query, r
from sunloom.plans.views import r as R
from sunloom.session import shared_folder, spread
from sunloom.sources import bindings as b
from sunloom.sources import stages

INPUTS = ["power", "temp", "pv1_current", "pf", "v_r"]


def _timed(spark, folder, *extra):
    tv = b.telemetry(spark, folder).select("event_id", "ts", *extra)
    return ranking.chronological(tv, "ts", "event_id"), tv.count()


@query("""SELECT event_id, pos, CASE WHEN pos < CAST(floor(n * 0.8e0) AS BIGINT) THEN 'train' ELSE 'test' END AS part FROM
  (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos, count(*) OVER () AS n FROM tv)""", ("tv",))
def chrono_split(spark, folder):
    placed, n = _timed(spark, folder)
    return placed.select("event_id", "pos", ranking.split_column(F.col("pos"), n).alias("part"))


@query("""WITH t AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos, count(*) OVER () AS n FROM tv),
  u AS (SELECT *, CAST(floor(n * 0.8e0) AS BIGINT) AS m, CAST(floor(n * 0.8e0) AS BIGINT) // 5 AS size FROM t)
  SELECT fold, CASE WHEN pos < size * (fold + 1) THEN 'train' ELSE 'val' END AS part, count(*) AS n_rows, min(pos) AS first_pos,
  max(pos) AS last_pos FROM u, (VALUES (1), (2), (3), (4)) f(fold) WHERE pos < least(size * (fold + 2), m) AND size * (fold + 1) < m GROUP BY ALL""", ("tv",))
def walk_forward_folds(spark, folder):
    placed, n = _timed(spark, folder)
    member = F.explode(ranking.fold_parts(F.col("pos"), ranking.train_rows(n))).alias("m")
    return placed.select("pos", member).groupBy(F.col("m.fold").alias("fold"), F.col("m.part").alias("part")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


TRAIN = """(SELECT * FROM (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos, count(*) OVER () AS n FROM tv)
  WHERE pos < CAST(floor(n * 0.8e0) AS BIGINT))"""


def _scaler(spark, folder, columns):
    """Fitted on the first four fifths in time: the row where they end is looked up, nothing is sorted."""
    tv = b.telemetry(spark, folder).select("event_id", "ts", *columns)
    cut = ranking.row_at(tv, "ts", "event_id", ranking.train_rows(tv.count()))
    return scale.fit_scaler(tv.where(ranking.earlier("ts", "event_id", cut)), columns)


def _mean(c):
    return f"(SELECT avg({c}) FROM {TRAIN})"


def _std(c):
    return f"(SELECT CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END FROM {TRAIN})"


@query(f"SELECT event_id, {', '.join(f'{R(f'({c} - {_mean(c)}) / {_std(c)}')} AS {c}' for c in INPUTS)} FROM tv", ("tv",))
def standardise(spark, folder):
    rows = b.telemetry(spark, folder).select("event_id", *INPUTS)
    return scale.scaled(rows, _scaler(spark, folder, INPUTS), INPUTS).select("event_id", *[r(c).alias(c) for c in INPUTS])


MANUAL = ["power", "temp", "pv1_voltage", "pf"]


@query(f"""SELECT reading_id, {R(f'(ac_power - {_mean("power")}) / {_std("power")}')} AS power,
  {R(f'(module_temp - {_mean("temp")}) / {_std("temp")}')} AS temp,
  {R(f'(dc_voltage - {_mean("pv1_voltage")}) / {_std("pv1_voltage")}')} AS pv1_voltage, 0e0 AS pf FROM rd""", ("tv", "rd"))
def manual_vector(spark, folder):
    rows = scale.manual_vector(b.readings(spark, folder), _scaler(spark, folder, MANUAL), MANUAL)
    return rows.select("reading_id", *[r(c).alias(c) for c in MANUAL])


#: A linear stand-in for a trained model: class weights per input of MANUAL, and class biases.
LINEAR = [[-0.9, -0.7, 0.4, 0.1], [0.2, 0.5, -0.1, 0.0], [0.7, 0.9, -0.6, -0.2]]
BIAS = [0.6, -0.1, -0.5]
Z = [f'(ac_power - {_mean("power")}) / {_std("power")}', f'(module_temp - {_mean("temp")}) / {_std("temp")}',
     f'(dc_voltage - {_mean("pv1_voltage")}) / {_std("pv1_voltage")}', "0e0"]
MARGIN = [" + ".join([f"{bias}e0", *[f"z{i} * {w}e0" for i, w in enumerate(row)]]) for row, bias in zip(LINEAR, BIAS)]
FAULT = """CASE category WHEN 'E' THEN CASE WHEN module_temp > 70 THEN 'Overheating — Thermal Shutdown Risk'
   WHEN irradiation < 300 THEN 'Grid Fault — Frequency Deviation'
   WHEN dc_voltage = 0 AND dc_current = 0 THEN 'Inverter Shutdown — Critical' ELSE 'Ground Fault — Insulation Failure' END
  WHEN 'D' THEN CASE WHEN dc_current < 5 THEN 'String Degradation' WHEN alarm_code <> 0 THEN
   concat('Alarm Code ', alarm_code, ' — Operational Fault') ELSE 'String Degradation' END
  WHEN 'C' THEN CASE WHEN ac_power < 5 THEN 'Low Power Output — String Issue' WHEN dc_voltage < 32 THEN
   'Partial Shading — Performance Loss' WHEN alarm_code <> 0 THEN concat('Communication Issue — Alarm Code ', alarm_code)
   ELSE 'Low Power Output — String Issue' END END"""


@query(f"""WITH z AS (SELECT * EXCLUDE (category), {', '.join(f'{e} AS z{i}' for i, e in enumerate(Z))} FROM rd),
  m AS (SELECT *, {', '.join(f'{e} AS m{i}' for i, e in enumerate(MARGIN))} FROM z),
  p AS (SELECT *, exp(m0 - greatest(m0, m1, m2)) AS e0, exp(m1 - greatest(m0, m1, m2)) AS e1, exp(m2 - greatest(m0, m1, m2)) AS e2 FROM m),
  c AS (SELECT *, [e0 / (e0 + e1 + e2), e1 / (e0 + e1 + e2), e2 / (e0 + e1 + e2)] AS p FROM p),
  g AS (SELECT *, list_position(p, list_max(p)) AS best, list_max(p) AS most FROM c),
  k AS (SELECT *, CASE WHEN best = 3 THEN 'E' WHEN best = 2 THEN CASE WHEN most >= 0.7e0 THEN 'D' ELSE 'C' END WHEN most >= 0.9e0 THEN 'A'
   WHEN most >= 0.7e0 THEN 'B' ELSE 'C' END AS category FROM g)
  SELECT reading_id, (['no_risk', 'degradation_risk', 'shutdown_risk'])[best] AS predicted_class, round(most, 4) AS confidence, category,
  {FAULT} AS fault, round(p[1], 4) AS p_no_risk, round(p[2], 4) AS p_degradation, round(p[3], 4) AS p_shutdown FROM k""", ("tv", "rd"))
def batch_predict(spark, folder):
    """Readings scored with a stored model: model, scaler and inputs are written, read back and applied."""
    path = os.path.join(shared_folder(spark), f"model-{uuid.uuid4().hex}")
    serving.save_model(serving.RiskModel(serving.LinearModel(LINEAR, BIAS), _scaler(spark, folder, MANUAL), MANUAL, {}), path)
    bundle = serving.load_model(spark, path)
    scored = serving.score_readings(b.readings(spark, folder), bundle)
    p = F.col("probabilities")
    return scored.select("reading_id", "predicted_class", "confidence", "category", F.col("fault_type").alias("fault"),
                         p[0].alias("p_no_risk"), p[1].alias("p_degradation"), p[2].alias("p_shutdown"))


@query(f"""SELECT event_id, {R(f'(power - {_mean("power")}) / {_std("power")}')} AS power,
  {R(f'(coalesce(kwh_total, 0) - {_mean("coalesce(kwh_total, 0)")}) / {_std("coalesce(kwh_total, 0)")}')} AS kwh_total FROM tv""", ("tv",))
def full_vector(spark, folder):
    columns = ["power", "kwh_total"]
    rows = b.telemetry(spark, folder).select("event_id", *columns)
    return scale.full_vector(rows, _scaler(spark, folder, columns), columns).select("event_id", *[r(c).alias(c) for c in columns])


@query("SELECT doc_id, lang, dense_rank() OVER (ORDER BY lang) - 1 AS label_index FROM documents")
def label_index(spark, folder):
    docs = b.table(spark, folder, "documents").select("doc_id", "lang")
    return scale.label_index(docs, "lang").select("doc_id", "lang", F.col("label_index").cast("bigint"))


@query("""SELECT quality, count(*) AS n, sum(x) AS x FROM (SELECT quality, CAST(toxic AS DOUBLE) AS x FROM labels
  UNION ALL SELECT c, 0e0 FROM (VALUES (0), (1), (2)) t(c) WHERE c NOT IN (SELECT quality FROM labels)) GROUP BY quality""")
def missing_classes(spark, folder):
    rows = b.table(spark, folder, "labels").select("quality", F.col("toxic").cast("double").alias("x"))
    return scale.add_missing_classes(rows, "quality", ["x"]).groupBy("quality").agg(
        F.count(F.lit(1)).alias("n"), F.sum("x").alias("x"))


GUESSED = """(SELECT lang, quality AS label, CAST(n_chars > 1500 AS INT) + CAST(n_chars > 12000 AS INT) AS predicted,
  least(n_chars / 20000e0, 1) AS s FROM labels JOIN documents USING (doc_id))"""


def _guessed(spark, folder):
    n = F.col("n_chars")
    s = F.least(n / F.lit(20000.0), F.lit(1.0))
    rows = b.table(spark, folder, "labels").join(b.table(spark, folder, "documents").drop("text"), "doc_id")
    return rows.select("lang", F.col("quality").alias("label"), ((n > 1500).cast("int") + (n > 12000).cast("int")).alias("predicted"),
                       F.array(1 - s, s).alias("scores"))


@query(f"SELECT lang, label, predicted, count(*) AS n FROM {GUESSED} GROUP BY ALL")
def confusion(spark, folder):
    return metrics.confusion(_guessed(spark, folder), ["lang"])


@query(f"""WITH g AS {GUESSED}, c AS (SELECT DISTINCT lang, x AS class FROM (SELECT lang, label AS x FROM g UNION ALL
  SELECT lang, predicted FROM g)), m AS (SELECT c.lang, c.class, count_if(label = class AND predicted = class) AS tp,
  count_if(label = class) AS s, count_if(predicted = class) AS q, count_if(label = predicted) AS hits, count(*) AS n
  FROM c JOIN g ON g.lang = c.lang GROUP BY c.lang, c.class)
  SELECT lang, {R('max(hits) / max(n)::DOUBLE')} AS accuracy, {R('avg(CASE WHEN q = 0 THEN 0 ELSE tp / q::DOUBLE END)')} AS "precision",
  {R('avg(CASE WHEN s = 0 THEN 0 ELSE tp / s::DOUBLE END)')} AS recall,
  {R('avg(CASE WHEN tp = 0 THEN 0 ELSE 2e0 * tp / (q + s) END)')} AS f1 FROM m GROUP BY lang""")
def macro_metrics(spark, folder):
    return metrics.macro_metrics(_guessed(spark, folder), ["lang"]).select(
        "lang", *[r(c).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@query(f"""WITH g AS (SELECT label, s FROM {GUESSED}), k AS (SELECT label, rank() OVER (ORDER BY s) +
  (count(*) OVER (PARTITION BY s) - 1) / 2e0 AS up, rank() OVER (ORDER BY s DESC) + (count(*) OVER (PARTITION BY s) - 1) / 2e0 AS down
  FROM g), n AS (SELECT count_if(label = 1)::DOUBLE AS p, count_if(label = 0)::DOUBLE AS q FROM g)
  SELECT {R('((u - p * (p + 1) / 2) / (p * q) + (d - q * (q + 1) / 2) / (p * q)) / 2')} AS auc FROM n,
  (SELECT sum(up) FILTER (label = 1) AS u, sum(down) FILTER (label = 0) AS d FROM k)""")
def macro_auc(spark, folder):
    return metrics.macro_auc(_guessed(spark, folder), "scores", 2).select(r("auc").alias("auc"))


WEIGHTS = [0.8, -0.5, 0.3, 1.2, -0.05]


@query(f"""SELECT feature, {R('avg(abs(z * w))')} AS importance FROM (SELECT unnest({INPUTS}) AS feature,
  unnest({WEIGHTS}::DOUBLE[]) AS w, unnest([{', '.join(f'({c} - {_mean(c)}) / {_std(c)}' for c in INPUTS)}]) AS z FROM tv)
  GROUP BY feature""", ("tv",))
def global_importance(spark, folder):
    rows = scale.scaled(spread(b.telemetry(spark, folder).select("event_id", *INPUTS)), _scaler(spark, folder, INPUTS), INPUTS)
    entries = rows.select(attribution.linear_entries(INPUTS, WEIGHTS).alias("entries"))
    return attribution.global_importance(entries).select("feature", r("importance").alias("importance"))


@query(f"""SELECT event_id, feature, {R('v')} AS value, row_number() OVER (PARTITION BY event_id ORDER BY abs(v) DESC, feature) AS rank
  FROM (SELECT event_id, unnest({INPUTS}) AS feature, unnest({WEIGHTS}::DOUBLE[]) * unnest([{', '.join(
      f'({c} - {_mean(c)}) / {_std(c)}' for c in INPUTS)}]) AS v FROM tv) QUALIFY rank <= 3""", ("tv",))
def linear_attribution(spark, folder):
    rows = scale.scaled(spread(b.telemetry(spark, folder).select("event_id", *INPUTS)), _scaler(spark, folder, INPUTS), INPUTS)
    top = texts.top_by_size(attribution.linear_entries(INPUTS, WEIGHTS), 3)
    return rows.select("event_id", F.posexplode_outer(top).alias("i", "e")).where(F.col("e").isNotNull()).select(
        "event_id", F.col("e.feature").alias("feature"), r("e.value").alias("value"), (F.col("i") + 1).cast("bigint").alias("rank"))




@query(f"""SELECT event_id, (['no_risk', 'degradation_risk', 'shutdown_risk'])[c] AS predicted, {R('best')} AS confidence,
  CASE WHEN c = 3 THEN 'E' WHEN c = 2 THEN CASE WHEN best >= 0.7e0 THEN 'D' ELSE 'C' END WHEN best >= 0.9e0 THEN 'A'
  WHEN best >= 0.7e0 THEN 'B' ELSE 'C' END AS category FROM (SELECT event_id, list_position(p, list_max(p)) AS c, list_max(p) AS best
  FROM (SELECT event_id, [x / (x + y + z + 1e-9), y / (x + y + z + 1e-9), z / (x + y + z + 1e-9)] AS p FROM (SELECT event_id,
  100e0 - k AS x, k / 2e0 AS y, CAST(event_id % 50 AS DOUBLE) AS z FROM ek)))""", ("ek",))
def grade_a_to_e(spark, folder):
    k = F.get_json_object("props", "$.k").cast("int")
    x, y, z = 100.0 - k, k / F.lit(2.0), (F.col("event_id") % 50).cast("double")
    total = x + y + z + F.lit(1e-9)
    rows = b.table(spark, folder, "events").select("event_id", F.array(x / total, y / total, z / total).alias("p"))
    best = grading.best_class(F.col("p"))
    return rows.withColumn("c", best).select(
        "event_id", grading.class_name(F.col("c")).alias("predicted"), r(F.array_max("p")).alias("confidence"),
        grading.grade(F.col("c"), F.col("p")).alias("category"))


@query("""SELECT reading_id, CASE category WHEN 'E' THEN CASE WHEN module_temp > 70 THEN 'Overheating — Thermal Shutdown Risk'
   WHEN irradiation < 300 THEN 'Grid Fault — Frequency Deviation'
   WHEN dc_voltage = 0 AND dc_current = 0 THEN 'Inverter Shutdown — Critical' ELSE 'Ground Fault — Insulation Failure' END
  WHEN 'D' THEN CASE WHEN dc_current < 5 THEN 'String Degradation' WHEN alarm_code <> 0 THEN
   concat('Alarm Code ', alarm_code, ' — Operational Fault') ELSE 'String Degradation' END
  WHEN 'C' THEN CASE WHEN ac_power < 5 THEN 'Low Power Output — String Issue' WHEN dc_voltage < 32 THEN
   'Partial Shading — Performance Loss' WHEN alarm_code <> 0 THEN concat('Communication Issue — Alarm Code ', alarm_code)
   ELSE 'Low Power Output — String Issue' END END AS fault FROM rd""", ("rd",))
def fault_text(spark, folder):
    rd = b.readings(spark, folder)
    names = ["module_temp", "irradiation", "dc_voltage", "dc_current", "ac_power", "alarm_code"]
    return rd.select("reading_id", grading.fault_text(F.col("category"), {n: F.col(n) for n in names}).alias("fault"))


@query("""SELECT prediction_id, CASE WHEN p IN ('no_risk', 'degradation_risk', 'shutdown_risk') THEN p ELSE 'no_risk' END AS risk_class
  FROM (SELECT prediction_id, CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN 'other' ELSE risk_class END AS p FROM preds)""", ("preds",))
def risk_class(spark, folder):
    k = F.round(F.col("risk_score") * 100).cast("int")
    p = F.when(k % 4 == 0, F.lit(None)).when(k % 4 == 1, "other").otherwise(F.col("risk_class"))
    return b.predictions(spark, folder).select("prediction_id", grading.risk_class(p).alias("risk_class"))


@query(f"""SELECT event_id, name, floor(p * 1000 + 0.5) / 10 AS percent FROM (SELECT event_id, unnest(['no risk', 'degradation risk',
  'shutdown risk']) AS name, unnest([(100 - k) / 100e0, k / 200e0, k / 200e0]) AS p FROM ek)""", ("ek",))
def probability_rows(spark, folder):
    k = F.get_json_object("props", "$.k").cast("int")
    values = [(100 - k) / F.lit(100.0), k / F.lit(200.0), k / F.lit(200.0)]
    pairs = F.map_from_arrays(F.array(*[F.lit(n) for n in config.CLASS_NAMES]), F.array(*values))
    rows = b.table(spark, folder, "events").select("event_id", F.explode(pairs).alias("name", "p"))
    return rows.select("event_id", F.regexp_replace("name", "^([^_]*)_", "$1 ").alias("name"),
                       js_round(F.col("p") * 100, 1).alias("percent"))


@query("""SELECT prediction_id, inverter_id, CASE WHEN risk_score > 0.85e0 THEN 'P1-Critical' ELSE 'P2-High' END AS priority,
  risk_score > 0.8e0 AS escalate, concat('TKT-', strftime(ts, '%Y%m%d'), '-',
  upper(substr(sha256(concat(inverter_id, '|', prediction_id)), 1, 6))) AS ticket_id FROM preds WHERE risk_score >= 0.8e0""", ("preds",))
def high_risk_tickets(spark, folder):
    score = F.col("risk_score")
    rows = b.predictions(spark, folder).where(grading.risk_band(score) == "critical")
    return rows.select("prediction_id", "inverter_id", grading.ticket_priority(score).alias("priority"), (score > 0.8).alias("escalate"),
                       grading.ticket_id(F.col("ts"), F.col("inverter_id").cast("string"),
                                         F.col("prediction_id").cast("string")).alias("ticket_id"))


FOREST = ["power", "temp", "pv1_current", "pf", "v_r"]


@query()
def isolation_forest(spark, folder):
    """Anomaly score and flag of every telemetry row; a published randomised method, so no SQL twin."""
    rows = spread(b.telemetry(spark, folder).select("event_id", *FOREST))
    return forest.add_isolation(rows, "event_id", FOREST).select(
        "event_id", r("iso_forest_score", 6).alias("score"), F.col("iso_forest_anomaly").alias("anomaly"))


LABEL = "CASE WHEN alarm_code IN (464, 559) THEN 2 WHEN alarm_code <> 0 OR op_state NOT IN (0, 5120) THEN 1 ELSE 0 END"
MODEL = INPUTS


def _labelled(spark, folder):
    """Inputs with a label from the row's own codes."""
    return b.telemetry(spark, folder).select("event_id", "ts", *MODEL, F.expr(LABEL).alias("label"))


def _scaled(rows):
    return scale.scaled(rows, scale.fit_scaler(rows, MODEL), MODEL)


@query(f"""WITH c AS (SELECT {LABEL} AS label, count(*) AS n FROM tv GROUP BY 1) SELECT label, 'real' AS kind, n FROM c
  UNION ALL SELECT label, 'synthetic', (SELECT max(n) FROM c) - n FROM c WHERE n < (SELECT max(n) FROM c)""", ("tv",))
def smote_balance(spark, folder):
    """Rows per class after balancing; the rows themselves are checked against brute force in the tests."""
    out = smote.balance(_scaled(_labelled(spark, folder)), "label", MODEL, "event_id")
    kind = F.when(F.col("is_synthetic"), "synthetic").otherwise("real")
    return out.groupBy("label", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def _trained(spark, folder, columns, params=boosting.PARAMS):
    """Stored rows (with their place in time and scaled inputs), the cut between training and test, the scaler, the model."""
    # boosting reads its input several times: train from a stored table
    path = os.path.join(shared_folder(spark), f"boosted-{uuid.uuid4().hex}")
    placed = ranking.chronological(b.telemetry(spark, folder).select("event_id", "ts", *columns, F.expr(LABEL).alias("label")), "ts", "event_id")
    placed = stages.save_stage(placed, path, "placed")
    cut = ranking.train_rows(placed.count())
    scaler = stages.save_stage(scale.fit_scaler(placed.where(F.col("pos") < cut), columns), path, "scaler")
    rows = stages.save_stage(scale.scaled(placed, scaler, columns), path, "rows")
    model = boosting.fit(rows.where(F.col("pos") < cut), "label", columns, params, key="event_id")
    return rows, cut, scaler, model


@query()
def boosted_report(spark, folder):
    """Boosted trees at the defaults (100 rounds of depth 5) on the first four fifths of the time line, metrics on both parts."""
    rows, cut, _, model = _trained(spark, folder, MODEL)
    scored = boosting.predict(model, rows, MODEL).withColumn("part", F.when(F.col("pos") < cut, "train").otherwise("test"))
    scored = stages.save_stage(scored.select("part", "label", "predicted", "probabilities"),
                               os.path.join(shared_folder(spark), f"report-{uuid.uuid4().hex}"), "scored")
    return boosting.report(scored, "label", ["part"])


@query()
def boosted_predict(spark, folder):
    """Readings scored with the boosted model that this run trains and stores: written, read back, applied, graded."""
    _, _, scaler, model = _trained(spark, folder, MANUAL)
    path = os.path.join(shared_folder(spark), f"model-{uuid.uuid4().hex}")
    serving.save_model(serving.RiskModel(model, scaler, MANUAL, model.params), path)
    scored = serving.score_readings(b.readings(spark, folder), serving.load_model(spark, path))
    p = F.col("probabilities")
    return scored.select("reading_id", "predicted_class", "confidence", "category", F.col("fault_type").alias("fault"),
                         p[0].alias("p_no_risk"), p[1].alias("p_degradation"), p[2].alias("p_shutdown"))


@query()
def tree_attribution(spark, folder):
    """Per class the mean size of each input's exact Shapley value, over all rows, by a model at the defaults."""
    rows, _, _, model = _trained(spark, folder, MODEL)
    return attribution.global_importance(tree_values.attributions(model, rows, "event_id"), by=["class"])


@query()
def tree_explanations(spark, folder):
    """For every test row the five inputs that count most for its class, with their exact Shapley values."""
    rows, cut, _, model = _trained(spark, folder, MODEL)
    scored = boosting.predict(model, rows.where(F.col("pos") >= cut), MODEL)
    told = tree_values.explanations(tree_values.attributions(model, scored, "event_id", "predicted"), ["event_id"])
    return told.select("event_id", "predicted", F.inline_outer("top_features"))


@query()
def fold_metrics(spark, folder):
    """Train and validation metrics of the walk-forward folds and of the hold-out test, balanced training parts."""
    prepared = tuning.prepare_folds(_labelled(spark, folder), "label", MODEL, "event_id", "ts")
    return tuning.fold_report(prepared, "label", MODEL, boosting.PARAMS)


@query()
def parameter_search(spark, folder):
    """40 drawn parameter sets over all nine ranges with their mean macro F1; after each walk-forward fold the better half goes on."""
    prepared = tuning.prepare_folds(_labelled(spark, folder), "label", MODEL, "event_id", "ts")
    best, tried = tuning.search(prepared["folds"], "label", MODEL, keep=0.5)
    names = list(tuning.SEARCH_SPACE)
    rows = [(i, len(s), float(sum(s) / len(s)) if s else None, p == best, *[float(p[n]) for n in names]) for i, (p, s) in enumerate(tried)]
    return spark.createDataFrame(rows, "trial int, folds int, f1 double, best boolean, " + ", ".join(f"{n} double" for n in names))
