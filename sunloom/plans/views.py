"""The SQL twins of the domain tables, as CTE bodies for the oracle."""

from __future__ import annotations

K = "CAST(json_extract_string(props, '$.k') AS INT)"
GRADE = ("CASE WHEN value < 20 THEN 'A' WHEN value < 50 THEN 'B' WHEN value < 100 THEN 'C' "
         "WHEN value < 200 THEN 'D' ELSE 'E' END")
ALARM = ("CASE WHEN event_type = 'error' THEN CASE k % 4 WHEN 0 THEN 464 WHEN 1 THEN 559 WHEN 2 THEN 8 ELSE 39 END "
         "ELSE 0 END")
ISO = "'%Y-%m-%dT%H:%M:%S.%fZ'"

VIEWS = {
    "ek": f"SELECT *, {K} AS k FROM events",
    "tv": f"""SELECT event_id, concat('Plant ', user_id % 3 + 1) AS plant_id, concat('MAC-', user_id % 10) AS mac,
  user_id AS inverter_id, ts, value * 10 AS power, CAST(k AS DOUBLE) * 0.4::DOUBLE + 20 AS temp,
  CAST(k % 10 AS DOUBLE) AS pv1_current, CAST(event_id % 10 AS DOUBLE) AS pv2_current,
  CAST((k + event_id) % 10 AS DOUBLE) AS pv3_current, CAST(k + 500 AS DOUBLE) AS pv1_voltage,
  CAST(event_id % 20 + 230 AS DOUBLE) AS v_r, CAST(k % 15 AS DOUBLE) * 0.01::DOUBLE + 0.85::DOUBLE AS pf,
  CASE WHEN event_id % 3 <> 0 THEN event_id * 0.5::DOUBLE + k END AS kwh_total,
  CASE WHEN k % 4 = 0 THEN CAST(k % 7 AS DOUBLE) END AS limit_percent,
  {ALARM} AS alarm_code, CASE WHEN event_type = 'signup' THEN 0 WHEN event_type = 'purchase' AND k % 10 = 0 THEN 4608
  ELSE 5120 END AS op_state, {GRADE} AS category FROM ek""",
    "rd": f"""SELECT event_id AS reading_id, user_id AS inverter_id, ts, {GRADE} AS category, k / 100e0 AS confidence,
  ({GRADE}) IN ('C', 'D', 'E') AS is_faulty,
  CASE WHEN ({GRADE}) IN ('C', 'D', 'E') THEN concat('Fault ', {GRADE}) END AS fault_type,
  CAST(k * 8 + 20 AS DOUBLE) AS dc_voltage, CAST(event_id % 12 AS DOUBLE) AS dc_current, value - 10 AS ac_power,
  CAST(k AS DOUBLE) * 0.7::DOUBLE + 10 AS module_temp, CAST(event_id % 40 AS DOUBLE) AS ambient_temp,
  CAST((k * 11) % 1000 AS DOUBLE) AS irradiation, {ALARM} AS alarm_code,
  CASE WHEN event_type = 'signup' THEN 0 ELSE 5120 END AS op_state FROM ek""",
    "plants": """SELECT r_regionkey AS plant_id, r_name AS plant_name, CASE WHEN r_regionkey = 4 THEN 'decommissioned'
  WHEN r_regionkey = 3 THEN 'maintenance' ELSE 'active' END AS status, CAST(r_regionkey * 100 AS BIGINT) AS created_by
  FROM region""",
    "blocks": "SELECT n_nationkey AS block_id, n_regionkey AS plant_id, n_name AS block_name FROM nation",
    "inverters": """SELECT s_suppkey AS inverter_id, s_nationkey AS block_id, s_name AS inverter_name,
  greatest(s_acctbal, 0e0) / 100 AS capacity_kw,
  (['A', 'B', 'C', 'D', 'E', 'offline'])[s_suppkey % 6 + 1] AS current_category, s_suppkey % 7 <> 0 AS is_online
  FROM supplier""",
    "admins": "SELECT c_custkey AS admin_id, c_name AS name FROM customer WHERE c_mktsegment = 'MACHINERY'",
    "operators": """SELECT c_custkey AS operator_id, c_name AS name, c_acctbal > 0 AS is_active FROM customer
  WHERE c_mktsegment <> 'MACHINERY'""",
    "access": """SELECT c_custkey AS operator_id, n_regionkey AS plant_id FROM customer
  JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment <> 'MACHINERY' AND c_acctbal > -500
  UNION ALL SELECT c_custkey, (n_regionkey + 1) % 5 FROM customer JOIN nation ON c_nationkey = n_nationkey
  WHERE c_mktsegment <> 'MACHINERY' AND c_acctbal > 5000""",
    "alerts": """SELECT l_orderkey * 10 + l_linenumber AS alert_id, l_suppkey AS inverter_id, CASE l_returnflag
  WHEN 'R' THEN 'critical' WHEN 'A' THEN 'warning' ELSE 'info' END AS type, l_linestatus = 'F' AS acknowledged,
  CASE WHEN l_linestatus = 'F' THEN l_partkey END AS acknowledged_by, l_extendedprice AS weight,
  l_shipdate AS created_at FROM lineitem""",
    "audit": """SELECT o_orderkey AS log_id, o_custkey AS user_id, CASE o_orderstatus WHEN 'F' THEN 'admin'
  WHEN 'O' THEN 'operator' ELSE 'public' END AS user_role, o_orderpriority AS action, o_orderdate AS created_at,
  o_totalprice AS amount FROM orders""",
    "traces": f"""SELECT event_id AS run_id, event_type AS name,
  CASE WHEN k % 9 = 0 THEN 'error' WHEN k % 11 = 0 THEN 'pending' ELSE 'success' END AS status,
  CASE WHEN k % 13 <> 0 THEN strftime(ts, {ISO}) END AS start_time,
  CASE WHEN k % 17 = 0 THEN 'not a time' ELSE strftime(ts + to_microseconds(CAST(floor(value * 10000) AS BIGINT)),
  {ISO}) END AS end_time, CASE WHEN k % 5 <> 0 THEN k * 3 + 10 END AS prompt_tokens, k * 2 AS completion_tokens,
  CASE WHEN k % 5 <> 0 THEN k * 5 + 10 END AS total_tokens,
  CASE WHEN event_id % 5 <> 0 THEN event_id - event_id % 5 END AS parent_id, event_id % 5 = 0 AS is_root FROM ek""",
    "preds": """SELECT event_id AS prediction_id, user_id AS inverter_id, ts, k / 100e0 AS risk_score,
  CASE WHEN k / 100e0 >= 0.8e0 THEN 'shutdown_risk' WHEN k / 100e0 >= 0.4e0 THEN 'degradation_risk' ELSE 'no_risk' END
  AS risk_class, value, k FROM ek""",
    "shap": """SELECT prediction_id, inverter_id, ts, risk_score, risk_class, pos, feature, weight FROM (
  SELECT p.*, u.pos, (['inverters[0].power', 'inverters[0].temp', 'inverters[0].alarm_code', 'meters[0].freq',
   'meters[0].pf', 'smu[0].string3', 'sensors[0].ambient_temp', 'rolling_power_mean'])[u.pos] AS feature,
   CASE u.pos WHEN 1 THEN (value - 50) / 100 WHEN 2 THEN (k - 50) / 100e0 WHEN 3 THEN (prediction_id % 7 - 3) / 10e0
   WHEN 4 THEN (prediction_id % 11 - 5) / 20e0 WHEN 5 THEN (k % 5 - 2) / 50e0
   WHEN 6 THEN (prediction_id % 13 - 6) / 30e0 WHEN 7 THEN (k % 9 - 4) / 40e0 ELSE (prediction_id % 17 - 8) / 25e0 END
   AS weight FROM preds p, (SELECT unnest(range(1, 9)) AS pos) u)""",
    "raws": """SELECT prediction_id, pos, (['inverters[0].power', 'inverters[0].temp', 'inverters[0].alarm_code',
   'meters[0].pf', 'sensors[0].ambient_temp'])[pos] AS feature, CASE pos WHEN 1 THEN value * 10
   WHEN 2 THEN CAST(k AS DOUBLE) * 0.5::DOUBLE + 20 WHEN 3 THEN CAST(k % 4 AS DOUBLE) WHEN 4 THEN CAST(k AS DOUBLE) * 0.01::DOUBLE
   ELSE CAST(prediction_id % 40 AS DOUBLE) END AS raw FROM preds, (SELECT unnest(range(1, 6)) AS pos)""",
    "replies": """SELECT conv_id, turn, (['explanation', 'ticket', 'chat'])[key % 3 + 1] AS task,
  (['model-a', 'model-b', 'model-c'])[conv_id % 3 + 1] AS model,
  (['no_risk', 'degradation_risk', 'shutdown_risk'])[key % 3 + 1] AS risk_class, key,
  CASE key % 6 WHEN 0 THEN concat('Here it is:', chr(10), '```json', chr(10), body, chr(10), '```', chr(10), 'done')
   WHEN 1 THEN concat('I''m sorry, inverters[1].temp is 40 °C. ', text) WHEN 2 THEN concat(body, ' trailing')
   WHEN 3 THEN concat('Error: risk 0.5, you should inspect. ', text) ELSE body END AS response,
  length(text) / 100e0 AS latency_seconds, length(text) % 50 AS input_tokens,
  CASE WHEN turn % 4 <> 3 THEN length(text) END AS output_tokens,
  CASE WHEN key % 10 = 9 THEN 'timeout' END AS error, 30e0 + key % 40 AS t0, 39.8::DOUBLE AS t1
  FROM (SELECT *, concat('{"summary": "', translate(text, concat('"\\', chr(10), chr(13), chr(9)), '     '),
   '", "key_factors": [{"feature": "', (['power', 'inverters[9].temp'])[key % 2 + 1],
   '"}], "recommended_actions": ["check inverters[', key % 4, '].temp now at ', key % 60 + 20, '.5 °C"]',
   CASE WHEN key % 4 <> 3 THEN concat(', "urgency": "',
    (['immediate', 'Within_24h ', 'scheduled', 'routine', 'later'])[key % 5 + 1], '"') ELSE '' END,
   CASE WHEN key % 2 = 0 THEN ', "title": "Risk", "priority": "P2-High", "description": "see the summary text"'
    ELSE '' END, '}') AS body FROM (SELECT *, conv_id + turn AS key FROM conversations))""",
}
# the telemetry of few devices, with long series
VIEWS["td"] = VIEWS["tv"].replace("user_id", "(user_id % 4)")
NEEDS = {"tv": ["ek"], "td": ["ek"], "rd": ["ek"], "traces": ["ek"], "preds": ["ek"], "shap": ["preds"], "raws": ["preds"]}


def with_views(names: tuple[str, ...], body: str) -> str:
    """`body` behind the CTEs it uses, dependencies first."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    body = body.strip()
    ctes = ", ".join(f"{n} AS ({VIEWS[n]})" for n in ordered)
    if body.upper().startswith("WITH "):
        return f"WITH {ctes}, {body[5:]}" if ctes else body
    return f"WITH {ctes} {body}" if ctes else body


def r(expression: str, places: int = 4) -> str:
    """Rounding both engines compute with the same floating-point steps.

    The cut sits a little below one half, so exact halves, where the last bit of a sum decides, are no edge.
    """
    return f"floor(({expression}) * 1e{places} + 0.4871e0) / 1e{places}"
