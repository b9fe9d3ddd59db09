"""Domain tables over the generic test tables: telemetry, readings, fleet dimensions, alerts, traces, replies.

Every table here has a twin in `plans/views.py`, the SQL text the oracle runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# Declared schemas: no inference pass, and wall-clock columns read as TIMESTAMP in the session zone (UTC).
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp",
    "events": "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder.rstrip('/')}/{name}.parquet")


K = "cast(get_json_object(props, '$.k') AS int) AS k"
GRADE = ("CASE WHEN value < 20 THEN 'A' WHEN value < 50 THEN 'B' WHEN value < 100 THEN 'C' "
         "WHEN value < 200 THEN 'D' ELSE 'E' END")
ALARM = ("CASE WHEN event_type <> 'error' THEN 0 WHEN k % 4 = 0 THEN 464 WHEN k % 4 = 1 THEN 559 "
         "WHEN k % 4 = 2 THEN 8 ELSE 39 END")


#: Micro-batches that the events are dealt to where a query streams them, and rows of a file at least where a batch has several.
STREAM_PARTS, FILE_ROWS = 5, 10_000


def event_stream(spark: SparkSession, folder: str, root: str, arrival: str = "ts") -> DataFrame:
    """All events as a stream: dealt to files below `root` by `arrival`, the same number of files per micro-batch, the earliest first."""
    events = table(spark, folder, "events").withColumn("__arrival", F.expr(arrival).cast("double"))
    cuts = events.approxQuantile("__arrival", [i / STREAM_PARTS for i in range(1, STREAM_PARTS)], 0.01)
    parts = []
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = F.lit(True) if low is None else F.col("__arrival") >= low
        parts.append(part if high is None else part & (F.col("__arrival") < high))
    sizes = events.agg(*[F.count(F.when(part, 1)) for part in parts]).first()
    filled = [part for part, size in zip(parts, sizes) if size] or parts[:1]
    # a batch must not take a file of the next part: dealt in turns, no file of so many rows stays empty
    files = max(1, min(events.rdd.getNumPartitions(), FILE_ROWS, min([size for size in sizes if size], default=0) // FILE_ROWS))
    path = f"{root}/events"
    for part in filled:
        # one after the other: the source takes files in the order they were written
        rows = events.where(part).drop("__arrival")
        (rows.repartition(files) if files > 1 else rows.coalesce(1)).write.mode("append").parquet(path)
    return spark.readStream.schema(SCHEMAS["events"]).option("maxFilesPerTrigger", files).parquet(path)


def keyed_events(spark: SparkSession, folder: str, events: DataFrame | None = None) -> DataFrame:
    """Events with the number `k` out of their JSON properties."""
    rows = table(spark, folder, "events") if events is None else events
    return rows.selectExpr("event_id", "ts", "user_id", "event_type", "value", K)


#: Devices of `few_devices`: series long enough for frames of a day and for a week's look-ahead also on small tables.
FEW = 4


def few_devices(spark: SparkSession, folder: str, events: DataFrame | None = None) -> DataFrame:
    """All telemetry, or a stream of it, dealt to few devices with long series."""
    return telemetry(spark, folder, keyed_events(spark, folder, events).withColumn("user_id", F.col("user_id") % FEW))


def telemetry(spark: SparkSession, folder: str, keyed: DataFrame | None = None) -> DataFrame:
    return (keyed_events(spark, folder) if keyed is None else keyed).selectExpr(
        "event_id", "concat('Plant ', user_id % 3 + 1) AS plant_id", "concat('MAC-', user_id % 10) AS mac",
        "user_id AS inverter_id", "ts", "value * 10 AS power", "k * 0.4D + 20 AS temp",
        "cast(k % 10 AS double) AS pv1_current", "cast(event_id % 10 AS double) AS pv2_current",
        "cast((k + event_id) % 10 AS double) AS pv3_current", "cast(k + 500 AS double) AS pv1_voltage",
        "cast(event_id % 20 + 230 AS double) AS v_r", "(k % 15) * 0.01D + 0.85D AS pf",
        "CASE WHEN event_id % 3 <> 0 THEN event_id * 0.5D + k END AS kwh_total",
        "CASE WHEN k % 4 = 0 THEN cast(k % 7 AS double) END AS limit_percent", f"{ALARM} AS alarm_code",
        "CASE WHEN event_type = 'signup' THEN 0 WHEN event_type = 'purchase' AND k % 10 = 0 THEN 4608 ELSE 5120 END "
        "AS op_state", f"{GRADE} AS category")


def readings(spark: SparkSession, folder: str, events: DataFrame | None = None) -> DataFrame:
    """Scored readings: the fact table of the dashboards, or a stream of them."""
    return keyed_events(spark, folder, events).selectExpr("*", f"{GRADE} AS category").selectExpr(
        "event_id AS reading_id", "user_id AS inverter_id", "ts", "category", "k / 100D AS confidence",
        "category IN ('C', 'D', 'E') AS is_faulty",
        "CASE WHEN category IN ('C', 'D', 'E') THEN concat('Fault ', category) END AS fault_type",
        "cast(k * 8 + 20 AS double) AS dc_voltage", "cast(event_id % 12 AS double) AS dc_current", "value - 10 AS ac_power",
        "k * 0.7D + 10 AS module_temp", "cast(event_id % 40 AS double) AS ambient_temp",
        "cast((k * 11) % 1000 AS double) AS irradiation", f"{ALARM} AS alarm_code",
        "CASE WHEN event_type = 'signup' THEN 0 ELSE 5120 END AS op_state")


def plants(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "region").selectExpr(
        "r_regionkey AS plant_id", "r_name AS plant_name", "CASE WHEN r_regionkey = 4 THEN 'decommissioned' "
        "WHEN r_regionkey = 3 THEN 'maintenance' ELSE 'active' END AS status", "cast(r_regionkey * 100 AS bigint) AS created_by")


def blocks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "nation").selectExpr("n_nationkey AS block_id", "n_regionkey AS plant_id", "n_name AS block_name")


def inverters(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "supplier").selectExpr(
        "s_suppkey AS inverter_id", "s_nationkey AS block_id", "s_name AS inverter_name",
        "greatest(s_acctbal, 0D) / 100 AS capacity_kw",
        "array('A', 'B', 'C', 'D', 'E', 'offline')[cast(s_suppkey % 6 AS int)] AS current_category", "s_suppkey % 7 <> 0 AS is_online")


def admins(spark: SparkSession, folder: str) -> DataFrame:
    """People of one market segment play the administrators, the others the operators."""
    return table(spark, folder, "customer").where("c_mktsegment = 'MACHINERY'").selectExpr("c_custkey AS admin_id", "c_name AS name")


def operators(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").where("c_mktsegment <> 'MACHINERY'").selectExpr(
        "c_custkey AS operator_id", "c_name AS name", "c_acctbal > 0 AS is_active")


def plant_access(spark: SparkSession, folder: str) -> DataFrame:
    """Operators see the plant of their nation; those with a high balance also the next one."""
    home = table(spark, folder, "customer").where("c_mktsegment <> 'MACHINERY' AND c_acctbal > -500").join(
        table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return home.selectExpr(
        "c_custkey AS operator_id",
        "explode(array_compact(array(n_regionkey, CASE WHEN c_acctbal > 5000 THEN (n_regionkey + 1) % 5 END))) AS plant_id")


def alerts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").selectExpr(
        "l_orderkey * 10 + l_linenumber AS alert_id", "l_suppkey AS inverter_id",
        "CASE l_returnflag WHEN 'R' THEN 'critical' WHEN 'A' THEN 'warning' ELSE 'info' END AS type",
        "l_linestatus = 'F' AS acknowledged", "CASE WHEN l_linestatus = 'F' THEN l_partkey END AS acknowledged_by",
        "l_extendedprice AS weight", "l_shipdate AS created_at")


def audit_logs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").selectExpr(
        "o_orderkey AS log_id", "o_custkey AS user_id",
        "CASE o_orderstatus WHEN 'F' THEN 'admin' WHEN 'O' THEN 'operator' ELSE 'public' END AS user_role",
        "o_orderpriority AS action", "o_orderdate AS created_at", "to_json(struct(o_totalprice AS amount)) AS details")


def traces(spark: SparkSession, folder: str) -> DataFrame:
    """Model-call runs with ISO text times; every fifth run is a root, the next four are its steps."""
    iso = "yyyy-MM-dd\\'T\\'HH:mm:ss.SSSSSS\\'Z\\'"
    return keyed_events(spark, folder).selectExpr(
        "event_id AS run_id", "event_type AS name",
        "CASE WHEN k % 9 = 0 THEN 'error' WHEN k % 11 = 0 THEN 'pending' ELSE 'success' END AS status",
        f"CASE WHEN k % 13 <> 0 THEN date_format(ts, '{iso}') END AS start_time",
        f"CASE WHEN k % 17 = 0 THEN 'not a time' ELSE date_format(timestamp_micros(unix_micros(ts) + "
        f"cast(floor(value * 10000) AS bigint)), '{iso}') END AS end_time",
        "CASE WHEN k % 5 <> 0 THEN k * 3 + 10 END AS prompt_tokens", "k * 2 AS completion_tokens",
        "CASE WHEN k % 5 <> 0 THEN k * 5 + 10 END AS total_tokens",
        "CASE WHEN event_id % 5 <> 0 THEN event_id - event_id % 5 END AS parent_id", "event_id % 5 = 0 AS is_root")


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Prediction records: attribution and raw values as ordered {feature, value} entries."""
    def entries(pairs: dict[str, str]) -> str:
        items = ", ".join(f"named_struct('feature', '{n}', 'value', cast({v} AS double))" for n, v in pairs.items())
        return f"array({items})"

    weights = entries({
        "inverters[0].power": "(value - 50) / 100", "inverters[0].temp": "(k - 50) / 100D",
        "inverters[0].alarm_code": "(event_id % 7 - 3) / 10D", "meters[0].freq": "(event_id % 11 - 5) / 20D",
        "meters[0].pf": "(k % 5 - 2) / 50D", "smu[0].string3": "(event_id % 13 - 6) / 30D",
        "sensors[0].ambient_temp": "(k % 9 - 4) / 40D", "rolling_power_mean": "(event_id % 17 - 8) / 25D"})
    raw = entries({"inverters[0].power": "value * 10", "inverters[0].temp": "k * 0.5D + 20", "inverters[0].alarm_code": "k % 4",
                   "meters[0].pf": "k * 0.01D", "sensors[0].ambient_temp": "event_id % 40"})
    return keyed_events(spark, folder).selectExpr(
        "event_id AS prediction_id", "user_id AS inverter_id", "ts", "k / 100D AS risk_score",
        "CASE WHEN k / 100D >= 0.8D THEN 'shutdown_risk' WHEN k / 100D >= 0.4D THEN 'degradation_risk' ELSE 'no_risk' END "
        "AS risk_class", f"{weights} AS shap", f"{raw} AS raw")


def replies(spark: SparkSession, folder: str) -> DataFrame:
    """Model replies of three tasks built around conversation text: plain, JSON, fenced or broken."""
    parts = table(spark, folder, "conversations").withColumn(
        "plain", F.translate("text", '"\\\n\r\t', "     ")).selectExpr("*", "cast(conv_id + turn AS int) AS key")
    body = parts.selectExpr("*", """concat('{"summary": "', plain, '", "key_factors": [{"feature": "',
        array('power', 'inverters[9].temp')[key % 2], '"}], "recommended_actions": ["check inverters[', key % 4,
        '].temp now at ', key % 60 + 20, '.5 °C"]', CASE WHEN key % 4 <> 3 THEN concat(', "urgency": "',
        array('immediate', 'Within_24h ', 'scheduled', 'routine', 'later')[key % 5], '"') ELSE '' END,
        CASE WHEN key % 2 = 0 THEN ', "title": "Risk", "priority": "P2-High", "description": "see the summary text"'
        ELSE '' END, '}') AS body""")
    return body.selectExpr(
        "conv_id", "turn", "array('explanation', 'ticket', 'chat')[key % 3] AS task",
        "array('model-a', 'model-b', 'model-c')[cast(conv_id % 3 AS int)] AS model",
        "array('no_risk', 'degradation_risk', 'shutdown_risk')[key % 3] AS risk_class",
        """CASE key % 6 WHEN 0 THEN concat('Here it is:', chr(10), '```json', chr(10), body, chr(10), '```', chr(10), 'done')
        WHEN 1 THEN concat("I'm sorry, inverters[1].temp is 40 °C. ", text) WHEN 2 THEN concat(body, ' trailing')
        WHEN 3 THEN concat('Error: risk 0.5, you should inspect. ', text) ELSE body END AS response""",
        "length(text) / 100D AS latency_seconds", "length(text) % 50 AS input_tokens",
        "CASE WHEN turn % 4 <> 3 THEN length(text) END AS output_tokens", "CASE WHEN key % 10 = 9 THEN 'timeout' END AS error",
        "array(named_struct('feature', 'inverters[0].temp', 'value', 30D + key % 40), "
        "named_struct('feature', 'inverters[1].temp', 'value', 39.8D), named_struct('feature', 'meters[0].pf', 'value', 0.9D)) AS raw")
