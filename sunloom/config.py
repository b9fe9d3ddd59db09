"""Settings and fixed values shared by every job.

The *fixed values* are data: codes, names, thresholds and phrases a result must agree with.
"""

from __future__ import annotations

# --------------------------------------------------------------------------- sampling of telemetry
SAMPLE_MINUTES = 5
ROWS_PER_HOUR = 60 // SAMPLE_MINUTES
ROWS_PER_DAY = 24 * ROWS_PER_HOUR
LOOKAHEAD_ROWS = 7 * ROWS_PER_DAY
FRAMES = {"1h": ROWS_PER_HOUR, "6h": 6 * ROWS_PER_HOUR, "24h": ROWS_PER_DAY}
LAGS = {"1d": ROWS_PER_DAY, "7d": 7 * ROWS_PER_DAY}

# One task holds at most this many rows of one series, half a year of 5-minute samples: the windows of all rolling
# statistics hold about 2.7 KB a row. Longer series are cut into slices of this size.
SERIES_ROWS_PER_TASK = 50_000
# Width of the time bins used to number the rows of a series that is too long for one task.
POSITION_BIN_SECONDS = 60

# --------------------------------------------------------------------------- fixed values: columns
SERIES_KEYS = ["plant_id", "mac", "inverter_id"]
ROLLING_SIGNALS = ["power", "temp", "pv1_current", "pf", "v_r"]
LAG_SIGNALS = ["power", "temp", "string_imbalance", "power_variability"]
ZSCORE_SIGNALS = ["power", "temp"]
FOREST_SIGNALS = ["power", "temp", "string_imbalance", "pf", "v_r", "power_variability", "alarm_active"]
STRING_CURRENTS = [f"pv{i}_current" for i in range(1, 10)]
STRING_POWERS = ["pv1_power", "pv2_power"]
SLOW_COLUMNS = [
    "kwh_total", "kwh_today", "kwh_midnight", "model", "serial", "limit_percent",
    "meter_kwh_import", "meter_kwh_total", "base_meter_kwh_import", "base_meter_kwh_total",
    "original_meter_kwh_import", "original_meter_kwh_total",
]
DROPPED_COLUMNS = ["_id", "createdAt", "fromServer", "dataLoggerModelId", "__v", "timestampDate",
                   "batteries", "grid_master"]
NOT_CLIPPED = ["inverter_id", "id", "__v", "dataLoggerModelId"]
NOT_FEATURES = ["timestamp", "inverter_id", "plant_id", "mac", "risk_label", "model", "serial", "id",
                "meter_model", "meter_serial", "meter_id"] + DROPPED_COLUMNS
SHARED_PREFIXES = ["meters[0].", "sensors[0].", "smu[0].", "smu[1].", "smu[2].", "smu[3].", "smu[4]."]

# --------------------------------------------------------------------------- fixed values: labels
RUNNING_STATE = 5120
OFF_STATE = 0
FAULT_ALARMS = [464, 534, 548, 549, 557, 558, 559, 563, 581]
WARNING_ALARMS = [8, 10, 39]
POWER_DROP = 0.30
MEANINGFUL_POWER = 100.0
SANE_RANGE = ("2024-01-01", "2026-01-01")
IQR_FACTOR = 3.0
ZSCORE_LIMIT = 3.0
CLASS_NAMES = ["no_risk", "degradation_risk", "shutdown_risk"]
CATEGORIES = ["A", "B", "C", "D", "E", "offline"]

# --------------------------------------------------------------------------- fixed values: learning
TEST_SHARE = 0.20
FOLDS = 4
NEIGHBOURS = 5
FOREST_TREES = 200
FOREST_SAMPLE = 256
FOREST_CONTAMINATION = 0.05
SEARCH_TRIALS = 40
SEED = 42

# --------------------------------------------------------------------------- fixed values: scoring
READING_TO_FEATURE = {
    "dc_voltage": "pv1_voltage", "dc_current": "pv1_current", "ac_power": "power",
    "module_temp": "temp", "ambient_temp": "ambient_temp", "irradiation": "meter_active_power",
}
READING_RANGES = {
    "dc_voltage": (0, 2000), "dc_current": (0, 100), "ac_power": (0, 500), "module_temp": (-40, 150),
    "ambient_temp": (-40, 80), "irradiation": (0, 1500), "power_factor": (0, 1), "frequency": (0, 100),
}

# --------------------------------------------------------------------------- fixed values: reports
EFFICIENCY = 0.96
TARIFF_USD = 0.06
EMISSION_KG = 0.71
CREDIT_USD = 40.0
NOMINAL_TEMP = 45.0
CRITICAL_TEMP = 65.0
GRID_EMISSION_TONNES = 0.000716
MARKET_CREDIT_USD = 22.0
TARIFF_INR = 4.0
TREES_PER_TONNE = 45.8
TONNES_PER_CAR = 4.6
KWH_PER_HOME = 877.0
KPI_STEP_HOURS = 5 / 3600
FAULT_HOURS_CAP = 168
THRESHOLDS_JSON = '{"A":[90,100],"B":[75,89],"C":[50,74],"D":[25,49],"E":[0,24]}'
STALE_MINUTES = 10

# --------------------------------------------------------------------------- fixed values: text
CHUNK_WORDS = 800
CHUNK_OVERLAP = 200
CHUNK_MIN_CHARS = 50
RETRIEVE_K = 5
KEEP_TURNS = 20
FEATURE_PREFIXES = ["inverters[0].", "inverters[1].", "meters[0].", "sensors[0].", "smu[0].", "smu[1]."]
URGENCIES = ["immediate", "within_24h", "scheduled", "routine"]
EXPECTED_URGENCY = {
    "no_risk": ["routine", "scheduled"],
    "degradation_risk": ["within_24h", "scheduled"],
    "shutdown_risk": ["immediate", "within_24h"],
}
REQUIRED_FIELDS = {
    "explanation": ["summary", "key_factors", "recommended_actions", "urgency"],
    "ticket": ["title", "priority", "description", "root_cause_analysis", "recommended_actions"],
}
REFUSALS = ["i cannot", "i'm sorry", "as an ai", "i don't have access", "i am unable"]
ERROR_WORDS = ["error", "exception", "traceback", "undefined"]
SCORE_WEIGHTS = {"json_validity": 0.25, "hallucination": 0.25, "urgency_accuracy": 0.10,
                 "completeness": 0.25, "response_quality": 0.15}
# Retrieval phrases by substring of a feature name; the first match decides.
EXPLAIN_PHRASES = [
    ("temp", "temperature overheating thermal protection"),
    ("alarm", "alarm code fault error troubleshooting"),
    ("current", "string current mismatch degradation"),
    ("voltage", "string voltage panel issue"),
    ("power", "power output reduction derating"),
    ("freq", "grid frequency deviation anti-islanding"),
    ("pf", "power factor grid connection reactive"),
    ("string", "string monitoring current imbalance"),
]
TICKET_PHRASES = [
    ("temp", "overheating thermal shutdown cooling"),
    ("alarm", "alarm fault error code reset"),
    ("current", "string current low degradation"),
    ("voltage", "voltage drop panel string"),
    ("power", "power reduction derating output"),
    ("freq", "grid frequency deviation protection"),
    ("pf", "power factor reactive grid"),
]
