"""Every registered query against its SQL, on whole tables."""

import oracle
import pytest

import __spark_entry__ as entry
from sunloom import config
from sunloom.plans import ORACLES as SQL
from sunloom.plans import PLANS
from sunloom.sources import bindings


@pytest.fixture(scope="module")
def con(small):
    return oracle.connect(small)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, small, con, name):
    got = PLANS[name](spark, small).toPandas()
    assert oracle.differences(got, con.execute(SQL[name]).df()) == []


@pytest.mark.parametrize("name", sorted(set(PLANS) - set(SQL)))
def test_runs(spark, small, name):
    assert PLANS[name](spark, small).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


LONG = ["ffill", "counter_delta", "alarm_streak", "category_transitions", "downsample", "stream_alerts"]
#: Frames of a day and a week: slices can't be shorter than the rows they reach, so the series must be longer.
FRAMED = ["roll_mean", "roll_std", "roll_minmax", "power_variability", "lag_features", "event_indicators", "lookahead_label", "zscore_flags",
          "risk_profile"]


@pytest.mark.parametrize("name", LONG)
def test_long_series_match_sql(spark, small, con, name, monkeypatch):
    """The same queries when many devices are too long for a task and are cut into slices."""
    monkeypatch.setattr(config, "SERIES_ROWS_PER_TASK", 62)
    test_matches_sql(spark, small, con, name)


@pytest.mark.parametrize("name", FRAMED)
def test_long_series_with_wide_frames_match_sql(spark, name, monkeypatch):
    """Devices of about 2,500 rows in slices of 2,304, the rows that features, their lags and the look-ahead reach."""
    monkeypatch.setattr(config, "SERIES_ROWS_PER_TASK", config.FRAMES["24h"] + config.LAGS["7d"])
    folder = "/root/testdata/sf0.01"
    assert bindings.few_devices(spark, folder).groupBy("inverter_id").count().where(f"count > {config.SERIES_ROWS_PER_TASK}").count() == bindings.FEW
    test_matches_sql(spark, folder, oracle.connect(folder), name)
