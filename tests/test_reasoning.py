import datetime as dt

import pytest

from sensorloom.operators import reads, trends
from sensorloom.plans.reasoning import FUEL_CELL, Profile, reason
from sensorloom.sources.text import read_observations_csv

START = dt.datetime(2026, 1, 1, 12, tzinfo=dt.timezone.utc)
SCHEMA = "id string, asset_id string, timestamp timestamp, measurement_type string, value double, unit string"


def series(name, values, asset="asset-1"):
    return [(f"{name}-{i:03d}", asset, START + dt.timedelta(minutes=i), name, float(v), "unit") for i, v in enumerate(values)]


@pytest.mark.parametrize(
    "values,expected",
    [
        ([1, 2, 3, 4, 5, 6, 7], "stable"),  # below eight readings
        ([1, 2, 3, 4, 5, 6, 7, 8], "increasing"),
        ([8, 7, 6, 5, 4, 3, 2, 1], "decreasing"),
        ([5] * 9, "stable"),
        ([1, 9, 1, 9, 1, 9, 1, 9], "stable"),
    ],
)
def test_trend(spark, values, expected):
    rows = spark.createDataFrame(series("t", values), SCHEMA).repartition(3)
    assert trends.trend_signals(rows).first()["trend"] == expected


def test_reason_ignores_row_order_and_explains(spark):
    rows = series("stack_temperature", range(32, 42)) + series("fuel_flow", range(20, 10, -1))
    out = reason(spark.createDataFrame(rows, SCHEMA).repartition(7), FUEL_CELL).collect()
    again = reason(spark.createDataFrame(rows[::-1], SCHEMA).coalesce(1), FUEL_CELL).collect()
    assert out == again and len(out) == 1
    row = out[0]
    assert row["primary_type"] == "fuel_flow" and row["trend"] == "decreasing"
    assert row["hypotheses"][0]["kind"] == "hydrogen_supply" and row["priority"] == "low"


def test_contradiction_lowers_confidence(spark):
    profile = Profile((("a", "b"),), (("a", "b"),))
    rows = series("a", range(10)) + series("b", range(10))
    row = reason(spark.createDataFrame(rows, SCHEMA), profile).first()
    assert row["has_contradictions"] and row["penalties"] == -12 and row["assessment"].endswith("inconsistencies detected.")


def test_single_reading_is_not_assessed(spark):
    assert reason(spark.createDataFrame(series("a", [1]), SCHEMA)).count() == 0


def test_csv_source(spark, tmp_path):
    path = tmp_path / "readings.csv"
    path.write_text("id,asset_id,measurement_type,value,unit,timestamp\n1,a,t,32.5,C,2026-01-01T12:00:00Z\n")
    assert read_observations_csv(spark, str(path)).first()["value"] == 32.5
    path.write_text("id,asset_id,measurement_type,value,unit,timestamp\n1,a,t,oops,C,2026-01-01T12:00:00Z\n")
    with pytest.raises(Exception):
        read_observations_csv(spark, str(path)).collect()


def test_forecast_is_drift(spark):
    points = [(START + dt.timedelta(hours=i), "a", "t", float(i * i), "u") for i in range(5)]
    df = spark.createDataFrame(points, "bucket timestamp, asset_id string, measurement_type string, avg_value double, unit string")
    got = [r["value"] for r in reads.forecast(df, horizon=2).orderBy("step").collect()]
    assert got == pytest.approx([23.0, 30.0])
    with pytest.raises(ValueError):
        reads.forecast(df, horizon=13)
