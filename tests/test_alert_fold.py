"""The fold gets a series as Arrow columns."""

from pyspark.sql import functions as F

from sensorloom.functions.hysteresis import Policy
from sensorloom.operators import alerts

SCHEMA = "run_id long, tick long, elapsed double, p_A double, p_N double, p_R double, valid boolean, part boolean"


def test_the_fold_makes_no_frame_of_each_series(spark):
    df = spark.createDataFrame([(1, 1, 10.0, 0.9, 0.05, 0.05, True, True)], SCHEMA)
    plan = alerts.alert_fold(df, ["run_id"], ["A", "N", "R"], "N", [Policy(0.4, 2, 0.4, 2)])._jdf.queryExecution().toString()
    assert "FlatMapGroupsInArrow" in plan


def test_nulls_of_a_series_are_read_as_before(spark):
    calm, fault, none = (0.1, 0.8, 0.1), (0.8, 0.1, 0.1), (None, None, None)
    rows = []
    for run in (1, None):
        for tick, scores in enumerate([calm, fault, fault, none, calm, calm], 1):
            rows.append((run, tick, 10.0 * tick, *scores, None if tick == 4 else True, None if tick == 6 else True))
    df = spark.createDataFrame(rows[::-1], SCHEMA)
    folded = alerts.alert_fold(
        df, ["run_id"], ["A", "N", "R"], "N", [Policy(0.4, 2, 0.4, 2)], valid=F.col("valid"), healthy_part=F.col("part")
    ).collect()
    for run in (1, None):
        mine = sorted((r for r in folded if r["run_id"] == run), key=lambda r: (r["kind"] == "segment", r["pos"]))
        assert [(r["kind"], r["pos"], r["from_state"], r["to_state"], r["fault_class"]) for r in mine] == [
            ("new_alert", 3, "N", "confirmed_A", "A"), ("cleared", 6, "confirmed_A", "N", "A"), ("segment", 1, None, None, None),
        ]
        assert (mine[-1]["rows"], mine[-1]["valid_rows"], mine[-1]["elapsed"]) == (5, 4, 50.0)

