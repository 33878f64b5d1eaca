"""Events are parsed once, and broken ones give the fields that they gave when each field was looked up on its own."""

from pyspark.sql import functions as F

from sensorloom.sources import text

GOOD = '{"event_id":"e","event_version":"v1","asset_id":"a","timestamp":"2026-01-01T00:00:00Z","measurement_name":"current","value":1.50,"unit":"A","source":"s"}'
EVENTS = [
    GOOD, GOOD.replace('"v1"', '"v9"'), GOOD.replace("1.50", '"1.5"'), GOOD.replace("1.50", "1e400"), GOOD.replace("1.50", "true"), GOOD.replace("1.50", "null"),
    GOOD.replace("1.50", "12345678901234567890123"), GOOD.replace("1.50", '{"x": 1}'), GOOD.replace('"a"', "5"), GOOD.replace('"a"', '""'), GOOD.replace('"a"', '"\\u00e4 \\"b\\""'),
    GOOD.replace("2026-01-01T", "2026-1-1T"), GOOD.replace('"2026-01-01T00:00:00Z"', "20260101"), GOOD.replace("current", "other"), GOOD.replace('"A"', '"K"'),
    GOOD.replace('"source"', '"unit"'), GOOD.replace('"e"', "null"), GOOD[:-1], GOOD[:60], GOOD + " x", f"[{GOOD}]", "[]", "{}", "null", "5", "", "x", None,
]


def test_fields_are_those_looked_up_one_by_one(spark):
    raw = spark.createDataFrame(list(enumerate(EVENTS)), "n int, value string")
    found = {r["n"]: r for r in text.decode_events(raw).collect()}
    looked_up = raw.select("n", *[F.get_json_object("value", f"$.{f}").alias(f) for f in text.EVENT_FIELDS]).collect()
    assert len(found) == len(EVENTS)
    for r in looked_up:
        mine = found[r["n"]]
        assert [mine[c] for c in ("event_id", "asset_id", "measurement_type", "unit", "source")] == [r[c] for c in ("event_id", "asset_id", "measurement_name", "unit", "source")]
        assert (mine["value"] is None) == (mine["timestamp"] is None) == (mine["reject_reason"] is not None)
    assert [n for n, r in found.items() if r["reject_reason"] is None] == [0, 6, 10, 19]
    assert found[0]["value"] == 1.5 and found[1]["reject_reason"] == "unsupported_version" and found[17]["reject_reason"] == "invalid_json"


def test_a_filter_on_the_reason_does_not_repeat_the_parsing(spark):
    decoded = text.decode_events(spark.createDataFrame([(1, GOOD)], "n int, value string"))
    for rows in (decoded.filter(F.col("reject_reason").isNull()), decoded.filter("reject_reason is not null").select("asset_id", "reject_reason")):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("get_json_object(") <= len(text.EVENT_FIELDS) and plan.count("regexp_extract(") <= 6
        assert plan.count("parse_json(") <= 2
