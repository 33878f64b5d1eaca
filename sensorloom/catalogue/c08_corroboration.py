"""Alert-transition, investigation and corroboration queries over the event readings."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom.catalogue.c02_history import states
from sensorloom.catalogue.registry import query, relation
from sensorloom.functions import fault_rules as rules
from sensorloom.operators import corroboration as co
from sensorloom.sources import warehouse as wh

SECONDS = 1_728_000.0  # the event readings are hours apart, so the window is 20 days here
NAMES = {"view": "stack_temperature", "click": "coolant_flow", "signup": "fuel_flow", "purchase": "voltage", "error": "current"}
CLASS_LIST = list(rules.CLASSES)

relation(
    "telemetry",
    "SELECT id, asset_id, timestamp, CASE measurement_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in NAMES.items()) + " END AS measurement_type, value FROM obs",
    "obs",
)
relation(
    "transitions",
    """SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS asset_id, ts AS observed_at, k, CASE WHEN k < 50 THEN 'confirmed' WHEN k < 75 THEN 'class_changed' ELSE 'cleared' END AS transition_type,
         ['cooling_degradation', 'hydrogen_supply_issue', 'sensor_anomaly'][k % 3 + 1] AS fault_class FROM event_json WHERE event_type = 'error'""",
    "event_json",
)
relation(
    "investigated",
    """SELECT *, 'inv-' || substr(sha256(asset_id || '|' || first_value(event_id) OVER (PARTITION BY asset_id, no ORDER BY observed_at, event_id)), 1, 16) AS investigation_id FROM (
       SELECT *, sum(opens) OVER (PARTITION BY asset_id ORDER BY observed_at, event_id) AS no, CASE WHEN transition_type = 'cleared' THEN 'CLEARED' ELSE 'OPEN' END AS investigation_status,
         CASE WHEN opens = 0 AND (transition_type = 'cleared' OR prev_class <> fault_class) THEN prev_class END AS previous_fault_class, opens = 1 AS is_new_investigation FROM (
       SELECT *, CASE WHEN prev IS NULL OR prev = 'cleared' THEN 1 ELSE 0 END AS opens FROM (SELECT *, lag(transition_type) OVER w AS prev, lag(fault_class) OVER w AS prev_class FROM transitions
         WINDOW w AS (PARTITION BY asset_id ORDER BY observed_at, event_id))))""",
    "transitions",
)


def transitions(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    return wh.table(spark, sf, "events").filter(F.col("event_type") == "error").select(
        F.col("event_id").cast("string").alias("event_id"),
        F.col("user_id").cast("string").alias("asset_id"),
        F.col("ts").cast("timestamp").alias("observed_at"),
        F.when(k < 50, "confirmed").when(k < 75, "class_changed").otherwise("cleared").alias("transition_type"),
        F.element_at(F.array(*[F.lit(c) for c in CLASS_LIST]), k % 3 + 1).alias("fault_class"),
    )


def telemetry(spark, sf):
    name = F.coalesce(*[F.when(F.col("measurement_type") == k, v) for k, v in NAMES.items()])
    return wh.observations(spark, sf).withColumn("measurement_type", name)


@query(
    "X22_extract_fault_class",
    """SELECT o_orderkey, CASE WHEN t IS NULL THEN 'unsupported_transition' WHEN f IS NULL THEN 'malformed_state' WHEN f = 'healthy' THEN 'healthy_class_rejected' WHEN f NOT IN ('cooling_degradation', 'hydrogen_supply_issue', 'sensor_anomaly') THEN 'unsupported_fault_class' END AS reject_reason, f AS fault_class FROM (
       SELECT o_orderkey, t, nullif(regexp_extract(CASE WHEN t = 'cleared' THEN a ELSE b END, '^confirmed_(.+)$', 1), '') AS f FROM (
       SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'confirmed' WHEN 'O' THEN 'cleared' END AS t, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'confirmed_sensor_anomaly' WHEN '2' THEN 'confirmed_healthy' WHEN '3' THEN 'confirmed_' WHEN '4' THEN 'confirmed_other' ELSE 'healthy' END AS a,
         CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'confirmed_cooling_degradation' WHEN '2' THEN 'healthy' ELSE 'confirmed_hydrogen_supply_issue' END AS b FROM orders))""",
)
def x22(spark, sf):
    digit = F.substring("o_orderpriority", 1, 1)
    raw = wh.table(spark, sf, "orders").select(
        "o_orderkey",
        F.col("o_orderkey").cast("string").alias("event_id"),
        F.lit("a").alias("asset_id"),
        F.col("o_orderdate").cast("timestamp").alias("observed_at"),
        F.when(F.col("o_orderstatus") == "F", "confirmed").when(F.col("o_orderstatus") == "O", "cleared").alias("transition_type"),
        F.when(digit == "1", "confirmed_sensor_anomaly").when(digit == "2", "confirmed_healthy").when(digit == "3", "confirmed_")
        .when(digit == "4", "confirmed_other").otherwise("healthy").alias("from_state"),
        F.when(digit == "1", "confirmed_cooling_degradation").when(digit == "2", "healthy").otherwise("confirmed_hydrogen_supply_issue").alias("to_state"),
        F.lit(0.9).alias("maximum_score"),
    )
    return co.validate_transitions(raw).select("o_orderkey", "reject_reason", "fault_class")


@query(
    "W30_investigation_ids",
    "SELECT event_id, asset_id, investigation_id, investigation_status, previous_fault_class, is_new_investigation FROM investigated",
    ("investigated",),
)
def w30(spark, sf):
    return co.investigations(transitions(spark, sf)).select(
        "event_id", "asset_id", "investigation_id", "investigation_status", "previous_fault_class", "is_new_investigation"
    )


CHANGES = """SELECT o_custkey AS recommendation_id, o_orderdate, o_orderkey, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'ACKNOWLEDGED' WHEN '2' THEN 'ACKNOWLEDGED' WHEN '3' THEN 'INVESTIGATING' WHEN '4' THEN 'INVESTIGATING' ELSE 'RESOLVED' END AS status FROM orders"""
relation(
    "status_changes",
    f"""SELECT *, rk > coalesce(max(rk) OVER (PARTITION BY recommendation_id ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS accepted FROM (
        SELECT *, CASE status WHEN 'ACKNOWLEDGED' THEN 0 WHEN 'INVESTIGATING' THEN 1 ELSE 2 END AS rk FROM ({CHANGES}))""",
)


def status_changes(spark, sf):
    digit = F.substring("o_orderpriority", 1, 1)
    rows = wh.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("recommendation_id"), F.col("o_orderdate").cast("timestamp").alias("o_orderdate"), "o_orderkey",
        F.when(digit.isin("1", "2"), "ACKNOWLEDGED").when(digit.isin("3", "4"), "INVESTIGATING").otherwise("RESOLVED").alias("status"),
    )
    return co.grade_status_changes(rows, "recommendation_id", ["o_orderdate", "o_orderkey"])


@query("W31_investigation_transitions", "SELECT recommendation_id, o_orderkey, status, accepted FROM status_changes", ("status_changes",))
def w31(spark, sf):
    return status_changes(spark, sf).select("recommendation_id", "o_orderkey", "status", "accepted")


@query(
    "W31_investigation_status",
    "SELECT recommendation_id, max_by(status, rk) AS status, count(*) AS transitions FROM status_changes WHERE accepted GROUP BY 1",
    ("status_changes",),
)
def w31s(spark, sf):
    return co.current_status(status_changes(spark, sf), "recommendation_id", ["o_orderdate", "o_orderkey"])


relation(
    "context_rows",
    """SELECT event_id, asset_id, fault_class, measurement_type, id, timestamp, value, row_no FROM (
       SELECT t.event_id, t.asset_id, t.fault_class, o.measurement_type, o.id, o.timestamp, o.value, row_number() OVER (PARTITION BY t.event_id, o.measurement_type ORDER BY o.timestamp, o.id) AS row_no
       FROM transitions t JOIN telemetry o ON o.asset_id = t.asset_id AND o.timestamp <= t.observed_at AND o.timestamp >= t.observed_at - INTERVAL 1728000 SECOND
         AND list_contains(CASE t.fault_class WHEN 'cooling_degradation' THEN ['stack_temperature', 'coolant_flow'] WHEN 'hydrogen_supply_issue' THEN ['fuel_flow', 'voltage'] ELSE ['stack_temperature', 'current', 'voltage', 'fuel_flow'] END, o.measurement_type)
       WHERE t.transition_type <> 'cleared') WHERE row_no <= 20""",
    "transitions",
    "telemetry",
)


@query(
    "J09_alert_context",
    "SELECT event_id, measurement_type, id AS row_id, value AS row_value, row_no::INTEGER AS row_no FROM context_rows",
    ("context_rows",),
)
def j09(spark, sf):
    rows = co.alert_context(transitions(spark, sf), telemetry(spark, sf), SECONDS)
    return rows.select("event_id", "measurement_type", "row_id", "row_value", "row_no")


def outcome_sql() -> str:
    names = ", ".join(f"'{k}': ['{v[0]}', '{'|'.join(v[1])}']" for k, v in rules.OUTCOMES.items())
    return f"MAP {{{names}}}"


relation(
    "corroborated",
    f"""SELECT *, {outcome_sql()}[outcome][1] AS result, {outcome_sql()}[outcome][2] AS rule_names FROM (
       SELECT i.*, coalesce(ids, '') AS ids, CASE WHEN transition_type = 'cleared' THEN 'cleared'
         WHEN fault_class = 'cooling_degradation' THEN CASE WHEN tt IS NULL THEN 'cooling_short' WHEN tt <> 'increasing' THEN 'cooling_flat' WHEN tc IS NULL THEN 'cooling_no_coolant' WHEN tc = 'increasing' THEN 'cooling_compensated' WHEN tc = 'stable' THEN 'cooling_stable' ELSE 'cooling_confirmed' END
         WHEN fault_class = 'hydrogen_supply_issue' THEN CASE WHEN tf IS NULL THEN 'hydrogen_short' WHEN tf <> 'decreasing' THEN 'hydrogen_flat' WHEN tv IS NULL THEN 'hydrogen_no_voltage' WHEN tv <> 'decreasing' THEN 'hydrogen_voltage_holds' ELSE 'hydrogen_confirmed' END
         ELSE CASE WHEN tt IS NULL THEN 'sensor_short' WHEN tt = 'stable' THEN 'sensor_flat' WHEN known = 0 THEN 'sensor_alone' WHEN moved = 0 THEN 'sensor_confirmed' WHEN moved = known THEN 'sensor_real' ELSE 'sensor_mixed' END END AS outcome, tt, tf
       FROM investigated i LEFT JOIN (SELECT event_id, max(trend) FILTER (measurement_type = 'stack_temperature') AS tt, max(trend) FILTER (measurement_type = 'coolant_flow') AS tc, max(trend) FILTER (measurement_type = 'fuel_flow') AS tf,
           max(trend) FILTER (measurement_type = 'voltage') AS tv, count(trend) FILTER (measurement_type <> 'stack_temperature') AS known, count(trend) FILTER (measurement_type <> 'stack_temperature' AND trend <> 'stable') AS moved,
           string_agg(ids, '|' ORDER BY CASE measurement_type WHEN 'stack_temperature' THEN 0 WHEN 'coolant_flow' THEN 1 WHEN 'current' THEN 2 WHEN 'fuel_flow' THEN CASE fault_class WHEN 'hydrogen_supply_issue' THEN 2 ELSE 4 END ELSE 3 END) AS ids
         FROM (SELECT event_id, any_value(fault_class) AS fault_class, measurement_type, string_agg(id, '|' ORDER BY pos) AS ids, CASE WHEN max(n) < 4 THEN NULL WHEN max(n) < 8 THEN 'stable' WHEN abs(shift) <= 1e-9 THEN 'stable' WHEN abs(shift) / spread < 0.8 THEN 'stable' WHEN shift > 0 THEN 'increasing' ELSE 'decreasing' END AS trend
           FROM (SELECT *, avg(value) FILTER (pos > n - n // 2) OVER p - avg(value) FILTER (pos <= n // 2) OVER p AS shift, stddev_pop(value) OVER p AS spread FROM (SELECT *, row_no AS pos, count(*) OVER (PARTITION BY event_id, measurement_type) AS n FROM context_rows) WINDOW p AS (PARTITION BY event_id, measurement_type))
           GROUP BY event_id, measurement_type, shift, spread) GROUP BY event_id) USING (event_id))""",
    "investigated",
    "context_rows",
)


def corroborated(spark, sf):
    return co.corroborate(transitions(spark, sf), telemetry(spark, sf), SECONDS)


@query(
    "D15_corroborate",
    """SELECT event_id, fault_class, result AS corroboration_result, CASE WHEN rule_names = '' THEN '' ELSE array_to_string(list_transform(string_split(rule_names, '|'), lambda r: fault_class || '.' || r), '|') END AS rule_ids, ids AS supporting FROM corroborated""",
    ("corroborated",),
)
def d15(spark, sf):
    return corroborated(spark, sf).select(
        "event_id", "fault_class", "corroboration_result", F.array_join("corroboration_rule_ids", "|").alias("rule_ids"),
        F.array_join("supporting_observation_ids", "|").alias("supporting"),
    )


@query(
    "D16_fault_class_mapping",
    """SELECT event_id, CASE fault_class WHEN 'cooling_degradation' THEN 'cooling_system_degradation' WHEN 'hydrogen_supply_issue' THEN 'hydrogen_supply_degradation' ELSE 'sensor_reading_anomaly' END AS situation_type,
       CASE fault_class WHEN 'cooling_degradation' THEN 4 WHEN 'hydrogen_supply_issue' THEN 4 ELSE 2 END AS steps FROM transitions""",
    ("transitions",),
)
def d16(spark, sf):
    table = co.fault_class_table(spark)
    joined = transitions(spark, sf).join(F.broadcast(table), "fault_class")  # three fixed rows
    return joined.select("event_id", "situation_type", F.size("recommended_steps").alias("steps"))


RECOMMENDED = """CASE result WHEN 'corroborated' THEN 'produced' WHEN 'partially_corroborated' THEN 'produced' WHEN 'not_applicable' THEN NULL ELSE 'withheld' END AS recommendation_status,
  CASE result WHEN 'corroborated' THEN 'ELEVATED' WHEN 'partially_corroborated' THEN 'INSPECTION_REQUIRED' WHEN 'not_applicable' THEN NULL ELSE 'INFORMATIONAL' END AS urgency,
  CASE result WHEN 'corroborated' THEN 'Deterministic evidence corroborates the AI-diagnosed ' || fault_class || '.'
    WHEN 'partially_corroborated' THEN 'Deterministic evidence partially supports the AI-diagnosed ' || fault_class || '; verification is recommended before any operational action.'
    WHEN 'not_corroborated' THEN 'Deterministic evidence does not corroborate the AI-diagnosed ' || fault_class || '; no fault-action recommendation is made.'
    WHEN 'insufficient_evidence' THEN 'Insufficient observable telemetry to corroborate or refute the AI-diagnosed ' || fault_class || '; more data is needed.' END AS action_summary"""


@query("D17_fault_recommendation", f"SELECT event_id, {RECOMMENDED} FROM corroborated", ("corroborated",))
def d17(spark, sf):
    return co.fault_recommendation(corroborated(spark, sf)).select("event_id", "recommendation_status", "urgency", "action_summary")


def evidence(spark, sf):
    return co.fault_evidence(transitions(spark, sf), telemetry(spark, sf), None, SECONDS)


@query(
    "D18_ai_fault_evidence",
    f"""SELECT event_id, asset_id, observed_at, transition_type, fault_class, investigation_id, investigation_status, previous_fault_class, result AS corroboration_result, recommendation_status, urgency,
       CASE WHEN recommendation_status IS NOT NULL THEN 'ai-fault-rec-' || investigation_id || '-' || event_id END AS recommendation_id FROM (SELECT *, {RECOMMENDED} FROM corroborated)""",
    ("corroborated",),
)
def d18(spark, sf):
    return evidence(spark, sf).select(
        "event_id", "asset_id", "observed_at", "transition_type", "fault_class", "investigation_id", "investigation_status",
        "previous_fault_class", "corroboration_result", "recommendation_status", "urgency", "recommendation_id",
    )


@query(
    "D19_reasoning_result_event",
    f"""SELECT event_id AS source_alert_event_id, asset_id, fault_class AS diagnosed_class, result AS corroboration_result, investigation_id, recommendation_status, action_summary, urgency FROM (SELECT *, {RECOMMENDED} FROM corroborated)""",
    ("corroborated",),
)
def d19(spark, sf):
    return co.result_events(evidence(spark, sf)).drop("result_event_id", "event_version", "reasoning_rule_version")


@query(
    "P17_active_investigation",
    """SELECT asset_id, event_id, investigation_id, fault_class FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY observed_at DESC, event_id DESC) AS age FROM investigated) WHERE age = 1 AND investigation_status <> 'CLEARED'""",
    ("investigated",),
)
def p17(spark, sf):
    return co.active_investigations(co.investigations(transitions(spark, sf))).select("asset_id", "event_id", "investigation_id", "fault_class")


@query(
    "P18_filter_hypotheses",
    """SELECT asset_id, CASE WHEN has_unexpected THEN '' WHEN variation = 'high' OR has_contradictions THEN 'sensor_drift' ELSE 'load_change' END AS kept FROM reasoned""",
    ("reasoned",),
)
def p18(spark, sf):
    kept = F.filter("hypotheses", lambda h: h["kind"] != "hydrogen_supply")
    return states(spark, sf).select("asset_id", F.array_join(F.transform(kept, lambda h: h["kind"]), "|").alias("kept"))
