"""State, run history, timeline and read-view queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom.catalogue import reasoning_sql as rs
from sensorloom.catalogue.registry import query, relation
from sensorloom.lineage import cut_lineage
from sensorloom.plans import history, reasoning, state
from sensorloom.plans.reasoning import EVENTS_PROFILE
from sensorloom.sources import warehouse as wh

STATES = """
SELECT *, CASE WHEN has_contradictions THEN 'Contradictory signals detected in structured assessment.'
    WHEN has_unexpected THEN 'Unexpected expectation signals detected in assessment.'
    WHEN sustained THEN 'Trend: ' || t_summary ELSE 'Decision priority: ' || priority END AS primary_driver,
  CASE WHEN priority = 'high' OR health_status = 'CRITICAL' THEN 'HIGH' WHEN priority = 'medium' OR health_status = 'WARNING' THEN 'MEDIUM'
    ELSE 'LOW' END AS risk_level,
  35 + x_support + x_severity + x_consistency + x_trend + x_sustained + x_penalty AS x_raw
FROM (SELECT *, CASE WHEN health_score >= 75 THEN 'NORMAL' WHEN health_score >= 45 THEN 'WARNING' ELSE 'CRITICAL' END AS health_status
  FROM (SELECT *, greatest(0, least(100, 100 - CASE priority WHEN 'high' THEN 45 WHEN 'medium' THEN 25 WHEN 'low' THEN 10 ELSE 20 END
      - (CASE WHEN sustained THEN 15 ELSE 0 END + CASE WHEN volatility_score >= 60 THEN 10 ELSE 0 END
         - CASE WHEN direction = 'stable' AND stability_score >= 75 THEN 5 ELSE 0 END)
      - CASE WHEN has_contradictions THEN 15 ELSE 0 END - CASE WHEN has_unexpected THEN 10 ELSE 0 END)) AS health_score
    FROM (SELECT r.*, d.direction, d.stability_score, d.volatility_score, d.monotonicity, d.t_summary,
        direction IN ('rising', 'falling') AND stability_score >= 65 AS sustained,
        least(25, 8 * least(n_primary, 3)) AS x_support,
        CASE priority WHEN 'high' THEN 25 WHEN 'medium' THEN 15 WHEN 'low' THEN 5 ELSE 10 END AS x_severity,
        CASE WHEN stability_score >= 65 AND variation = 'low' THEN 15 ELSE 5 END AS x_consistency,
        CASE WHEN stability_score >= 75 THEN 12 WHEN stability_score >= 60 THEN 8 WHEN stability_score >= 45 THEN 4 ELSE 0 END AS x_trend,
        CASE WHEN direction <> 'stable' AND coalesce(d.monotonicity, 0) >= 0.85 AND stability_score >= 70 THEN 6 ELSE 0 END AS x_sustained,
        CASE WHEN has_contradictions THEN -12 ELSE 0 END AS x_penalty
      FROM {r} r JOIN (SELECT *, {s} AS t_summary FROM {d}) d ON {on} AND r.primary_type = d.measurement_type)))"""
SENT = rs.SENTENCE.format(l="measurement_type")
relation(
    "states",
    STATES.format(r="reasoned", d="diagnosed", s=SENT, on="r.asset_id = d.asset_id"),
    "reasoned",
    "diagnosed",
)
relation(
    "states_batch",
    STATES.format(r="reasoned_batch", d="diagnosed_batch", s=SENT, on="r.asset_id = d.asset_id AND r.batch = d.batch"),
    "reasoned_batch",
    "diagnosed_batch",
)
RECOMMENDED = """
SELECT *, 'rec-' || asset_id || '-' || substr(sha256(asset_id || '|' || category || '|' || tier || '|' || urgency || '|' || title), 1, 16) AS recommendation_id,
  CASE tier WHEN 'P0' THEN 'CRITICAL' WHEN 'P3' THEN NULL ELSE 'WARNING' END AS severity,
  CASE WHEN tier <> 'P3' THEN 'notif-rec-' || asset_id || '-' || substr(sha256(asset_id || '|' || category || '|' || tier || '|' || urgency || '|' || title), 1, 16) END AS notification_id,
  CASE tier WHEN 'P0' THEN 'Operational state indicates critical risk requiring immediate action. Primary driver: ' || primary_driver || '. Recommended action: ' || recommendation || '.'
    WHEN 'P1' THEN 'Operational state indicates elevated risk ahead of a confirmed critical health reading (current health status: ' || health_status || '). Primary driver: ' || primary_driver || '. Recommended action: ' || recommendation || '.'
    WHEN 'P2' THEN 'Operational state indicates a warning condition or medium risk. Primary driver: ' || primary_driver || '. Recommended action: ' || recommendation || '.'
    ELSE 'Operational state indicates normal conditions with low risk. Primary driver: ' || primary_driver || '. Recommended action (if conditions change): ' || recommendation || '.' END AS description
FROM (SELECT *, CASE tier WHEN 'P0' THEN 'IMMEDIATE' WHEN 'P1' THEN 'IMMEDIATE' WHEN 'P2' THEN 'SOON' ELSE 'SCHEDULED' END AS urgency,
    CASE tier WHEN 'P0' THEN 'mitigate' WHEN 'P3' THEN 'monitor' ELSE 'investigate' END AS category,
    CASE tier WHEN 'P0' THEN 'Immediate mitigation required' WHEN 'P1' THEN 'Elevated risk identified' WHEN 'P2' THEN 'Investigation recommended'
      ELSE 'Continue monitoring' END AS title
  FROM (SELECT *, CASE WHEN health_status = 'CRITICAL' THEN 'P0' WHEN risk_level = 'HIGH' THEN 'P1'
      WHEN health_status = 'WARNING' OR risk_level = 'MEDIUM' THEN 'P2' ELSE 'P3' END AS tier FROM {s}))"""
relation("recommended", RECOMMENDED.format(s="states"), "states")
relation(
    "history",
    "SELECT *, 'run-' || batch || '-' || asset_id AS run_id, as_of AS started_at, obs_count::INTEGER AS observation_count FROM ("
    + RECOMMENDED.format(s="states_batch")
    + ")",
    "states_batch",
)
relation(
    "registry",
    """SELECT *, row_number() OVER (ORDER BY started_at, run_id) AS seq, lag(run_id) OVER w AS prev_run_id,
       lag(observation_count) OVER w AS prev_count, lag(assessment) OVER w AS prev_assessment, lag(priority) OVER w AS prev_priority,
       lag(recommendation) OVER w AS prev_recommendation,
       count(*) OVER (PARTITION BY assessment, priority ORDER BY started_at, run_id) - 1 AS recurrence_count
       FROM history WINDOW w AS (ORDER BY started_at, run_id)""",
    "history",
)


def states(spark, sf):
    return state.full_state(reasoning.reason(wh.observations(spark, sf), EVENTS_PROFILE))


def batched(spark, sf):
    obs = wh.observations(spark, sf)
    day = F.datediff(F.to_date("timestamp"), F.lit("2024-01-01"))
    return obs.withColumn("batch", F.floor(day / 10).cast("long"))


def run_history(spark, sf):
    """Finished runs are a small derived table that several windows reuse, so it is written once."""
    return cut_lineage(history.monitor(batched(spark, sf), EVENTS_PROFILE))


@query(
    "D10_operational_state",
    """SELECT asset_id, health_score::INTEGER AS health_score, health_status, risk_level,
       greatest(0, least(100, x_raw))::INTEGER AS confidence, primary_driver, recommendation AS recommended_action FROM states""",
    ("states",),
)
def d10(spark, sf):
    return states(spark, sf).select(
        "asset_id", "health_score", "health_status", "risk_level", F.col("x_confidence").alias("confidence"),
        "primary_driver", "recommended_action",
    )


@query(
    "D11_explainable_confidence",
    """SELECT asset_id, greatest(0, least(100, x_raw))::INTEGER AS value,
       'Base 35. Support ' || x_support || ' from ' || n_primary || ' observations. Severity ' || x_severity || ' from ' || priority
       || ' priority. Consistency ' || x_consistency || ' (' || CASE WHEN x_consistency = 15 THEN 'stable' ELSE 'mixed' END || '). Trend '
       || x_trend || ' (stability ' || stability_score || '/100, direction ' || direction || '). '
       || CASE WHEN x_sustained > 0 THEN 'Sustained directional change observed. ' ELSE 'No sustained directional change. ' END
       || CASE WHEN has_contradictions THEN 'Penalty -12 for contradictions. ' ELSE 'No contradiction penalty. ' END
       || 'Assessment: ' || assessment AS rationale FROM states""",
    ("states",),
)
def d11(spark, sf):
    return states(spark, sf).select("asset_id", F.col("x_confidence").alias("value"), F.col("x_rationale").alias("rationale"))


@query(
    "D12_explainable_decision",
    """SELECT asset_id, concat_ws('|', 'latest_reading=' || v1 || ' ' || last_unit, 'trend_analysis=' || t_summary,
         'recent_delta=Δ ' || printf('%.2f', v1 - v2) || ' ' || last_unit || ' (latest - previous)',
         'sample_support=' || n_primary || ' supporting observations', 'planner_alignment=' || priority || ' priority -> ' || recommendation) AS evidence,
       CASE WHEN variation = 'high' OR has_contradictions THEN 'Sensor drift:' || greatest(5, least(60, CAST(floor(x * 0.35) AS INTEGER)))
         ELSE 'Temporary overload:' || greatest(5, least(40, CAST(floor(x * 0.22) AS INTEGER))) END
       || CASE WHEN contains(lower(assessment), 'increasing') AND n_primary < 4 THEN '|Operating mode transition:' || greatest(5, least(50, CAST(floor(x * 0.25) AS INTEGER))) ELSE '' END AS alternatives,
       CASE WHEN contains(lower(assessment), 'increasing') OR priority = 'high' THEN
         'After investigation and corrective action, the driving signal should stabilize and return toward expected operating range.'
         WHEN contains(lower(assessment), 'stable') THEN 'Maintain current operating conditions; expect continued stability with routine monitoring.'
         ELSE 'Maintain current operations; expect the improving trend to continue if conditions remain unchanged.' END AS expected_outcome
       FROM (SELECT *, greatest(0, least(100, x_raw)) AS x FROM states)""",
    ("states",),
)
def d12(spark, sf):
    out = state.explainable_decision(states(spark, sf))
    pair = lambda a, b: (lambda e: F.concat(e[a], F.lit("=" if b == "observed_value" else ":"), e[b].cast("string")))
    return out.select(
        "asset_id",
        F.array_join(F.transform("x_evidence", pair("id", "observed_value")), "|").alias("evidence"),
        F.array_join(F.transform("alternatives", pair("title", "confidence")), "|").alias("alternatives"),
        "expected_outcome",
    )


@query(
    "D13_recommend",
    """SELECT asset_id, recommendation_id, tier AS priority, urgency, category, title, description,
       CASE tier WHEN 'P0' THEN 4 WHEN 'P1' THEN 3 WHEN 'P2' THEN 4 ELSE 3 END AS steps FROM recommended""",
    ("recommended",),
)
def d13(spark, sf):
    return states(spark, sf).select(
        "asset_id", "recommendation_id", F.col("rec_priority").alias("priority"), "urgency", "category", "title",
        "description", F.size("recommended_steps").alias("steps"),
    )


@query(
    "D14_notify",
    """SELECT notification_id, asset_id, recommendation_id, severity, 'OPEN' AS status, title, description AS message,
       as_of AS created_at FROM recommended WHERE notification_id IS NOT NULL""",
    ("recommended",),
)
def d14(spark, sf):
    return state.notifications(states(spark, sf))


@query(
    "X03_recommendation_id",
    "SELECT asset_id, recommendation_id FROM recommended",
    ("recommended",),
)
def x03(spark, sf):
    return states(spark, sf).select("asset_id", "recommendation_id")


@query(
    "D26_asset_name",
    """SELECT DISTINCT asset_id, replace(asset_id, '-', ' ') AS asset_name, 'unknown' AS asset_type, 'unknown' AS location FROM obs""",
    ("obs",),
)
def d26(spark, sf):
    return state.with_asset_name(wh.observations(spark, sf).select("asset_id").distinct(), spark)


@query(
    "D28_monitor",
    "SELECT run_id, asset_id, batch, started_at, assessment, priority, recommendation, health_score::INTEGER AS health_score FROM history",
    ("history",),
)
def d28(spark, sf):
    return history.monitor(batched(spark, sf), EVENTS_PROFILE).select(
        "run_id", "asset_id", "batch", "started_at", "assessment", "priority", "recommendation", "health_score"
    )


@query(
    "D29_reasoning_trace",
    """SELECT run_id, step_no::INTEGER AS step_no, ['Observations Loaded', 'Signal Extraction', 'Evidence Generation', 'Hypothesis Generation',
         'Assessment', 'Confidence', 'Explanation', 'Planning', 'Trend Detected', 'Variation Detected', 'Relationship Analysis',
         'Operational Context Built', 'Expectations Evaluated', 'Situation Assessed', 'Decision Context Created', 'Decision Planned',
         'Action Recorded', 'Outcome Recorded'][step_no] AS step FROM history, range(1, 19) t(step_no)""",
    ("history",),
)
def d29(spark, sf):
    return reasoning.trace_rows(history.monitor(batched(spark, sf), EVENTS_PROFILE)).select("run_id", "step_no", "step")


@query(
    "D30_decision_lineage",
    """SELECT run_id, situation_id, context_id, plan_id, action_id, 'outcome-' || substr(sha256(action_id), 1, 16) AS outcome_id FROM (
       SELECT *, 'action-' || substr(sha256(plan_id), 1, 16) AS action_id FROM (
       SELECT *, 'plan-' || substr(sha256(context_id), 1, 16) AS plan_id FROM (
       SELECT *, 'context-' || substr(sha256(situation_id), 1, 16) AS context_id FROM (
       SELECT run_id, 'situation-' || substr(sha256('goal-1|' || run_id), 1, 16) AS situation_id FROM history))))""",
    ("history",),
)
def d30(spark, sf):
    runs = history.monitor(batched(spark, sf), EVENTS_PROFILE)
    return history.decision_lineage(runs, "goal-1").select(
        "run_id", "situation_id", "context_id", "plan_id", "action_id", "outcome_id"
    )


@query(
    "D31_operational_context",
    """SELECT run_id, 'Operational reasoning context' AS description, NULL::VARCHAR AS operating_mode, recommendation AS objective
       FROM history""",
    ("history",),
)
def d31(spark, sf):
    runs = history.monitor(batched(spark, sf), EVENTS_PROFILE)
    context = F.struct(
        F.lit("Operational reasoning context").alias("description"),
        F.lit(None).cast("string").alias("operating_mode"),
        F.col("recommendation").alias("objective"),
    )
    return runs.select("run_id", context.alias("context")).select("run_id", "context.*")


@query(
    "W10_compare_runs",
    """SELECT run_id, prev_run_id, coalesce(observation_count <> prev_count, false) AS observation_count_changed,
       coalesce(assessment <> prev_assessment, false) AS assessment_changed, coalesce(priority <> prev_priority, false) AS priority_changed,
       coalesce(recommendation <> prev_recommendation, false) AS recommendation_changed FROM registry""",
    ("registry",),
)
def w10(spark, sf):
    return history.run_changes(run_history(spark, sf)).select(
        "run_id", "prev_run_id", "observation_count_changed", "assessment_changed", "priority_changed", "recommendation_changed"
    )


RANK = "CASE {} WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 WHEN 'critical' THEN 3 END"


@query(
    "W11_escalation",
    f"""SELECT run_id, coalesce(r > p, false) AS priority_escalated, coalesce(r < p, false) AS priority_deescalated,
       coalesce(r = p, false) AS priority_unchanged FROM (SELECT run_id, {RANK.format('priority')} AS r, {RANK.format('prev_priority')} AS p FROM registry)""",
    ("registry",),
)
def w11(spark, sf):
    return history.run_changes(run_history(spark, sf)).select(
        "run_id", "priority_escalated", "priority_deescalated", "priority_unchanged"
    )


@query(
    "W12_stability",
    """SELECT run_id, coalesce(was AND NOT now, false) AS became_more_stable, coalesce(NOT was AND now, false) AS became_less_stable,
       coalesce(was = now, false) AS stability_unchanged
       FROM (SELECT run_id, contains(prev_assessment, 'unstable') AS was, contains(assessment, 'unstable') AS now FROM registry)""",
    ("registry",),
)
def w12(spark, sf):
    return history.run_changes(run_history(spark, sf)).select(
        "run_id", "became_more_stable", "became_less_stable", "stability_unchanged"
    )


@query("W23_previous_run", "SELECT run_id, seq, prev_run_id FROM registry", ("registry",))
def w23(spark, sf):
    return history.with_previous_run(run_history(spark, sf), ["run_id"]).select("run_id", "seq", "prev_run_id")


@query(
    "W24_recurrence",
    "SELECT run_id, recurrence_count, recurrence_count > 0 AS is_recurring FROM registry",
    ("registry",),
)
def w24(spark, sf):
    positioned = history.registered(run_history(spark, sf))
    return history.with_recurrence(positioned).select("run_id", "recurrence_count", "is_recurring")


SUMMARY_SQL = f"""SELECT run_id, seq, priority, recommendation, recurrence_count, recurrence_count > 0 AS is_recurring,
  coalesce({RANK.format('priority')} > {RANK.format('prev_priority')}, false) AS priority_escalated,
  coalesce({RANK.format('priority')} < {RANK.format('prev_priority')}, false) AS priority_deescalated,
  coalesce(contains(prev_assessment, 'unstable') AND NOT contains(assessment, 'unstable'), false) AS became_more_stable,
  coalesce(NOT contains(prev_assessment, 'unstable') AND contains(assessment, 'unstable'), false) AS became_less_stable FROM registry"""


@query("W25_operational_summary", SUMMARY_SQL, ("registry",))
def w25(spark, sf):
    return history.operational_summary(run_history(spark, sf)).select(
        "run_id", "seq", "priority", "recommendation", "recurrence_count", "is_recurring", "priority_escalated",
        "priority_deescalated", "became_more_stable", "became_less_stable",
    )


@query(
    "W26_timeline_trend",
    f"""SELECT asset_id, count(*) AS runs, CASE WHEN count(*) < 2 THEN 'stable' WHEN max_by(r, started_at) > min_by(r, started_at) THEN 'worsening'
       WHEN max_by(r, started_at) < min_by(r, started_at) THEN 'improving' ELSE 'stable' END AS priority_trend
       FROM (SELECT *, {RANK.format('priority')} AS r FROM history) GROUP BY asset_id""",
    ("history",),
)
def w26(spark, sf):
    return history.priority_timeline_trend(history.monitor(batched(spark, sf), EVENTS_PROFILE))


@query(
    "T01_attention_queue",
    f"""SELECT run_id, priority, is_recurring, recurrence_count, priority_escalated,
       (CASE priority WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 4 END + is_recurring::INTEGER + priority_escalated::INTEGER)::INTEGER AS attention_score
       FROM ({SUMMARY_SQL})""",
    ("registry",),
)
def t01(spark, sf):
    return history.attention_queue(history.operational_summary(run_history(spark, sf))).select(
        "run_id", "priority", "is_recurring", "recurrence_count", "priority_escalated", "attention_score"
    )


relation("bounded_now", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY batch, asset_id, measurement_type ORDER BY pos DESC) AS age FROM bounded_batch) WHERE age <= 8", "bounded_batch")
relation(
    "b_now",
    """SELECT batch, asset_id, measurement_type, timestamp, value, row_number() OVER w AS pos, count(*) OVER (PARTITION BY batch, asset_id, measurement_type) AS n
       FROM bounded_now WINDOW w AS (PARTITION BY batch, asset_id, measurement_type ORDER BY pos)""",
    "bounded_now",
)
relation(
    "b_before",
    """SELECT batch, asset_id, measurement_type, timestamp, value, row_number() OVER (PARTITION BY batch, asset_id, measurement_type ORDER BY pos) AS pos,
         count(*) OVER (PARTITION BY batch, asset_id, measurement_type) AS n
       FROM (SELECT *, row_number() OVER (PARTITION BY batch, asset_id, measurement_type ORDER BY pos DESC) AS age FROM bounded_batch)
       WHERE age BETWEEN 2 AND 9""",
    "bounded_batch",
)
relation("diag_now", rs.DIAGNOSTICS.format(k="batch, asset_id", b="b_now"), "b_now")
relation("diag_before", rs.DIAGNOSTICS.format(k="batch, asset_id", b="b_before"), "b_before")
relation(
    "changes",
    """WITH base AS (SELECT h.*, lag(run_id) OVER w AS p_run, lag(recommendation) OVER w AS p_rec, lag(health_status) OVER w AS p_health,
         lag(risk_level) OVER w AS p_risk, lag(notification_id) OVER w AS p_note, n.direction AS n_dir, n.stability_score AS n_stab, b.direction AS b_dir
       FROM history h JOIN diag_now n ON h.batch = n.batch AND h.asset_id = n.asset_id AND h.primary_type = n.measurement_type
       LEFT JOIN diag_before b ON h.batch = b.batch AND h.asset_id = b.asset_id AND h.primary_type = b.measurement_type
       WINDOW w AS (PARTITION BY h.asset_id ORDER BY started_at, run_id))
     SELECT asset_id, run_id, started_at AS occurred_at, 'TrendChanged' AS event_type, 'trend_direction' AS change_type, b_dir AS previous, n_dir AS new, severity, title, recommendation_id, description
       FROM base WHERE n_primary >= 9 AND b_dir <> n_dir AND n_stab >= 70 AND n_dir <> 'stable'
     UNION ALL SELECT asset_id, run_id, started_at, 'RecommendationUpdated', 'recommendation', p_rec, recommendation, severity, title, recommendation_id, description FROM base WHERE p_rec <> recommendation
     UNION ALL SELECT asset_id, run_id, started_at, 'HealthChanged', 'health_status', p_health, health_status, severity, title, recommendation_id, description FROM base WHERE p_health <> health_status
     UNION ALL SELECT asset_id, run_id, started_at, 'RiskChanged', 'risk_level', p_risk, risk_level, severity, title, recommendation_id, description FROM base WHERE p_risk <> risk_level
     UNION ALL SELECT asset_id, run_id, started_at, 'NotificationCreated', 'notification', p_note, notification_id, severity, title, recommendation_id, description FROM base
       WHERE notification_id IS NOT NULL AND notification_id IS DISTINCT FROM p_note""",
    "history",
    "diag_now",
    "diag_before",
)


@query(
    "W14_state_change_events",
    "SELECT asset_id, run_id, occurred_at, event_type, change_type, previous, new FROM changes",
    ("changes",),
)
def w14(spark, sf):
    return history.change_events(run_history(spark, sf)).select(
        "asset_id", "run_id", "occurred_at", "event_type", "change_type", "previous", "new"
    )


@query(
    "S09_integration_events",
    """SELECT sha256(asset_id || '|' || run_id || '|' || event_type) AS event_id, CASE event_type WHEN 'NotificationCreated' THEN 'NotificationRaised' ELSE 'OperationalStateChanged' END AS type,
       CASE WHEN event_type <> 'NotificationCreated' THEN change_type END AS change_type, occurred_at, asset_id, run_id FROM changes
       UNION ALL SELECT sha256(asset_id || '|' || run_id || '|ReasoningCompleted'), 'DigitalTwinUpdated', NULL, started_at, asset_id, run_id FROM history""",
    ("changes",),
)
def s09(spark, sf):
    runs = run_history(spark, sf)
    domain = history.change_events(runs).unionByName(history.reasoning_events(runs), allowMissingColumns=True)
    return history.integration_events(domain).drop("payload")


relation(
    "timeline",
    """SELECT 'observation_received:' || id AS event_id, asset_id, timestamp, 'observation_received' AS event_type, 'Observation received' AS title,
         'New observation ' || id || ' recorded for the asset.' AS description FROM obs
       UNION ALL SELECT 'reasoning_started:' || run_id, asset_id, started_at, 'reasoning_started', 'Reasoning started', 'Reasoning run ' || run_id || ' began for the asset.' FROM history
       UNION ALL SELECT 'reasoning_completed:' || run_id, asset_id, started_at, 'reasoning_completed', 'Reasoning completed', 'Reasoning run ' || run_id || ' finished for the asset.' FROM history
       UNION ALL SELECT CASE event_type WHEN 'TrendChanged' THEN 'trend_changed' WHEN 'RecommendationUpdated' THEN 'recommendation_updated' WHEN 'HealthChanged' THEN 'health_changed'
           WHEN 'RiskChanged' THEN 'risk_changed' ELSE 'notification_created' END || ':' || run_id, asset_id, occurred_at,
         CASE event_type WHEN 'TrendChanged' THEN 'trend_changed' WHEN 'RecommendationUpdated' THEN 'recommendation_updated' WHEN 'HealthChanged' THEN 'health_changed'
           WHEN 'RiskChanged' THEN 'risk_changed' ELSE 'notification_created' END,
         CASE event_type WHEN 'TrendChanged' THEN 'Trend changed' WHEN 'RecommendationUpdated' THEN 'Recommendation updated' WHEN 'HealthChanged' THEN 'Health status changed'
           WHEN 'RiskChanged' THEN 'Risk level changed' ELSE 'Notification created' END,
         CASE event_type WHEN 'NotificationCreated' THEN severity || ': ' || title || '. Linked recommendation ' || recommendation_id || '.'
           ELSE CASE event_type WHEN 'TrendChanged' THEN 'Trend changed' WHEN 'RecommendationUpdated' THEN 'Recommendation changed' WHEN 'HealthChanged' THEN 'Health status changed'
             ELSE 'Risk level changed' END || ' from ''' || previous || ''' to ''' || new || '''.' END FROM changes""",
    "obs",
    "changes",
    "history",
)
RANKS = """CASE event_type WHEN 'observation_received' THEN 0 WHEN 'reasoning_started' THEN 1 WHEN 'trend_changed' THEN 2
  WHEN 'recommendation_updated' THEN 3 WHEN 'notification_created' THEN 4 WHEN 'health_changed' THEN 5 WHEN 'risk_changed' THEN 6
  WHEN 'reasoning_completed' THEN 7 ELSE 99 END"""


def timeline(spark, sf):
    runs = run_history(spark, sf)
    return history.timeline(wh.observations(spark, sf), runs, history.change_events(runs))


@query("U06_union_timeline", "SELECT event_id, asset_id, timestamp, event_type, title, description FROM timeline", ("timeline",))
def u06(spark, sf):
    return timeline(spark, sf).drop("metadata")


@query(
    "T08_timeline_order",
    f"""SELECT asset_id, event_id, event_type, row_number() OVER (PARTITION BY asset_id ORDER BY age DESC) ::INTEGER AS position FROM (
       SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY timestamp DESC, {RANKS} DESC, event_id DESC) AS age FROM timeline) WHERE age <= 5""",
    ("timeline",),
)
def t08(spark, sf):
    return history.timeline_preview(timeline(spark, sf)).select("asset_id", "event_id", "event_type", "position")


@query(
    "W32_latest_notification",
    """SELECT asset_id, new AS notification_id, recommendation_id, severity, 'OPEN' AS status, title, description AS message, occurred_at AS created_at FROM (
       SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY occurred_at DESC, run_id DESC) AS age FROM changes WHERE event_type = 'NotificationCreated') WHERE age = 1""",
    ("changes",),
)
def w32(spark, sf):
    return history.latest_notification(timeline(spark, sf))


@query(
    "J06_runs_for_asset",
    """SELECT asset_id, run_id, started_at, rank::INTEGER AS rank FROM (SELECT asset_id, run_id, started_at, row_number() OVER (PARTITION BY asset_id
       ORDER BY started_at DESC, run_id DESC) AS rank FROM history) WHERE rank <= 2""",
    ("history",),
)
def j06(spark, sf):
    runs = history.monitor(batched(spark, sf), EVENTS_PROFILE).select("asset_id", "run_id", "started_at")
    return history.latest_runs(runs, 2).withColumnRenamed("_age", "rank")


relation(
    "run_index",
    "SELECT 'run-' || batch || '-' || asset_id AS run_id, batch, asset_id, id, timestamp, value FROM bounded_batch",
    "bounded_batch",
)


@query(
    "J07_run_details",
    """SELECT h.run_id, h.asset_id, h.started_at, h.assessment, h.priority, h.confidence::INTEGER AS confidence, 18 AS trace_steps, count(i.id) AS observations,
       min(i.timestamp) AS first_seen, max(i.timestamp) AS last_seen
       FROM history h JOIN run_index i USING (run_id) GROUP BY ALL""",
    ("history", "run_index"),
)
def j07(spark, sf):
    obs = batched(spark, sf)
    runs = history.monitor(obs, EVENTS_PROFILE)
    steps = reasoning.trace_rows(runs).groupBy("run_id").agg(F.count(F.lit(1)).cast("int").alias("trace_steps"))
    used = (
        history.resolve_observations(history.run_index(obs), wh.observations(spark, sf))
        .groupBy("run_id")
        .agg(F.count("id").alias("observations"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"))
    )
    head = runs.select("run_id", "asset_id", "started_at", "assessment", "priority", "confidence")
    return head.join(steps, "run_id").join(used, "run_id")


@query(
    "J08_resolve_observation_ids",
    """SELECT run_id, id, timestamp, value FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY timestamp, id) AS rk FROM run_index) WHERE rk <= 8""",
    ("run_index",),
)
def j08(spark, sf):
    index = history.run_index(batched(spark, sf))
    return history.resolve_observations(index, wh.observations(spark, sf), 8).select("run_id", "id", "timestamp", "value")


@query("J17_list_runs", "SELECT run_id, seq, started_at, priority FROM registry", ("registry",))
def j17(spark, sf):
    runs = run_history(spark, sf)
    entries = history.registered(runs.select("run_id", "started_at")).select("run_id", "seq")
    return history.missing_runs_guard(entries, runs.select("run_id", "started_at", "priority"))


@query(
    "J18_latest_run_touching",
    """SELECT asset_id, max_by(run_id, started_at) AS run_id FROM history GROUP BY asset_id""",
    ("history",),
)
def j18(spark, sf):
    obs = batched(spark, sf)
    return history.latest_run_touching(
        history.run_index(obs), history.monitor(obs, EVENTS_PROFILE), wh.observations(spark, sf)
    )


relation(
    "snapshot",
    f"""SELECT a.asset_id, replace(a.asset_id, '-', ' ') AS asset_name, h.run_id AS latest_run_id, h.health_status, h.health_score::INTEGER AS health_score, h.risk_level,
       h.tier AS recommendation_priority, n.new AS notification_id, p.preview
     FROM (SELECT DISTINCT asset_id FROM obs) a
     LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY started_at DESC, run_id DESC) AS age FROM history) WHERE age = 1) h USING (asset_id)
     LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY occurred_at DESC, run_id DESC) AS age2 FROM changes
        WHERE event_type = 'NotificationCreated') WHERE age2 = 1) n USING (asset_id)
     LEFT JOIN (SELECT asset_id, string_agg(event_type, '|' ORDER BY age DESC) AS preview FROM (
        SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY timestamp DESC, {RANKS} DESC, event_id DESC) AS age FROM timeline) WHERE age <= 5 GROUP BY asset_id) p USING (asset_id)""",
    "obs",
    "history",
    "timeline",
    "changes",
)


def snapshot(spark, sf):
    runs = run_history(spark, sf)
    obs = wh.observations(spark, sf)
    events = history.timeline(obs, runs, history.change_events(runs))
    latest = history.latest_runs(runs).select(
        "asset_id", F.col("run_id").alias("latest_run_id"), "health_status", "health_score", "risk_level",
        F.col("rec_priority").alias("recommendation_priority"),
    )
    notice = history.latest_notification(events).select("asset_id", "notification_id")
    preview = (
        history.timeline_preview(events)
        .groupBy("asset_id")
        .agg(F.array_sort(F.collect_list(F.struct("position", "event_type"))).alias("_p"))
        .select("asset_id", F.array_join(F.transform("_p", lambda e: e["event_type"]), "|").alias("preview"))
    )
    assets = state.with_asset_name(obs.select("asset_id").distinct(), spark).select("asset_id", "asset_name")
    return assets.join(latest, "asset_id", "left").join(notice, "asset_id", "left").join(preview, "asset_id", "left")


@query("J14_asset_snapshot", "SELECT * FROM snapshot", ("snapshot",))
def j14(spark, sf):
    return snapshot(spark, sf)


@query(
    "J19_fleet_summary",
    """SELECT asset_id, CASE WHEN latest_run_id IS NOT NULL THEN asset_name END AS asset_name, health_status, health_score,
       CASE WHEN latest_run_id IS NOT NULL THEN notification_id IS NOT NULL END AS has_active_notification FROM snapshot""",
    ("snapshot",),
)
def j19(spark, sf):
    known = F.col("latest_run_id").isNotNull()
    return snapshot(spark, sf).select(
        "asset_id",
        F.when(known, F.col("asset_name")).alias("asset_name"),
        "health_status",
        "health_score",
        F.when(known, F.col("notification_id").isNotNull()).alias("has_active_notification"),
    )


@query(
    "A42_expectation_counts",
    """SELECT batch, count(*) FILTER (expectation = 'expected') AS expected_count, count(*) FILTER (expectation = 'unexpected') AS unexpected_count,
       count(*) FILTER (expectation = 'indeterminate') AS indeterminate_count,
       count(*) FILTER (expectation = 'unexpected') > 0 AS has_unexpected, count(*) FILTER (expectation = 'indeterminate') > 0 AS has_indeterminate
       FROM history GROUP BY batch""",
    ("history",),
)
def a42(spark, sf):
    runs = history.monitor(batched(spark, sf), EVENTS_PROFILE)
    count = lambda s: F.count_if(F.col("expectation") == s)
    return runs.groupBy("batch").agg(
        count("expected").alias("expected_count"),
        count("unexpected").alias("unexpected_count"),
        count("indeterminate").alias("indeterminate_count"),
        (count("unexpected") > 0).alias("has_unexpected"),
        (count("indeterminate") > 0).alias("has_indeterminate"),
    )


@query(
    "U04_distinct_ids",
    """SELECT run_id, count(*) AS ids, sha256(string_agg(id, ',' ORDER BY timestamp, id)) AS id_hash FROM run_index GROUP BY run_id""",
    ("run_index",),
)
def u04(spark, sf):
    index = history.run_index(batched(spark, sf))
    merged = F.array_distinct(F.concat("observation_ids", F.reverse("observation_ids")))
    return index.select(
        "run_id", F.size(merged).cast("long").alias("ids"), F.sha2(F.array_join(merged, ","), 256).alias("id_hash")
    )
