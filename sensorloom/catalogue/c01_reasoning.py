"""Decision-chain queries over the event readings."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom.catalogue import reasoning_sql as rs
from sensorloom.catalogue.registry import query
from sensorloom.operators import trends
from sensorloom.plans import reasoning
from sensorloom.plans.reasoning import EVENTS_PROFILE
from sensorloom.sources import warehouse as wh


def reasoned(spark, sf):
    return reasoning.reason(wh.observations(spark, sf), EVENTS_PROFILE)


@query("W04_trend_direction", "SELECT asset_id, measurement_type, n::INTEGER AS n, trend FROM trend", ("trend",))
def w04(spark, sf):
    return trends.trend_signals(wh.observations(spark, sf)).select("asset_id", "measurement_type", "n", "trend")


@query("W05_variation_level", "SELECT asset_id, measurement_type, n::INTEGER AS n, variation FROM trend", ("trend",))
def w05(spark, sf):
    return trends.trend_signals(wh.observations(spark, sf)).select("asset_id", "measurement_type", "n", "variation")


@query(
    "W06_trend_diagnostics",
    """SELECT asset_id, measurement_type, direction, round(rate_of_change, 6) AS rate_of_change,
       round(monotonicity, 6) AS monotonicity, stability_score, volatility_score FROM diagnosed8""",
    ("diagnosed8",),
)
def w06(spark, sf):
    arrays = trends.recent_arrays(trends.bound_recent(wh.observations(spark, sf), 8))
    return trends.with_diagnostics(arrays).select(
        "asset_id",
        "measurement_type",
        "direction",
        F.round("rate_of_change", 6).alias("rate_of_change"),
        F.round("monotonicity", 6).alias("monotonicity"),
        "stability_score",
        "volatility_score",
    )


@query(
    "W07_trend_summary",
    f"SELECT asset_id, measurement_type, {rs.SENTENCE.format(l='measurement_type')} AS summary FROM diagnosed",
    ("diagnosed",),
)
def w07(spark, sf):
    arrays = trends.recent_arrays(trends.bound_recent(wh.observations(spark, sf), 20))
    return trends.with_diagnostics(arrays).select(
        "asset_id", "measurement_type", trends.trend_sentence(F.col("measurement_type")).alias("summary")
    )


@query(
    "W08_monotonic_last3",
    """SELECT asset_id, measurement_type, coalesce(n >= 3 AND ((v3 <= v2 AND v2 <= v1) OR (v3 >= v2 AND v2 >= v1)), false)
       AS monotonic FROM trend""",
    ("trend",),
)
def w08(spark, sf):
    arrays = trends.recent_arrays(trends.bound_recent(wh.observations(spark, sf), 3))
    padded = F.concat(F.array_repeat(F.lit(None).cast("double"), 2), F.col("values"))
    return arrays.select("asset_id", "measurement_type", trends.monotonic_tail(padded, F.col("n")).alias("monotonic"))


@query(
    "W09_relationships",
    """SELECT asset_id, array_to_string(correlations, '|') AS correlations, array_to_string(contradictions, '|') AS contradictions
       FROM reasoned""",
    ("reasoned",),
)
def w09(spark, sf):
    signals = reasoning.with_relationships(reasoning.asset_signals(wh.observations(spark, sf)), EVENTS_PROFILE)
    return signals.select(
        "asset_id",
        F.array_join(F.transform("correlations", lambda c: c["relationship"]), "|").alias("correlations"),
        F.array_join("contradictions", "|").alias("contradictions"),
    )


@query("D01_assess", "SELECT asset_id, assessment FROM reasoned", ("reasoned",))
def d01(spark, sf):
    signals = reasoning.with_relationships(reasoning.asset_signals(wh.observations(spark, sf)), EVENTS_PROFILE)
    return signals.select("asset_id", reasoning.assessment_text().alias("assessment"))


@query(
    "D02_structured_assessment",
    """SELECT asset_id, trend, variation, has_correlations, has_contradictions, has_unexpected, has_indeterminate
       FROM reasoned""",
    ("reasoned",),
)
def d02(spark, sf):
    return reasoned(spark, sf).select(
        "asset_id", "trend", "variation", "has_correlations", "has_contradictions", "has_unexpected", "has_indeterminate"
    )


@query(
    "D03_expectations",
    """SELECT asset_id, expectation, CASE expectation
         WHEN 'expected' THEN 'The observed behavior matches this engineering expectation.'
         WHEN 'unexpected' THEN 'The observed behavior diverges from this engineering expectation.'
         ELSE 'Insufficient evidence is available to evaluate this expectation.' END AS explanation FROM reasoned""",
    ("reasoned",),
)
def d03(spark, sf):
    from sensorloom.functions import fixed

    return reasoned(spark, sf).select(
        "asset_id", "expectation", reasoning.lookup(fixed.EXPECTATION_TEXT, F.col("expectation")).alias("explanation")
    )


EVIDENCE_SQL = """
SELECT asset_id, 1 AS item, 'latest_reading' AS id, trim(CAST(v1 AS VARCHAR) || ' ' || last_unit) AS observed_value, 0.35::DOUBLE AS weight FROM reasoned
UNION ALL SELECT asset_id, 2, 'detected_trend', 'Direction: ' || trend, 0.25 FROM reasoned
UNION ALL SELECT asset_id, 3, 'detected_variation', 'Variation: ' || variation, 0.15 FROM reasoned
UNION ALL SELECT asset_id, 4, 'recent_delta', 'Δ ' || printf('%.2f', v1 - v2) || ' ' || last_unit || ' (latest - previous)', 0.3 FROM reasoned
UNION ALL SELECT asset_id, 5, 'sample_support', n_primary || ' supporting observations', CASE WHEN n_primary >= 3 THEN 0.2 ELSE 0.15 END FROM reasoned
UNION ALL SELECT asset_id, 5 + i, 'relationship_correlation:' || CASE correlations[i] WHEN 'View increasing while click decreasing' THEN 'view:click'
    WHEN 'Signup increasing while purchase decreasing' THEN 'signup:purchase' ELSE 'error:purchase' END, correlations[i], 0.2
  FROM (SELECT *, unnest(range(1, len(correlations) + 1)) AS i FROM reasoned)
UNION ALL SELECT asset_id, 5 + len(correlations) + i, 'relationship_contradiction:' || (i - 1), contradictions[i], 0.2
  FROM (SELECT *, unnest(range(1, len(contradictions) + 1)) AS i FROM reasoned)"""


@query("D04_evidence", f"SELECT asset_id, item::INTEGER AS item, id, observed_value, weight FROM ({EVIDENCE_SQL})", ("reasoned",))
def d04(spark, sf):
    items = reasoned(spark, sf).select("asset_id", F.posexplode("evidence").alias("pos", "e"))
    return items.select("asset_id", (F.col("pos") + 1).alias("item"), F.col("e.id"), F.col("e.observed_value"), F.col("e.weight"))


@query(
    "D05_hypotheses",
    """SELECT asset_id, CASE WHEN has_unexpected THEN 'hydrogen_supply' WHEN variation = 'high' OR has_contradictions THEN 'sensor_drift'
         ELSE 'load_change' END AS kind,
       CASE WHEN has_unexpected THEN '' WHEN variation = 'high' OR has_contradictions THEN
         'detected_variation' || CASE WHEN len(contradictions) > 0 THEN '|' || array_to_string(list_transform(range(0, len(contradictions)),
           lambda i: 'relationship_contradiction:' || i), '|') ELSE '' END
         ELSE 'latest_reading|detected_trend' END AS supporting FROM reasoned""",
    ("reasoned",),
)
def d05(spark, sf):
    items = reasoned(spark, sf).select("asset_id", F.explode("hypotheses").alias("h"))
    return items.select("asset_id", F.col("h.kind"), F.array_join("h.supporting_evidence_ids", "|").alias("supporting"))


@query(
    "D06_confidence",
    """SELECT asset_id, support::INTEGER AS support, consistency, trend_consistency, sustained_bonus, penalties,
       confidence::INTEGER AS confidence,
       'Base 35. Support ' || support || ' from ' || n_primary || ' observations. Consistency ' || consistency || ' ('
       || CASE WHEN consistency = 15 THEN 'stable' ELSE 'mixed' END || '). Trend ' || trend_consistency || ' (direction ' || trend || '). '
       || CASE WHEN sustained_bonus > 0 THEN 'Sustained directional change observed. ' ELSE 'No sustained directional change. ' END
       || CASE WHEN has_contradictions THEN 'Penalty -12 for contradictions. ' ELSE 'No contradiction penalty. ' END
       || CASE WHEN has_unexpected THEN 'Penalty -6 for unexpected expectations. ' ELSE 'No unexpected-expectation penalty. ' END
       || 'Assessment: ' || assessment AS rationale FROM reasoned""",
    ("reasoned",),
)
def d06(spark, sf):
    return reasoned(spark, sf).select(
        "asset_id", "support", "consistency", "trend_consistency", "sustained_bonus", "penalties", "confidence", "rationale"
    )


@query(
    "D07_explanation",
    """SELECT asset_id, 'Assessment: ' || assessment || ' Confidence in assessment: ' || confidence || '/100.' AS summary,
       concat_ws('|', CASE WHEN has_contradictions THEN 'Cross-measurement contradictions weaken certainty.' END,
         CASE WHEN has_unexpected THEN 'Unexpected expectation signals were detected.' END,
         CASE WHEN has_indeterminate THEN 'Some expectations remain indeterminate.' END) AS caveats FROM reasoned""",
    ("reasoned",),
)
def d07(spark, sf):
    return reasoned(spark, sf).select("asset_id", "summary", F.array_join("caveats", "|").alias("caveats"))


@query("D08_plan", "SELECT asset_id, priority, recommendation, justification FROM reasoned", ("reasoned",))
def d08(spark, sf):
    return reasoned(spark, sf).select("asset_id", "priority", "recommendation", "justification")


@query(
    "D09_planning_context",
    """SELECT asset_id, has_correlations OR has_contradictions AS has_relationships, has_contradictions FROM reasoned""",
    ("reasoned",),
)
def d09(spark, sf):
    return reasoned(spark, sf).select(
        "asset_id", (F.col("has_correlations") | F.col("has_contradictions")).alias("has_relationships"), "has_contradictions"
    )


@query(
    "D27_reason",
    """SELECT asset_id, as_of, obs_count::INTEGER AS observation_count, primary_type, n_primary::INTEGER AS n_primary, trend,
       variation, expectation, confidence::INTEGER AS confidence, assessment, priority, recommendation, justification
       FROM reasoned""",
    ("reasoned",),
)
def d27(spark, sf):
    return reasoned(spark, sf).select(
        "asset_id", "as_of", "observation_count", "primary_type", "n_primary", "trend", "variation", "expectation",
        "confidence", "assessment", "priority", "recommendation", "justification",
    )
