"""Operational state, recommendation, notification and the explainable decision of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.functions import fixed
from sensorloom.functions.scalar import number_text
from sensorloom.operators import trends


def with_trend_state(runs: DataFrame) -> DataFrame:
    """Diagnostics of the primary series (``t_`` columns) plus its sentence ``t_summary``."""
    out = trends.with_diagnostics(runs, "primary_values", "t_")
    return out.withColumn("t_summary", trends.trend_sentence(F.col("primary_type"), "t_"))


def with_explainable_confidence(runs: DataFrame) -> DataFrame:
    """Score that also weighs severity and trend stability (needs :func:`with_trend_state`)."""
    stability = F.col("t_stability_score")
    high = F.col("variation") == "high"
    settled = (stability >= 65) & ~high
    sustained = (
        (F.col("t_direction") != "stable") & (F.coalesce(F.col("t_monotonicity"), F.lit(0.0)) >= 0.85) & (stability >= 70)
    )
    severity = F.when(F.col("priority") == "high", 25).when(F.col("priority") == "medium", 15).when(
        F.col("priority") == "low", 5
    ).otherwise(10)
    out = runs.withColumns(
        {
            "x_support": F.least(F.lit(25), F.least(F.col("n_primary"), F.lit(3)) * 8),
            "x_severity": severity,
            "x_consistency": F.when(settled, 15).otherwise(5),
            "x_trend": F.when(stability >= 75, 12).when(stability >= 60, 8).when(stability >= 45, 4).otherwise(0),
            "x_sustained": F.when(sustained, 6).otherwise(0),
            "x_penalty": F.when(F.col("has_contradictions"), -12).otherwise(0),
        }
    )
    parts = ("x_support", "x_severity", "x_consistency", "x_trend", "x_sustained", "x_penalty")
    total = sum((F.col(p) for p in parts), F.lit(35))
    rationale = F.format_string(
        "Base 35. Support %d from %d observations. Severity %d from %s priority. Consistency %d (%s). "
        "Trend %d (stability %d/100, direction %s). %s %s Assessment: %s",
        "x_support",
        "n_primary",
        "x_severity",
        "priority",
        "x_consistency",
        F.when(settled, "stable").otherwise("mixed"),
        "x_trend",
        "t_stability_score",
        "t_direction",
        F.when(sustained, "Sustained directional change observed.").otherwise("No sustained directional change."),
        F.when(F.col("has_contradictions"), "Penalty -12 for contradictions.").otherwise("No contradiction penalty."),
        "assessment",
    )
    return out.withColumn("x_confidence", F.greatest(F.lit(0), F.least(F.lit(100), total))).withColumn("x_rationale", rationale)


def with_operational_state(runs: DataFrame) -> DataFrame:
    """Health score and status, risk level, confidence and primary driver."""
    out = with_explainable_confidence(with_trend_state(runs))
    sustained = F.col("t_direction").isin("rising", "falling") & (F.col("t_stability_score") >= 65)
    priority_penalty = F.when(F.col("priority") == "high", 45).when(F.col("priority") == "medium", 25).when(
        F.col("priority") == "low", 10
    ).otherwise(20)
    trend_penalty = (
        F.when(sustained, 15).otherwise(0)
        + F.when(F.col("t_volatility_score") >= 60, 10).otherwise(0)
        - F.when((F.col("t_direction") == "stable") & (F.col("t_stability_score") >= 75), 5).otherwise(0)
    )
    assessment_penalty = F.when(F.col("has_contradictions"), 15).otherwise(0) + F.when(F.col("has_unexpected"), 10).otherwise(0)
    score = F.greatest(F.lit(0), F.least(F.lit(100), 100 - priority_penalty - trend_penalty - assessment_penalty))
    out = out.withColumn("health_score", score)
    health = F.when(F.col("health_score") >= 75, "NORMAL").when(F.col("health_score") >= 45, "WARNING").otherwise("CRITICAL")
    out = out.withColumn("health_status", health)
    risk = (
        F.when((F.col("priority") == "high") | (F.col("health_status") == "CRITICAL"), "HIGH")
        .when((F.col("priority") == "medium") | (F.col("health_status") == "WARNING"), "MEDIUM")
        .otherwise("LOW")
    )
    driver = (
        F.when(F.col("has_contradictions"), "Contradictory signals detected in structured assessment.")
        .when(F.col("has_unexpected"), "Unexpected expectation signals detected in assessment.")
        .when(sustained, F.concat(F.lit("Trend: "), F.col("t_summary")))
        .otherwise(F.concat(F.lit("Decision priority: "), F.col("priority")))
    )
    return out.withColumns({"risk_level": risk, "primary_driver": driver, "recommended_action": F.col("recommendation")})


def _fill(text: str) -> Column:
    out = F.lit(text)
    for mark, column in (("{d}", "primary_driver"), ("{a}", "recommended_action"), ("{h}", "health_status")):
        if mark in text:
            out = F.replace(out, F.lit(mark), F.col(column))
    return out


def with_recommendation(states: DataFrame) -> DataFrame:
    """Recommendation tier P0..P3 with texts, steps and a stable id."""
    tier = (
        F.when(F.col("health_status") == "CRITICAL", "P0")
        .when(F.col("risk_level") == "HIGH", "P1")
        .when((F.col("health_status") == "WARNING") | (F.col("risk_level") == "MEDIUM"), "P2")
        .otherwise("P3")
    )
    out = states.withColumn("rec_priority", tier)
    pick = lambda make: F.coalesce(*[F.when(F.col("rec_priority") == t, make(v)) for t, v in fixed.RECOMMENDATIONS.items()])
    out = out.withColumns(
        {
            "urgency": pick(lambda v: F.lit(v[0])),
            "category": pick(lambda v: F.lit(v[1])),
            "title": pick(lambda v: F.lit(v[2])),
            "estimated_impact": pick(lambda v: F.lit(v[3])),
            "description": pick(lambda v: _fill(v[4])),
            "recommended_steps": pick(lambda v: F.array(*[_fill(s) for s in v[5]])),
        }
    )
    return out.withColumn("recommendation_id", recommendation_id())


def recommendation_id() -> Column:
    identity = F.concat_ws("|", "asset_id", "category", "rec_priority", "urgency", "title")
    return F.concat(F.lit("rec-"), F.col("asset_id"), F.lit("-"), F.substring(F.sha2(identity, 256), 1, 16))


def with_notification(recommended: DataFrame) -> DataFrame:
    """Severity and id of the notification; null where the tier raises none."""
    severity = F.when(F.col("rec_priority") == "P0", "CRITICAL").when(F.col("rec_priority").isin("P1", "P2"), "WARNING")
    out = recommended.withColumn("notification_severity", severity)
    return out.withColumn(
        "notification_id", F.when(severity.isNotNull(), F.concat(F.lit("notif-"), F.col("recommendation_id")))
    )


def notifications(recommended: DataFrame) -> DataFrame:
    """One OPEN notification per run whose tier raises one.

    Emitted through ``explode`` rather than a filter: pushing a predicate on the derived
    id below the rule columns would make the optimizer repeat all of them.
    """
    row = F.struct(
        F.col("notification_id"),
        "asset_id",
        "recommendation_id",
        F.col("notification_severity").alias("severity"),
        F.lit("OPEN").alias("status"),
        "title",
        F.col("description").alias("message"),
        F.col("as_of").alias("created_at"),
    )
    raised = F.array_compact(F.array(F.when(F.col("notification_id").isNotNull(), row)))
    return with_notification(recommended).select(F.explode(raised).alias("_n")).select("_n.*")


def full_state(runs: DataFrame) -> DataFrame:
    return with_notification(with_recommendation(with_operational_state(runs)))


def explainable_decision(states: DataFrame) -> DataFrame:
    """Evidence items, one or two alternatives and the expected outcome of each run."""
    delta = F.format_string("Δ %.2f %s (latest - previous)", F.col("last_value") - F.col("prev_value"), F.col("last_unit"))
    item = lambda i, v, w: F.struct(F.lit(i).alias("id"), v.alias("observed_value"), w.alias("weight"))
    evidence = F.array_compact(
        F.array(
            item("latest_reading", F.concat_ws(" ", number_text(F.col("last_value")), F.col("last_unit")), F.lit(0.35)),
            item("trend_analysis", F.col("t_summary"), F.lit(0.25)),
            F.when(F.col("n_primary") >= 2, item("recent_delta", delta, F.lit(0.3))),
            item(
                "sample_support",
                F.concat(F.col("n_primary").cast("string"), F.lit(" supporting observations")),
                F.when(F.col("n_primary") >= 3, 0.2).otherwise(0.15),
            ),
            item("planner_alignment", F.concat_ws(" priority -> ", "priority", "recommendation"), F.lit(0.15)),
        )
    )
    score = F.col("x_confidence")
    scaled = lambda share, cap: F.greatest(F.lit(5), F.least(F.lit(cap), F.floor(score * share).cast("int")))
    alternative = lambda name, conf: F.struct(
        F.lit(fixed.LEGACY_ALTERNATIVES[name][0]).alias("title"),
        F.replace(F.lit(fixed.LEGACY_ALTERNATIVES[name][1]), F.lit("{m}"), F.col("primary_type")).alias("reason"),
        conf.alias("confidence"),
    )
    text = F.lower("assessment")
    doubtful = (F.col("variation") == "high") | F.col("has_contradictions")
    alternatives = F.array_compact(
        F.array(
            F.when(doubtful, alternative("drift", scaled(0.35, 60))).otherwise(alternative("overload", scaled(0.22, 40))),
            F.when(text.contains("increasing") & (F.col("n_primary") < 4), alternative("mode", scaled(0.25, 50))),
        )
    )
    outcome = (
        F.when(text.contains("increasing") | (F.col("priority") == "high"), fixed.EXPECTED_OUTCOMES["driving"])
        .when(text.contains("stable"), fixed.EXPECTED_OUTCOMES["stable"])
        .when(text.contains("improving"), fixed.EXPECTED_OUTCOMES["improving"])
        .otherwise(
            F.format_string("Execute recommendation (%s) and verify the measured signal moves toward expected behavior.", "recommendation")
        )
    )
    return states.withColumns({"x_evidence": evidence, "alternatives": alternatives, "expected_outcome": outcome})


def with_asset_name(df: DataFrame, spark) -> DataFrame:
    """Catalog name, type and location; unknown assets get a derived name."""
    rows = [(k, *v) for k, v in fixed.ASSET_CATALOG.items()]
    catalog = spark.createDataFrame(rows, "asset_id string, _name string, _type string, _location string")
    derived = F.trim(F.replace(F.col("asset_id"), F.lit("-"), F.lit(" ")))
    return (
        df.join(F.broadcast(catalog), "asset_id", "left")
        .withColumn("asset_name", F.coalesce("_name", F.when(F.length(derived) > 0, derived).otherwise(F.col("asset_id"))))
        .withColumn("asset_type", F.coalesce("_type", F.lit("unknown")))
        .withColumn("location", F.coalesce("_location", F.lit("unknown")))
        .drop("_name", "_type", "_location")
    )
