"""From recent readings to an assessed, explained and planned decision per asset."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.functions import fixed
from sensorloom.functions.scalar import label_lower, label_title, number_text
from sensorloom.operators import trends


@dataclass(frozen=True)
class Profile:
    """Relationship rules (pairs of measurement types) and whether expectations are evaluated."""

    correlations: tuple[tuple[str, str], ...] = fixed.DEFAULT_RULES
    contradictions: tuple[tuple[str, str], ...] = fixed.DEFAULT_RULES
    evaluates_expectations: bool = False


FUEL_CELL = Profile(fixed.FUEL_CELL_CORRELATIONS, (), True)
EVENTS_PROFILE = Profile(
    (("view", "click"), ("signup", "purchase"), ("error", "purchase")),
    (("view", "click"), ("signup", "purchase"), ("error", "purchase")),
    True,
)

EVIDENCE_TYPE = (
    "struct<id:string,description:string,source_signal:string,measurement_type:string,"
    "observed_value:string,role:string,weight:double>"
)


def lookup(mapping: dict, key: Column) -> Column:
    chain = None
    for k, v in mapping.items():
        chain = F.when(key == k, F.lit(v)) if chain is None else chain.when(key == k, F.lit(v))
    return chain


def with_relationships(df: DataFrame, profile: Profile) -> DataFrame:
    """Add correlation and contradiction arrays from the ``trends`` map column."""
    trend = lambda name: F.element_at("trends", F.lit(name))
    found, clashes = [], []
    for a, b in profile.correlations:
        text = F.concat(label_title(F.lit(a)), F.lit(" increasing while "), label_lower(F.lit(b)), F.lit(" decreasing"))
        item = F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), text.alias("relationship"))
        found.append(F.when((trend(a) == "increasing") & (trend(b) == "decreasing"), item))
    for a, b in profile.contradictions:
        text = F.concat(label_title(F.lit(a)), F.lit(" and "), label_lower(F.lit(b)), F.lit(" are increasing simultaneously."))
        clashes.append(F.when((trend(a) == "increasing") & (trend(b) == "increasing"), text))
    empty_pairs = F.array().cast("array<struct<a:string,b:string,relationship:string>>")
    empty_texts = F.array().cast("array<string>")
    return (
        df.withColumn("correlations", F.array_compact(F.array(*found)) if found else empty_pairs)
        .withColumn("contradictions", F.array_compact(F.array(*clashes)) if clashes else empty_texts)
        .withColumn("has_correlations", F.size("correlations") > 0)
        .withColumn("has_contradictions", F.size("contradictions") > 0)
    )


def expectation_status(profile: Profile) -> Column:
    if not profile.evaluates_expectations:
        return F.lit(None).cast("string")
    return (
        F.when(F.col("has_correlations"), "expected").when(F.col("has_contradictions"), "unexpected").otherwise("indeterminate")
    )


def _evidence(signal: str, value: Column, weight: Column | None = None, item_id: Column | None = None) -> Column:
    description, role, default = fixed.EVIDENCE[signal]
    return F.struct(
        (item_id if item_id is not None else F.lit(signal)).alias("id"),
        F.lit(description).alias("description"),
        F.lit(signal).alias("source_signal"),
        F.col("primary_type").alias("measurement_type"),
        value.alias("observed_value"),
        F.lit(role).alias("role"),
        (weight if weight is not None else F.lit(default)).alias("weight"),
    )


def evidence_items() -> Column:
    delta = F.format_string("Δ %.2f %s (latest - previous)", F.col("last_value") - F.col("prev_value"), F.col("last_unit"))
    fixed_part = F.array_compact(
        F.array(
            _evidence("latest_reading", F.trim(F.concat_ws(" ", number_text(F.col("last_value")), F.col("last_unit")))),
            _evidence("detected_trend", F.concat(F.lit("Direction: "), F.col("trend"))),
            _evidence("detected_variation", F.concat(F.lit("Variation: "), F.col("variation"))),
            F.when(F.col("n_primary") >= 2, _evidence("recent_delta", delta)),
            _evidence(
                "sample_support",
                F.concat(F.col("n_primary").cast("string"), F.lit(" supporting observations")),
                F.when(F.col("n_primary") >= 3, 0.2).otherwise(0.15),
            ),
        )
    )
    linked = F.transform(
        "correlations",
        lambda c: _evidence(
            "relationship_correlation",
            c["relationship"],
            item_id=F.concat_ws(":", F.lit("relationship_correlation"), c["a"], c["b"]),
        ),
    )
    clashing = F.transform(
        "contradictions",
        lambda c, i: _evidence(
            "relationship_contradiction", c, item_id=F.concat(F.lit("relationship_contradiction:"), i.cast("string"))
        ),
    )
    return F.concat(fixed_part, linked, clashing)


def _hypothesis(kind: str) -> Column:
    item_id, title, rationale = fixed.HYPOTHESES[kind]
    supporting = {
        "sensor_drift": F.filter(
            "evidence", lambda e: e["source_signal"].isin("relationship_contradiction", "detected_variation")
        ),
        "cooling_degradation": F.filter("evidence", lambda e: e["source_signal"] == "relationship_correlation"),
        "hydrogen_supply": F.filter("evidence", lambda e: e["source_signal"] == "relationship_correlation"),
    }.get(kind, F.slice("evidence", 1, 2))
    return F.struct(
        F.lit(item_id).alias("id"),
        F.lit(kind).alias("kind"),
        F.lit(title).alias("title"),
        F.replace(F.lit(rationale), F.lit("{m}"), F.col("primary_type")).alias("rationale"),
        F.transform(supporting, lambda e: e["id"]).alias("supporting_evidence_ids"),
    )


def hypothesis_items() -> Column:
    coupled = F.exists(
        "correlations",
        lambda c: F.array_sort(F.array(c["a"], c["b"])) == F.array(F.lit("fuel_flow"), F.lit("stack_temperature")),
    )
    cooling = (
        (F.col("primary_type") == "stack_temperature")
        & (F.col("trend") == "increasing")
        & (F.col("variation") == "low")
        & coupled
    )
    starved = F.coalesce(F.element_at("trends", F.lit("fuel_flow")) == "decreasing", F.lit(False))
    main = (
        F.when(cooling, _hypothesis("cooling_degradation"))
        .when(starved | F.col("has_unexpected"), _hypothesis("hydrogen_supply"))
        .when((F.col("variation") == "high") | F.col("has_contradictions"), _hypothesis("sensor_drift"))
        .otherwise(_hypothesis("load_change"))
    )
    unsettled = (F.col("trend") == "increasing") & (F.col("n_primary") < 4)
    return F.array_compact(F.array(main, F.when(unsettled, _hypothesis("unknown"))))


def assessment_text() -> Column:
    base = None
    for (trend, level), text in fixed.ASSESSMENTS.items():
        match = (F.col("trend") == trend) & (F.col("variation") == level)
        base = F.when(match, text) if base is None else base.when(match, text)
    note = (
        F.when(F.col("has_contradictions"), fixed.CONTRADICTION_NOTE)
        .when(F.col("has_correlations"), fixed.CORRELATION_NOTE)
        .otherwise("")
    )
    return F.concat(base, note)


def plan_of(assessment: Column, position: int) -> Column:
    """Priority (1), recommendation (2) or justification (3) by substring precedence."""
    text = F.lower(assessment)
    chain = None
    for row in fixed.PLANS:
        hit = text.contains(row[0])
        chain = F.when(hit, row[position]) if chain is None else chain.when(hit, row[position])
    return chain.otherwise(F.raise_error(F.lit("unrecognized operational assessment")))


def with_confidence(df: DataFrame) -> DataFrame:
    """Confidence parts, total and rationale."""
    high = F.col("variation") == "high"
    settled = ~high & ~F.col("has_contradictions")
    moving = F.col("trend") != "stable"
    out = df.withColumns(
        {
            "base": F.lit(35),
            "support": F.least(F.lit(25), F.least(F.col("n_primary"), F.lit(3)) * 8),
            "consistency": F.when(settled, 15).otherwise(5),
            "trend_consistency": F.when(moving, F.when(high, 4).otherwise(12)).otherwise(8),
            "sustained_bonus": F.when(F.col("monotonic_recent") & moving, 6).otherwise(0),
            "penalties": F.when(F.col("has_contradictions"), -12).otherwise(0) + F.when(F.col("has_unexpected"), -6).otherwise(0),
        }
    )
    total = sum((F.col(c) for c in ("support", "consistency", "trend_consistency", "sustained_bonus", "penalties")), F.col("base"))
    rationale = F.format_string(
        "Base %d. Support %d from %d observations. Consistency %d (%s). Trend %d (direction %s). %s %s %s Assessment: %s",
        "base",
        "support",
        "n_primary",
        "consistency",
        F.when(settled, "stable").otherwise("mixed"),
        "trend_consistency",
        "trend",
        F.when(F.col("sustained_bonus") > 0, "Sustained directional change observed.").otherwise(
            "No sustained directional change."
        ),
        F.when(F.col("has_contradictions"), "Penalty -12 for contradictions.").otherwise("No contradiction penalty."),
        F.when(F.col("has_unexpected"), "Penalty -6 for unexpected expectations.").otherwise(
            "No unexpected-expectation penalty."
        ),
        "assessment",
    )
    return out.withColumn("confidence", F.greatest(F.lit(0), F.least(F.lit(100), total))).withColumn("rationale", rationale)


def explanation_columns() -> dict[str, Column]:
    summary = F.format_string("Assessment: %s Confidence in assessment: %d/100.", "assessment", "confidence")
    notes = {
        "contradictions": F.col("has_contradictions"),
        "unexpected": F.col("has_unexpected"),
        "indeterminate": F.col("has_indeterminate"),
        "no_evidence": F.size("evidence") == 0,
        "no_hypotheses": F.size("hypotheses") == 0,
    }
    caveats = F.array_compact(F.array(*[F.when(cond, fixed.CAVEATS[name]) for name, cond in notes.items()]))
    return {"summary": summary, "caveats": caveats}


def asset_signals(
    obs: DataFrame, window: int = fixed.SESSION_WINDOW, keys: Sequence[str] = ("asset_id",)
) -> DataFrame:
    """One row per ``keys``: trend map over all measurement types and the primary series.

    The primary type is the type of the earliest bounded row. Each group holds at most
    ``window`` rows per measurement type, so the second aggregation stays small.
    """
    signals = trends.trend_signals(obs, window, keys)
    entry = F.struct(F.col("measurement_type").alias("type"), "trend", "variation", "readings", "values", "n")
    earliest = F.struct(F.element_at("readings", 1)["timestamp"].alias("t"), F.element_at("readings", 1)["id"].alias("i"))
    latest = F.max(F.element_at("readings", -1)["timestamp"])
    grouped = signals.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("measurement_type", "trend"))).alias("trends"),
        F.min_by(entry, earliest).alias("primary"),
        F.sum("n").cast("int").alias("observation_count"),
        latest.alias("as_of"),
    )
    primary = F.col("primary")
    values, n = primary["values"], primary["n"]
    return grouped.withColumns(
        {
            "primary_type": primary["type"],
            "trend": primary["trend"],
            "variation": primary["variation"],
            "n_primary": n,
            "primary_values": values,
            "last_value": F.element_at(values, -1),
            "prev_value": F.when(n >= 2, F.element_at(values, F.when(n >= 2, -2).otherwise(-1))),
            "last_unit": F.element_at(primary["readings"], -1)["unit"],
            "monotonic_recent": trends.monotonic_tail(
                F.concat(F.array(F.lit(None).cast("double"), F.lit(None).cast("double")), values), n
            ),
        }
    ).drop("primary")


def reason(
    obs: DataFrame,
    profile: Profile = Profile(),
    window: int = fixed.SESSION_WINDOW,
    keys: Sequence[str] = ("asset_id",),
) -> DataFrame:
    """Full decision chain for every asset that has at least two primary readings."""
    signals = asset_signals(obs, window, keys).filter((F.col("observation_count") >= 2) & (F.col("n_primary") >= 2))
    out = with_relationships(signals, profile).withColumn("expectation", expectation_status(profile))
    out = out.withColumn("has_unexpected", F.coalesce(F.col("expectation") == "unexpected", F.lit(False)))
    out = out.withColumn("has_indeterminate", F.coalesce(F.col("expectation") == "indeterminate", F.lit(False)))
    out = out.withColumn("evidence", evidence_items())
    out = out.withColumn("hypotheses", hypothesis_items())
    out = with_confidence(out.withColumn("assessment", assessment_text()))
    out = out.withColumns(explanation_columns())
    return out.withColumns(
        {
            "priority": plan_of(F.col("assessment"), 1),
            "recommendation": plan_of(F.col("assessment"), 2),
            "justification": plan_of(F.col("assessment"), 3),
        }
    )


def trace_rows(runs: DataFrame, run_key: str = "run_id") -> DataFrame:
    """The eighteen ordered steps of a run, one row per step."""
    steps = F.array(*[F.struct(F.lit(n).alias("step"), F.lit(d).alias("description")) for n, d in fixed.TRACE_STEPS])
    exploded = runs.select(run_key, F.posexplode(steps).alias("_pos", "_step"))
    return exploded.select(run_key, (F.col("_pos") + 1).alias("step_no"), F.col("_step.step"), F.col("_step.description"))
