"""Texts, thresholds and lookup tables that results depend on."""

from __future__ import annotations

# --- reasoning thresholds -------------------------------------------------
MIN_TREND_ROWS = 8
STABLE_EPSILON = 1e-9
TREND_RATIO = 0.8
HIGH_VARIATION = 60.0
SESSION_WINDOW = 20
MIN_CORROBORATION_ROWS = 4

# --- assessment sentences by (trend, variation) ---------------------------
ASSESSMENTS = {
    ("increasing", "low"): "Increasing operational stress detected",
    ("increasing", "high"): "Rapidly increasing unstable operational conditions detected",
    ("stable", "low"): "Operational conditions stable",
    ("stable", "high"): "Highly unstable operating conditions detected",
    ("decreasing", "low"): "Operational conditions improving",
    ("decreasing", "high"): "Operational conditions remain unstable despite improvement",
}
CONTRADICTION_NOTE = "\n\nCross-measurement inconsistencies detected."
CORRELATION_NOTE = "\n\nCross-measurement relationships detected."

# --- plan by the first word found in the assessment -----------------------
PLANS = (
    ("increasing", "high", "Investigate operational conditions", "Operational assessment indicates increasing stress."),
    ("unstable", "high", "Investigate operational conditions", "Operational assessment indicates unstable conditions."),
    ("stable", "low", "Continue monitoring", "Operational conditions remain stable."),
    ("improving", "low", "Maintain current operations", "Operational conditions are improving."),
)
PRIORITY_RANK = {"low": 0, "medium": 1, "high": 2, "critical": 3}
ATTENTION_SCORE = {"low": 1, "medium": 2, "high": 3, "critical": 4}

# --- evidence: id, description, role, weight ------------------------------
EVIDENCE = {
    "latest_reading": ("Latest recorded reading is considered in the decision.", "primary_support", 0.35),
    "detected_trend": ("Directional trend derived from the primary measurement sequence.", "primary_support", 0.25),
    "detected_variation": ("Variability of the primary measurement sequence.", "context", 0.15),
    "recent_delta": ("Change between the two most recent readings supports the assessment.", "primary_support", 0.3),
    "sample_support": ("Multiple observations reduce the chance of a one-off anomaly.", "corroborating", 0.2),
    "relationship_correlation": ("Cross-measurement correlation supports interpretation.", "corroborating", 0.2),
    "relationship_contradiction": ("Cross-measurement contradiction weakens certainty.", "contradicting", 0.2),
}

# --- hypotheses: kind -> (id, title, rationale); {m} is the primary measurement
HYPOTHESES = {
    "cooling_degradation": (
        "hypothesis-cooling-degradation",
        "Cooling degradation",
        "Stack temperature is rising steadily with coupled fuel-flow behavior, consistent with cooling degradation.",
    ),
    "hydrogen_supply": (
        "hypothesis-hydrogen-supply",
        "Hydrogen supply issue",
        "Fuel delivery or coupled subsystem signals suggest a hydrogen supply issue rather than isolated sensor noise.",
    ),
    "sensor_drift": (
        "hypothesis-sensor-drift",
        "Sensor drift",
        "High variability or contradictory signals can indicate measurement drift rather than a true change in {m}.",
    ),
    "load_change": (
        "hypothesis-load-change",
        "Load change",
        "A short-lived load change can create transient shifts without a persistent fault.",
    ),
    "unknown": (
        "hypothesis-unknown",
        "Unknown cause",
        "Limited observation history can reflect an unresolved operating mode transition rather than a confirmed"
        " degradation pattern.",
    ),
}

CAVEATS = {
    "contradictions": "Cross-measurement contradictions weaken certainty.",
    "unexpected": "Unexpected expectation signals were detected.",
    "indeterminate": "Some expectations remain indeterminate.",
    "no_evidence": "Limited supporting evidence is available.",
    "no_hypotheses": "No alternative hypotheses were generated.",
}

EXPECTATION_NAME = "Coupled subsystem response"
EXPECTATION_TEXT = {
    "expected": "The observed behavior matches this engineering expectation.",
    "unexpected": "The observed behavior diverges from this engineering expectation.",
    "indeterminate": "Insufficient evidence is available to evaluate this expectation.",
}

TRACE_STEPS = (
    ("Observations Loaded", "Incoming observations were received for reasoning."),
    ("Signal Extraction", "Signals were extracted from incoming observations."),
    ("Evidence Generation", "Structured evidence was generated from signals."),
    ("Hypothesis Generation", "Candidate hypotheses were generated from evidence."),
    ("Assessment", "Signals and hypotheses were assessed factually."),
    ("Confidence", "Confidence in the assessment was scored deterministically."),
    ("Explanation", "A structured explanation was generated from artifacts."),
    ("Planning", "The assessment was translated into a decision plan."),
    ("Trend Detected", "A directional trend was derived from the readings."),
    ("Variation Detected", "The variability of the observations was measured."),
    ("Relationship Analysis", "Cross-measurement correlations and contradictions were evaluated."),
    ("Operational Context Built", "The situational frame for reasoning was established."),
    ("Expectations Evaluated", "Declared expectations were compared against evidence."),
    ("Situation Assessed", "Signals and goal were combined into a situation."),
    ("Decision Context Created", "A decision context snapshotted the planner inputs."),
    ("Decision Planned", "A decision plan was produced from the context."),
    ("Action Recorded", "An action was recorded from the decision plan."),
    ("Outcome Recorded", "An outcome was recorded from the action."),
)

# --- recommendation tiers -------------------------------------------------
# tier -> urgency, category, title, impact, description, steps; {d} driver, {a} action, {h} health status
RECOMMENDATIONS = {
    "P0": (
        "IMMEDIATE",
        "mitigate",
        "Immediate mitigation required",
        "Reduce likelihood of imminent outage and limit operational impact.",
        "Operational state indicates critical risk requiring immediate action. "
        "Primary driver: {d}. Recommended action: {a}.",
        (
            "Acknowledge the incident and page the on-call owner.",
            "Validate the primary driver: {d}.",
            "Execute the operational action: {a}.",
            "Confirm recovery signals and document the outcome.",
        ),
    ),
    "P1": (
        "IMMEDIATE",
        "investigate",
        "Elevated risk identified",
        "Confirm whether elevated risk is an early warning sign before it progresses to a critical health reading.",
        "Operational state indicates elevated risk ahead of a confirmed critical health reading "
        "(current health status: {h}). Primary driver: {d}. Recommended action: {a}.",
        (
            "Investigate the primary driver: {d}.",
            "Apply the recommended action if corroborated: {a}.",
            "Increase monitoring frequency until risk returns to normal.",
        ),
    ),
    "P2": (
        "SOON",
        "investigate",
        "Investigation recommended",
        "Prevent degradation from escalating into a user-visible incident.",
        "Operational state indicates a warning condition or medium risk. "
        "Primary driver: {d}. Recommended action: {a}.",
        (
            "Investigate the primary driver: {d}.",
            "Review recent changes, deployments, and timeline events.",
            "Apply the recommended action if corroborated: {a}.",
            "Increase monitoring frequency until stable.",
        ),
    ),
    "P3": (
        "SCHEDULED",
        "monitor",
        "Continue monitoring",
        "Maintain steady-state operations while tracking early signals.",
        "Operational state indicates normal conditions with low risk. "
        "Primary driver: {d}. Recommended action (if conditions change): {a}.",
        (
            "Continue monitoring key health indicators.",
            "Track the primary driver: {d}.",
            "Validate alert thresholds and dashboards are up to date.",
        ),
    ),
}

LEGACY_ALTERNATIVES = {
    "drift": (
        "Sensor drift",
        "High variability or contradictory signals can indicate measurement drift rather than a true change in {m}.",
    ),
    "overload": (
        "Temporary overload",
        "A short-lived load change can create transient shifts without a persistent fault.",
    ),
    "mode": (
        "Operating mode transition",
        "Limited observation history can reflect a mode transition rather than degradation.",
    ),
}
EXPECTED_OUTCOMES = {
    "driving": "After investigation and corrective action, the driving signal should stabilize and return toward"
    " expected operating range.",
    "stable": "Maintain current operating conditions; expect continued stability with routine monitoring.",
    "improving": "Maintain current operations; expect the improving trend to continue if conditions remain unchanged.",
}

# --- known assets: id -> (name, type, location) ----------------------------
ASSET_CATALOG = {
    "fuel-cell-stack-01": ("PEM Fuel Cell Stack 01", "PEM Fuel Cell Stack", "North Production Line"),
    "fuel-cell-stack-02": ("PEM Fuel Cell Stack 02", "PEM Fuel Cell Stack", "North Production Line"),
    "fuel-cell-stack-03": ("PEM Fuel Cell Stack 03", "PEM Fuel Cell Stack", "South Production Line"),
    "fuel-cell-stack-04": ("PEM Fuel Cell Stack 04", "PEM Fuel Cell Stack", "South Production Line"),
}

# --- fuel-cell relationship rules ------------------------------------------
FUEL_CELL_CORRELATIONS = (
    ("stack_temperature", "stack_pressure"),
    ("current", "voltage"),
    ("fuel_flow", "stack_temperature"),
)
DEFAULT_RULES = (("temperature", "pressure"),)
