"""Fault classes, their measurements and texts, corroboration outcomes and recommendations."""

from __future__ import annotations

MEASUREMENTS = {
    "cooling_degradation": ("stack_temperature", "coolant_flow"),
    "hydrogen_supply_issue": ("fuel_flow", "voltage"),
    "sensor_anomaly": ("stack_temperature", "current", "voltage", "fuel_flow"),
}

# class -> situation, relevant measurements, impact, recommended steps, verification steps
CLASSES = {
    "cooling_degradation": (
        "cooling_system_degradation",
        ("stack_temperature", "coolant_flow", "current"),
        "Reduced cooling capacity risks accelerated stack degradation and an eventual forced load reduction or"
        " shutdown if unaddressed.",
        (
            "Inspect the coolant loop for restrictions, leaks, or pump issues.",
            "Verify the coolant-flow sensor against a manual or redundant reading.",
            "Schedule a maintenance inspection of the cooling subsystem.",
            "Reduce load only if deterministic operating thresholds support it.",
        ),
        (
            "Cross-check stack temperature against a secondary sensor if available.",
            "Confirm coolant-flow readings are physically plausible before acting.",
        ),
    ),
    "hydrogen_supply_issue": (
        "hydrogen_supply_degradation",
        ("fuel_flow", "voltage", "current", "power_output"),
        "Reduced hydrogen supply risks stack starvation, voltage instability, and lost power output if unaddressed.",
        (
            "Inspect the hydrogen supply path for restrictions or leaks.",
            "Check regulator/valve pressure against the expected setpoint.",
            "Verify fuel-flow instrumentation against a redundant reading.",
            "Reduce load or isolate the stack only if deterministic rules support it.",
        ),
        (
            "Confirm the fuel-flow drop is not attributable to a commanded load reduction before treating it as a"
            " supply issue.",
        ),
    ),
    "sensor_anomaly": (
        "sensor_reading_anomaly",
        ("stack_temperature", "current", "voltage", "fuel_flow"),
        "A faulty sensor risks masking a real fault or triggering false alarms; it is not itself an operational"
        " safety event.",
        (
            "Compare the suspect measurement against a redundant or manual reading before taking any other action.",
            "Inspect sensor wiring, connections, and calibration.",
        ),
        ("Do not intervene in the plant based solely on the suspect sensor's own reading.",),
    ),
}

# outcome -> result, rule ids (prefixed with the class), note; {t} is the leading trend
OUTCOMES = {
    "cooling_short": (
        "insufficient_evidence", ("insufficient_stack_temperature_history",),
        "Not enough stack_temperature history to corroborate or refute.",
    ),
    "cooling_flat": (
        "not_corroborated", ("stack_temperature_not_increasing",), "stack_temperature trend is {t}, not increasing.",
    ),
    "cooling_no_coolant": (
        "partially_corroborated", ("stack_temperature_increasing", "insufficient_coolant_flow_history"),
        "stack_temperature is increasing, but coolant_flow history is insufficient to assess whether cooling is compensating.",
    ),
    "cooling_compensated": (
        "not_corroborated", ("stack_temperature_increasing", "coolant_flow_increasing_contradicts"),
        "coolant_flow is increasing alongside stack_temperature, consistent with active compensation rather than degradation.",
    ),
    "cooling_stable": (
        "partially_corroborated", ("stack_temperature_increasing", "coolant_flow_stable"),
        "stack_temperature is increasing while coolant_flow is stable — consistent with, but not conclusive for,"
        " cooling degradation.",
    ),
    "cooling_confirmed": (
        "corroborated", ("stack_temperature_increasing", "coolant_flow_decreasing"),
        "stack_temperature is increasing while coolant_flow is decreasing — cooling capacity is not compensating for"
        " the rising temperature.",
    ),
    "hydrogen_short": (
        "insufficient_evidence", ("insufficient_fuel_flow_history",), "Not enough fuel_flow history to corroborate or refute.",
    ),
    "hydrogen_flat": ("not_corroborated", ("fuel_flow_not_decreasing",), "fuel_flow trend is {t}, not decreasing."),
    "hydrogen_no_voltage": (
        "partially_corroborated", ("fuel_flow_decreasing", "insufficient_voltage_history"),
        "fuel_flow is decreasing, but voltage history is insufficient to assess whether the response is consistent with"
        " starvation.",
    ),
    "hydrogen_voltage_holds": (
        "partially_corroborated", ("fuel_flow_decreasing", "voltage_not_decreasing"),
        "fuel_flow is decreasing but voltage is not — consistent with a commanded load reduction rather than a supply"
        " issue alone.",
    ),
    "hydrogen_confirmed": (
        "corroborated", ("fuel_flow_decreasing", "voltage_decreasing"),
        "fuel_flow and voltage are both decreasing, consistent with hydrogen starvation rather than a load change alone.",
    ),
    "sensor_short": (
        "insufficient_evidence", ("insufficient_stack_temperature_history",),
        "Not enough stack_temperature history to corroborate or refute.",
    ),
    "sensor_flat": (
        "not_corroborated", ("stack_temperature_stable",),
        "stack_temperature shows no shift, so there is nothing for a sensor anomaly to explain.",
    ),
    "sensor_alone": (
        "partially_corroborated", ("stack_temperature_shifted",),
        "stack_temperature shows a shift, but there is not enough history on the related signals to confirm physical"
        " inconsistency.",
    ),
    "sensor_confirmed": (
        "corroborated", ("stack_temperature_shifted", "related_signals_stable"),
        "stack_temperature shifted while current, voltage, and fuel_flow all remained stable — physically inconsistent"
        " with a real thermal event.",
    ),
    "sensor_real": (
        "not_corroborated", ("stack_temperature_shifted", "related_signals_also_shifted"),
        "stack_temperature shifted alongside every related signal — physically consistent with a real event, not a"
        " sensor anomaly.",
    ),
    "sensor_mixed": (
        "partially_corroborated", ("stack_temperature_shifted", "related_signals_partially_shifted"),
        "stack_temperature shifted while only some related signals moved — ambiguous between a sensor anomaly and a"
        " real event.",
    ),
    "cleared": (
        "not_applicable", (), "Alert cleared; clearing does not diagnose a fault, so no corroboration is run.",
    ),
}

# result -> status, category, urgency, summary ({c} is the class), limitations
RECOMMENDATIONS = {
    "corroborated": (
        "produced", "investigate", "ELEVATED", "Deterministic evidence corroborates the AI-diagnosed {c}.",
        "Model scores are diagnostic ranking scores, not calibrated probabilities; this recommendation is based on the"
        " alert policy's own confirmed diagnosis plus deterministic corroboration, not a model-score threshold.",
    ),
    "partially_corroborated": (
        "produced", "investigate", "INSPECTION_REQUIRED",
        "Deterministic evidence partially supports the AI-diagnosed {c}; verification is recommended before any"
        " operational action.",
        "Evidence is ambiguous — this recommends verification, not a confirmed-fault response.",
    ),
    "not_corroborated": (
        "withheld", "monitor", "INFORMATIONAL",
        "Deterministic evidence does not corroborate the AI-diagnosed {c}; no fault-action recommendation is made.",
        "The AI alert and deterministic evidence disagree; this disagreement is recorded, not discarded, but does not"
        " by itself justify a fault-action recommendation.",
    ),
    "insufficient_evidence": (
        "withheld", "monitor", "INFORMATIONAL",
        "Insufficient observable telemetry to corroborate or refute the AI-diagnosed {c}; more data is needed.",
        "This is not a healthy-operation determination — evidence is simply insufficient to corroborate or refute the"
        " alert.",
    ),
}
WITHHELD_STEPS = {
    "not_corroborated": (
        "Continue monitoring; no deterministic evidence currently supports operator action for this alert.",
    ),
    "insufficient_evidence": (
        "Gather additional telemetry or perform a manual inspection before drawing a conclusion.",
    ),
}

INVESTIGATION_STATUSES = ("ACKNOWLEDGED", "INVESTIGATING", "RESOLVED")
TRANSITIONS = {"new_alert": "confirmed", "class_change": "class_changed", "cleared": "cleared"}
RULE_VERSION = "1.0"
