"""Alert transitions: validation, investigations, corroboration against telemetry, fault recommendations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.functions import fault_rules as rules
from sensorloom.functions import fixed
from sensorloom.functions.scalar import name_uuid
from sensorloom.operators import joins, series, trends

WINDOW_SECONDS = 900.0
SAMPLE_LIMIT = 20
# Namespace of the result event ids (any fixed UUID works; ids only need to be stable).
RESULT_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def fault_class_of(transition: Column, from_state: Column, to_state: Column) -> Column:
    """Class named by the confirmed state: the left one when cleared, else the entered one."""
    state = F.when(transition == "cleared", from_state).otherwise(to_state)
    return F.nullif(F.regexp_extract(state, "^confirmed_(.+)$", 1), F.lit(""))


def transition_problem() -> Column:
    """Reason why an alert transition is rejected, or null."""
    fault = fault_class_of(F.col("transition_type"), F.col("from_state"), F.col("to_state"))
    known = F.col("transition_type").isin("confirmed", "class_changed", "cleared")
    return (
        F.when(F.col("event_id").isNull() | F.col("asset_id").isNull() | (F.col("asset_id") == ""), "missing_field")
        .when(~F.coalesce(known, F.lit(False)), "unsupported_transition")
        .when(F.col("observed_at").isNull(), "malformed_timestamp")
        .when(fault.isNull(), "malformed_state")
        .when(fault == "healthy", "healthy_class_rejected")
        .when(~F.col("maximum_score").between(0.0, 1.0), "malformed_scores")
        .when(~fault.isin(*rules.CLASSES), "unsupported_fault_class")
    )


def validate_transitions(raw: DataFrame) -> DataFrame:
    """Add ``fault_class`` and ``reject_reason``; works on batches and streams."""
    fault = fault_class_of(F.col("transition_type"), F.col("from_state"), F.col("to_state"))
    return raw.withColumn("fault_class", fault).withColumn("reject_reason", transition_problem())


def investigations(alerts: DataFrame) -> DataFrame:
    """Assign every transition to an investigation of its asset.

    A transition continues the investigation of the previous one unless that one was
    cleared; otherwise it starts its own, named by a hash of the asset and the first event.
    """
    keys = ["asset_id"]
    numbered = series.with_position(alerts, keys, ["observed_at", "event_id"], F.to_date("observed_at"), name="_pos")
    linked = series.lagged(
        numbered,
        keys,
        {"_prev": lambda w: F.lag("transition_type").over(w), "_prev_class": lambda w: F.lag("fault_class").over(w)},
        pos="_pos",
    )
    opens = (F.col("_prev").isNull() | (F.col("_prev") == "cleared")).cast("long")
    counted = series.running_total(linked.withColumn("_opens", opens), keys, F.col("_opens"), "_no", pos="_pos")
    heads = counted.groupBy("asset_id", "_no").agg(F.min_by("event_id", "_pos").alias("_head"))
    joined = counted.join(heads, ["asset_id", "_no"])
    cleared = F.col("transition_type") == "cleared"
    continuing = F.col("_opens") == 0
    previous = F.when(continuing & (cleared | (F.col("_prev_class") != F.col("fault_class"))), F.col("_prev_class"))
    return joined.withColumns(
        {
            "investigation_id": F.concat(F.lit("inv-"), F.substring(F.sha2(F.concat_ws("|", "asset_id", "_head"), 256), 1, 16)),
            "investigation_status": F.when(cleared, "CLEARED").otherwise("OPEN"),
            "previous_fault_class": previous,
            "is_new_investigation": F.col("_opens") == 1,
        }
    ).drop("_pos", "_prev", "_prev_class", "_opens", "_no", "_head")


def alert_context(
    alerts: DataFrame, obs: DataFrame, seconds: float = WINDOW_SECONDS, limit: int = SAMPLE_LIMIT
) -> DataFrame:
    """Oldest ``limit`` readings per alert and relevant measurement within the window before it."""
    wanted = F.coalesce(*[F.when(F.col("fault_class") == c, F.array(*[F.lit(m) for m in ms])) for c, ms in rules.MEASUREMENTS.items()])
    anchors = (
        alerts.filter(F.col("transition_type") != "cleared")
        .select("event_id", "asset_id", "fault_class", "observed_at", F.explode(wanted).alias("measurement_type"))
    )
    return joins.first_rows_in_window(
        anchors, obs, ["asset_id", "measurement_type"], "observed_at", "timestamp", ["id"], seconds, limit,
        ["id", "timestamp", "value"],
    )


def context_trends(context: DataFrame) -> DataFrame:
    """Trend per alert and measurement (null below four readings) plus the reading ids."""
    reading = F.struct(F.col("row_timestamp").alias("timestamp"), F.col("row_id").alias("id"), F.col("row_value").alias("value"))
    grouped = context.groupBy("event_id", "measurement_type").agg(F.array_sort(F.collect_list(reading)).alias("_r"))
    values = F.transform("_r", lambda r: r["value"])
    n = F.size("_r")
    trend = F.when(n >= fixed.MIN_CORROBORATION_ROWS, trends.direction_of(values, n))
    return grouped.select("event_id", "measurement_type", trend.alias("trend"), F.transform("_r", lambda r: r["id"]).alias("ids"))


def _outcome_code() -> Column:
    t = lambda m: F.element_at("_trends", F.lit(m))
    temperature, coolant, fuel, voltage, current = (
        t(m) for m in ("stack_temperature", "coolant_flow", "fuel_flow", "voltage", "current")
    )
    cooling = (
        F.when(temperature.isNull(), "cooling_short")
        .when(temperature != "increasing", "cooling_flat")
        .when(coolant.isNull(), "cooling_no_coolant")
        .when(coolant == "increasing", "cooling_compensated")
        .when(coolant == "stable", "cooling_stable")
        .otherwise("cooling_confirmed")
    )
    hydrogen = (
        F.when(fuel.isNull(), "hydrogen_short")
        .when(fuel != "decreasing", "hydrogen_flat")
        .when(voltage.isNull(), "hydrogen_no_voltage")
        .when(voltage != "decreasing", "hydrogen_voltage_holds")
        .otherwise("hydrogen_confirmed")
    )
    related = F.array_compact(F.array(current, voltage, fuel))
    moved = F.size(F.filter(related, lambda x: x != "stable"))
    sensor = (
        F.when(temperature.isNull(), "sensor_short")
        .when(temperature == "stable", "sensor_flat")
        .when(F.size(related) == 0, "sensor_alone")
        .when(moved == 0, "sensor_confirmed")
        .when(moved == F.size(related), "sensor_real")
        .otherwise("sensor_mixed")
    )
    return (
        F.when(F.col("transition_type") == "cleared", "cleared")
        .when(F.col("fault_class") == "cooling_degradation", cooling)
        .when(F.col("fault_class") == "hydrogen_supply_issue", hydrogen)
        .otherwise(sensor)
    )


def _pick(mapping: dict, key: Column, make) -> Column:
    return F.coalesce(*[F.when(key == k, make(v)) for k, v in mapping.items()])


def corroborate(alerts: DataFrame, obs: DataFrame, seconds: float = WINDOW_SECONDS, limit: int = SAMPLE_LIMIT) -> DataFrame:
    """Result, rule ids, note and supporting reading ids for every alert."""
    per_type = context_trends(alert_context(alerts, obs, seconds, limit))
    grouped = per_type.groupBy("event_id").agg(
        F.map_from_entries(F.collect_list(F.struct("measurement_type", "trend"))).alias("_trends"),
        F.map_from_entries(F.collect_list(F.struct("measurement_type", "ids"))).alias("_ids"),
    )
    joined = alerts.join(grouped, "event_id", "left")
    empty = F.create_map().cast("map<string,string>")
    joined = joined.withColumn("_trends", F.coalesce("_trends", empty)).withColumn("outcome", _outcome_code())
    lead = F.when(F.col("fault_class") == "hydrogen_supply_issue", F.element_at("_trends", F.lit("fuel_flow"))).otherwise(
        F.element_at("_trends", F.lit("stack_temperature"))
    )
    code = F.col("outcome")
    rule_ids = F.transform(
        _pick(rules.OUTCOMES, code, lambda v: F.array(*[F.lit(r) for r in v[1]]).cast("array<string>")),
        lambda r: F.concat_ws(".", "fault_class", r),
    )
    none = F.array().cast("array<string>")
    ordered = _pick(
        rules.MEASUREMENTS,
        F.when(F.col("transition_type") != "cleared", F.col("fault_class")),
        lambda ms: F.flatten(F.array(*[F.coalesce(F.element_at("_ids", F.lit(m)), none) for m in ms])),
    )
    return joined.withColumns(
        {
            "corroboration_result": _pick(rules.OUTCOMES, code, lambda v: F.lit(v[0])),
            "corroboration_rule_ids": rule_ids,
            "corroboration_notes": F.replace(_pick(rules.OUTCOMES, code, lambda v: F.lit(v[2])), F.lit("{t}"), F.coalesce(lead, F.lit(""))),
            "supporting_observation_ids": F.coalesce(F.array_distinct(ordered), none),
        }
    ).drop("_trends", "_ids")


def fault_class_table(spark) -> DataFrame:
    rows = [(c, s, list(m), i, list(r), list(v)) for c, (s, m, i, r, v) in rules.CLASSES.items()]
    schema = (
        "fault_class string, situation_type string, relevant_measurements array<string>, operator_impact string, "
        "recommended_steps array<string>, verification_steps array<string>"
    )
    return spark.createDataFrame(rows, schema)


def fault_recommendation(corroborated: DataFrame) -> DataFrame:
    """Add the fault recommendation columns; all null for cleared alerts."""
    result = F.col("corroboration_result")
    pick = lambda i: _pick(rules.RECOMMENDATIONS, result, lambda v: F.lit(v[i]))
    texts = lambda values: F.array(*[F.lit(x) for x in values])
    full = _pick(rules.CLASSES, F.col("fault_class"), lambda v: texts(v[3]))
    verify = _pick(rules.CLASSES, F.col("fault_class"), lambda v: texts(v[4]))
    steps = (
        F.when(result == "corroborated", full)
        .when(result == "partially_corroborated", verify)
        .otherwise(_pick(rules.WITHHELD_STEPS, result, texts))
    )
    return corroborated.withColumns(
        {
            "recommendation_status": pick(0),
            "recommendation_category": pick(1),
            "urgency": pick(2),
            "action_summary": F.replace(pick(3), F.lit("{c}"), F.col("fault_class")),
            "recommended_steps": steps,
            "limitations": pick(4),
        }
    )


def fault_evidence(
    alerts: DataFrame, obs: DataFrame, existing: DataFrame | None = None,
    seconds: float = WINDOW_SECONDS, limit: int = SAMPLE_LIMIT,
) -> DataFrame:
    """One record per new alert transition: investigation, corroboration and recommendation.

    ``existing`` evidence (same columns as the result) makes replays harmless: known event
    ids are dropped, and open investigations continue from their latest record.
    """
    fresh = alerts.dropDuplicates(["event_id"])
    if existing is not None:
        fresh = fresh.join(existing.select("event_id"), "event_id", "left_anti")
        touched = existing.join(fresh.select("asset_id").distinct(), "asset_id", "left_semi")
        columns = ["event_id", "asset_id", "observed_at", "transition_type", "fault_class"]
        history = touched.select(*columns).withColumn("_known", F.lit(True))
        both = fresh.withColumn("_known", F.lit(False)).unionByName(history, allowMissingColumns=True)
        fresh = investigations(both).filter(~F.col("_known")).drop("_known")
    else:
        fresh = investigations(fresh)
    return recommended(fresh, obs, seconds, limit)


def recommended(investigated: DataFrame, obs: DataFrame, seconds: float = WINDOW_SECONDS, limit: int = SAMPLE_LIMIT) -> DataFrame:
    """Investigated transitions with their corroboration and recommendation."""
    out = fault_recommendation(corroborate(investigated, obs, seconds, limit))
    return out.withColumn(
        "recommendation_id",
        F.when(
            F.col("recommendation_status").isNotNull(),
            F.concat_ws("-", F.lit("ai-fault-rec"), "investigation_id", "event_id"),
        ),
    )


def result_events(evidence: DataFrame) -> DataFrame:
    """Outgoing result events with ids that depend only on the alert and its investigation."""
    identity = F.concat_ws("|", F.lit("fault_reasoning_result.v1"), "event_id", "investigation_id")
    return evidence.select(
        name_uuid(RESULT_NAMESPACE, identity).alias("result_event_id"),
        F.lit("v1").alias("event_version"),
        F.col("event_id").alias("source_alert_event_id"),
        "asset_id",
        F.col("fault_class").alias("diagnosed_class"),
        "corroboration_result",
        "investigation_id",
        "recommendation_status",
        "action_summary",
        "urgency",
        F.lit(rules.RULE_VERSION).alias("reasoning_rule_version"),
    )


def active_investigations(evidence: DataFrame) -> DataFrame:
    """Latest record per asset unless it is cleared."""
    columns = [c for c in evidence.columns if c != "asset_id"]
    newest = evidence.groupBy("asset_id").agg(F.max_by(F.struct(*columns), F.struct("observed_at", "event_id")).alias("_e"))
    return newest.select("asset_id", "_e.*").filter(F.col("investigation_status") != "CLEARED")


def grade_status_changes(changes: DataFrame, key: str, order: Sequence[str], statuses: Sequence[str] = rules.INVESTIGATION_STATUSES) -> DataFrame:
    """Accept a status only when it ranks above everything before it; others are rejected.

    A change is accepted exactly when it is the first row of its rank or higher, so the
    first row per (key, rank) decides and no ordered scan of a key is needed.
    """
    rank = F.coalesce(*[F.when(F.col("status") == s, i) for i, s in enumerate(statuses)])
    ranked = changes.withColumn("_rank", rank).withColumn("_at", F.struct(*order))
    firsts = ranked.groupBy(key).agg(
        *[F.min(F.when(F.col("_rank") >= i, F.col("_at"))).alias(f"_first_{i}") for i in range(len(statuses))]
    )
    first = F.coalesce(*[F.when(F.col("_rank") == i, F.col(f"_first_{i}")) for i in range(len(statuses))])
    graded = ranked.join(firsts, key).withColumn("accepted", F.col("_at") == first)
    return graded.drop("_rank", "_at", *[f"_first_{i}" for i in range(len(statuses))])


def current_status(graded: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    accepted = graded.filter("accepted")
    return accepted.groupBy(key).agg(F.max_by("status", F.struct(*order)).alias("status"), F.count(F.lit(1)).alias("transitions"))
