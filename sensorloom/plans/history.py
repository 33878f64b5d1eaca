"""Run history: registry order, change detection, recurrence, timeline and read views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.functions import fixed
from sensorloom.operators import series, trends
from sensorloom.plans.reasoning import Profile, lookup, reason
from sensorloom.plans.state import full_state

EVENT_RANK = {
    # order of timeline events that share a timestamp (fixed values)
    "observation_received": 0,
    "reasoning_started": 1,
    "trend_changed": 2,
    "recommendation_updated": 3,
    "notification_created": 4,
    "health_changed": 5,
    "risk_changed": 6,
    "reasoning_completed": 7,
}


def monitor(obs: DataFrame, profile: Profile, batch: str = "batch", window: int = fixed.SESSION_WINDOW) -> DataFrame:
    """One decision run per (batch, asset), with its state, recommendation and notification."""
    runs = full_state(reason(obs, profile, window, (batch, "asset_id")))
    run_id = F.concat(F.lit("run-"), F.col(batch).cast("string"), F.lit("-"), F.col("asset_id"))
    return runs.withColumn("run_id", run_id).withColumn("started_at", F.col("as_of"))


def registered(runs: DataFrame, partition_by: Sequence[str] | None = None) -> DataFrame:
    """Registry position ``seq``: over all runs by default, or within ``partition_by``."""
    keys = list(partition_by or ["_registry"])
    base = runs if partition_by else runs.withColumn("_registry", F.lit(0))
    return series.with_position(base, keys, ["started_at", "run_id"], F.to_date("started_at"), name="seq")


def registry_keys(partition_by: Sequence[str] | None) -> list[str]:
    return list(partition_by or ["_registry"])


def with_previous_run(runs: DataFrame, columns: Sequence[str], partition_by: Sequence[str] | None = None) -> DataFrame:
    """Add ``prev_<column>`` taken from the run before this one in registry order."""
    make = {f"prev_{c}": (lambda w, c=c: F.lag(c).over(w)) for c in columns}
    return series.lagged(registered(runs, partition_by), registry_keys(partition_by), make, pos="seq")


def run_changes(runs: DataFrame, partition_by: Sequence[str] | None = None) -> DataFrame:
    """Previous run, comparison flags, escalation and stability flags per run."""
    columns = ["run_id", "observation_count", "assessment", "priority", "recommendation"]
    out = with_previous_run(runs, columns, partition_by)
    known = F.col("prev_run_id").isNotNull()
    rank, before = lookup(fixed.PRIORITY_RANK, F.col("priority")), lookup(fixed.PRIORITY_RANK, F.col("prev_priority"))
    unstable, was = F.col("assessment").contains("unstable"), F.col("prev_assessment").contains("unstable")
    flag = lambda c: F.coalesce(known & c, F.lit(False))
    return out.withColumns(
        {
            "observation_count_changed": flag(F.col("observation_count") != F.col("prev_observation_count")),
            "assessment_changed": flag(F.col("assessment") != F.col("prev_assessment")),
            "priority_changed": flag(F.col("priority") != F.col("prev_priority")),
            "recommendation_changed": flag(F.col("recommendation") != F.col("prev_recommendation")),
            "priority_escalated": flag(rank > before),
            "priority_deescalated": flag(rank < before),
            "priority_unchanged": flag(rank == before),
            "became_more_stable": flag(was & ~unstable),
            "became_less_stable": flag(~was & unstable),
            "stability_unchanged": flag(was == unstable),
        }
    )


def with_recurrence(positioned: DataFrame, partition_by: Sequence[str] | None = None) -> DataFrame:
    """Number of earlier runs with the same assessment and priority."""
    keys = [*registry_keys(partition_by), "assessment", "priority"]
    counted = series.running_total(positioned, keys, F.lit(1).cast("long"), "_same", pos="seq")
    return (
        counted.withColumn("recurrence_count", F.col("_same") - 1)
        .withColumn("is_recurring", F.col("recurrence_count") > 0)
        .drop("_same")
    )


def operational_summary(runs: DataFrame, partition_by: Sequence[str] | None = None) -> DataFrame:
    return with_recurrence(run_changes(runs, partition_by), partition_by)


def attention_queue(summary: DataFrame) -> DataFrame:
    """Score = priority 1..4, +1 recurring, +1 escalated; highest first, newest first among equals."""
    score = (
        lookup(fixed.ATTENTION_SCORE, F.col("priority"))
        + F.col("is_recurring").cast("int")
        + F.col("priority_escalated").cast("int")
    )
    return summary.withColumn("attention_score", score).orderBy(F.desc("attention_score"), F.desc("seq"))


def priority_timeline_trend(runs: DataFrame, keys: Sequence[str] = ("asset_id",)) -> DataFrame:
    """Worsening, improving or stable between the first and the last run per key."""
    order = F.struct("started_at", "run_id")
    ranked = runs.withColumn("_rank", lookup(fixed.PRIORITY_RANK, F.col("priority")))
    ends = ranked.groupBy(*keys).agg(
        F.min_by("_rank", order).alias("_first"), F.max_by("_rank", order).alias("_last"), F.count(F.lit(1)).alias("runs")
    )
    trend = (
        F.when(F.col("runs") < 2, "stable")
        .when(F.col("_last") > F.col("_first"), "worsening")
        .when(F.col("_last") < F.col("_first"), "improving")
        .otherwise("stable")
    )
    return ends.select(*keys, "runs", trend.alias("priority_trend"))


def change_events(runs: DataFrame) -> DataFrame:
    """Trend, recommendation, health, risk and notification changes against the asset's previous run."""
    tail = lambda values, size: F.slice(values, F.greatest(F.lit(1), F.size(values) - size + 1), size)
    n = F.col("n_primary")
    earlier = F.slice("primary_values", F.lit(1), F.greatest(n - 1, F.lit(1)))
    out = runs.withColumn("_now", tail(F.col("primary_values"), 8)).withColumn("_before", tail(earlier, 8))
    out = trends.with_diagnostics(trends.with_diagnostics(out, "_now", "n_"), "_before", "b_")
    columns = ["run_id", "recommendation", "health_status", "risk_level", "notification_id"]
    out = with_previous_run(out, columns, ["asset_id"])
    turned = (
        (n >= 9)
        & (F.col("b_direction") != F.col("n_direction"))
        & (F.col("n_stability_score") >= 70)
        & (F.col("n_direction") != "stable")
    )
    seen = F.col("prev_run_id").isNotNull()
    changed = lambda c: seen & (F.col(f"prev_{c}") != F.col(c))
    event = lambda kind, change, before, after: F.struct(
        F.lit(kind).alias("event_type"), F.lit(change).alias("change_type"), before.alias("previous"), after.alias("new")
    )
    raised = F.col("notification_id").isNotNull() & ~F.col("notification_id").eqNullSafe(F.col("prev_notification_id"))
    events = F.array_compact(
        F.array(
            F.when(turned, event("TrendChanged", "trend_direction", F.col("b_direction"), F.col("n_direction"))),
            F.when(
                changed("recommendation"),
                event("RecommendationUpdated", "recommendation", F.col("prev_recommendation"), F.col("recommendation")),
            ),
            F.when(
                changed("health_status"),
                event("HealthChanged", "health_status", F.col("prev_health_status"), F.col("health_status")),
            ),
            F.when(changed("risk_level"), event("RiskChanged", "risk_level", F.col("prev_risk_level"), F.col("risk_level"))),
            F.when(
                raised, event("NotificationCreated", "notification", F.col("prev_notification_id"), F.col("notification_id"))
            ),
        )
    )
    keep = ["asset_id", "run_id", F.col("started_at").alias("occurred_at"), "health_score", "recommendation_id",
            F.col("notification_severity").alias("severity"), "title", F.col("description").alias("message"),
            F.col("n_stability_score").alias("stability_score"), F.col("n_volatility_score").alias("volatility_score")]
    return out.select(*keep, F.explode(events).alias("_e")).select("*", "_e.*").drop("_e")


def reasoning_events(runs: DataFrame) -> DataFrame:
    """ReasoningStarted and ReasoningCompleted per run."""
    kinds = F.array(F.lit("ReasoningStarted"), F.lit("ReasoningCompleted"))
    return runs.select("asset_id", "run_id", F.col("started_at").alias("occurred_at"), F.explode(kinds).alias("event_type"))


def integration_events(domain_events: DataFrame) -> DataFrame:
    """Curated subset of domain events that crosses the system boundary, with a JSON payload."""
    kind = F.col("event_type")
    mapped = (
        F.when(kind == "ReasoningCompleted", "DigitalTwinUpdated")
        .when(kind.isin("HealthChanged", "RiskChanged", "TrendChanged", "RecommendationUpdated"), "OperationalStateChanged")
        .when(kind == "NotificationCreated", "NotificationRaised")
        .when(kind == "InvestigationTransitionRecorded", "InvestigationTransitionRecorded")
    )
    change = F.when(mapped == "OperationalStateChanged", F.col("change_type"))
    payload_columns = [c for c in domain_events.columns if c not in ("event_type", "change_type", "occurred_at")]
    payload = F.to_json(F.struct(*payload_columns, change.alias("change_type"), F.col("occurred_at").alias("timestamp")), JSON_TIME)
    return domain_events.select(
        F.sha2(F.concat_ws("|", "asset_id", "run_id", kind), 256).alias("event_id"),
        mapped.alias("type"),
        change.alias("change_type"),
        "occurred_at",
        "asset_id",
        "run_id",
        payload.alias("payload"),
    ).filter(F.col("type").isNotNull())


def timeline(obs: DataFrame, runs: DataFrame, changes: DataFrame) -> DataFrame:
    """All asset events as one table with a JSON metadata column."""
    quoted = lambda c: F.concat(F.lit("'"), c, F.lit("'"))
    received = obs.select(
        F.concat(F.lit("observation_received:"), F.col("id")).alias("event_id"),
        "asset_id",
        "timestamp",
        F.lit("observation_received").alias("event_type"),
        F.lit("Observation received").alias("title"),
        F.format_string("New observation %s recorded for the asset.", "id").alias("description"),
        F.to_json(F.struct(F.col("id").alias("observation_id"))).alias("metadata"),
    )
    stage = lambda kind, title, verb: runs.select(
        F.concat(F.lit(f"{kind}:"), F.col("run_id")).alias("event_id"),
        "asset_id",
        F.col("started_at").alias("timestamp"),
        F.lit(kind).alias("event_type"),
        F.lit(title).alias("title"),
        F.format_string(f"Reasoning run %s {verb} for the asset.", "run_id").alias("description"),
        F.to_json(F.struct("run_id")).alias("metadata"),
    )
    names = {
        "TrendChanged": ("trend_changed", "Trend changed", "Trend changed"),
        "RecommendationUpdated": ("recommendation_updated", "Recommendation updated", "Recommendation changed"),
        "HealthChanged": ("health_changed", "Health status changed", "Health status changed"),
        "RiskChanged": ("risk_changed", "Risk level changed", "Risk level changed"),
        "NotificationCreated": ("notification_created", "Notification created", ""),
    }
    pick = lambda i: lookup({k: v[i] for k, v in names.items()}, F.col("event_type"))
    moved = F.concat(pick(2), F.lit(" from "), quoted(F.coalesce("previous", F.lit("none"))), F.lit(" to "), quoted(F.col("new")), F.lit("."))
    notice = F.format_string("%s: %s. Linked recommendation %s.", "severity", F.col("changes_title"), "recommendation_id")
    is_notice = F.col("event_type") == "NotificationCreated"
    metadata = F.when(
        is_notice,
        F.to_json(
            F.struct(
                "run_id",
                F.col("new").alias("notification_id"),
                "recommendation_id",
                "severity",
                F.lit("OPEN").alias("status"),
                F.col("changes_title").alias("title"),
                "message",
                F.col("occurred_at").alias("created_at"),
            ),
            JSON_TIME,
        ),
    ).otherwise(F.to_json(F.struct("run_id", "previous", "new")))
    altered = changes.withColumnRenamed("title", "changes_title").select(
        F.concat(pick(0), F.lit(":"), F.col("run_id")).alias("event_id"),
        "asset_id",
        F.col("occurred_at").alias("timestamp"),
        pick(0).alias("event_type"),
        pick(1).alias("title"),
        F.when(is_notice, notice).otherwise(moved).alias("description"),
        metadata.alias("metadata"),
    )
    return (
        received.unionByName(stage("reasoning_started", "Reasoning started", "began"))
        .unionByName(altered)
        .unionByName(stage("reasoning_completed", "Reasoning completed", "finished"))
    )


def event_rank(event_type: Column) -> Column:
    return F.coalesce(lookup(EVENT_RANK, event_type), F.lit(99))


def timeline_preview(events: DataFrame, limit: int = 5) -> DataFrame:
    """Newest ``limit`` events per asset; ``position`` 1 is the oldest shown."""
    newest = Window.partitionBy("asset_id").orderBy(F.desc("timestamp"), F.desc(event_rank(F.col("event_type"))), F.desc("event_id"))
    kept = events.withColumn("_age", F.row_number().over(newest)).filter(F.col("_age") <= limit)
    shown = Window.partitionBy("asset_id").orderBy(F.desc("_age"))
    return kept.withColumn("position", F.row_number().over(shown)).drop("_age")


JSON_TIME = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
NOTIFICATION_JSON = (
    "notification_id string, recommendation_id string, severity string, status string, title string, message string, "
    "created_at timestamp"
)


def latest_notification(events: DataFrame) -> DataFrame:
    """Last ``notification_created`` timeline row per asset, read back from its metadata."""
    rows = events.filter(F.col("event_type") == "notification_created")
    newest = rows.groupBy("asset_id").agg(F.max_by("metadata", F.struct("timestamp", "event_id")).alias("_m"))
    return newest.select("asset_id", F.from_json("_m", NOTIFICATION_JSON, JSON_TIME).alias("_n")).select("asset_id", "_n.*")


def latest_runs(runs: DataFrame, k: int = 1) -> DataFrame:
    newest = Window.partitionBy("asset_id").orderBy(F.desc("started_at"), F.desc("run_id"))
    return runs.withColumn("_age", F.row_number().over(newest)).filter(F.col("_age") <= k)


def run_index(obs: DataFrame, batch: str = "batch", window: int = fixed.SESSION_WINDOW) -> DataFrame:
    """Observation ids used by each run (bounded by ``window`` per measurement type)."""
    bounded = trends.bound_recent(obs, window, (batch, "asset_id"))
    run_id = F.concat(F.lit("run-"), F.col(batch).cast("string"), F.lit("-"), F.col("asset_id"))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("timestamp", "id"))), lambda r: r["id"])
    return bounded.groupBy(run_id.alias("run_id"), "asset_id").agg(ids.alias("observation_ids"))


def resolve_observations(index: DataFrame, obs: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows behind each run's observation ids in (timestamp, id) order; unknown ids drop out."""
    ids = F.col("observation_ids") if limit is None else F.slice("observation_ids", 1, limit)
    wanted = index.select("run_id", F.explode(ids).alias("id"))
    return wanted.join(obs, "id", "inner")


def latest_run_touching(index: DataFrame, runs: DataFrame, obs: DataFrame) -> DataFrame:
    """Newest run per asset whose observation ids include one of the asset's own observations."""
    touched = (
        index.select("run_id", F.explode("observation_ids").alias("id"))
        .join(obs.select("id", F.col("asset_id").alias("owner")), "id", "inner")
        .groupBy("owner", "run_id")
        .agg(F.count(F.lit(1)).alias("shared"))
    )
    return (
        touched.join(runs.select("run_id", "started_at"), "run_id", "inner")
        .groupBy(F.col("owner").alias("asset_id"))
        .agg(F.max_by("run_id", F.struct("started_at", "run_id")).alias("run_id"))
    )


def missing_runs_guard(entries: DataFrame, runs: DataFrame) -> DataFrame:
    """Registry joined to runs; a registry entry without a run fails the query."""
    joined = entries.join(runs.withColumn("_present", F.lit(True)), "run_id", "left")
    checked = F.when(F.col("_present"), F.col("run_id")).otherwise(
        F.raise_error(F.concat(F.lit("reasoning run does not exist: "), F.col("run_id")))
    )
    return joined.withColumn("run_id", checked).drop("_present")


def decision_lineage(runs: DataFrame, goal_id: str) -> DataFrame:
    """Situation, context, plan, action and outcome ids chained by hash of their parent."""
    child = lambda kind, parent: F.concat(F.lit(f"{kind}-"), F.substring(F.sha2(parent, 256), 1, 16))
    out = runs.withColumn("situation_id", child("situation", F.concat_ws("|", F.lit(goal_id), "run_id")))
    given = F.col("goal_id") if "goal_id" in runs.columns else F.lit(goal_id)
    guarded = F.when(given == goal_id, F.col("situation_id")).otherwise(
        F.raise_error(F.lit("situation must belong to the supplied goal"))
    )
    out = out.withColumn("context_id", child("context", guarded))
    out = out.withColumn("plan_id", child("plan", F.col("context_id")))
    out = out.withColumn("action_id", child("action", F.col("plan_id")))
    return out.withColumn("outcome_id", child("outcome", F.col("action_id")))
