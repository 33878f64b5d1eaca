"""Evaluation of scored rows, alert policies and systems per cohort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.functions.hysteresis import Policy
from sensorloom.lineage import cut_lineage
from sensorloom.operators import alerts, metrics, series

# Candidates of the search over abstention thresholds.
CONFIDENCE_THRESHOLDS = (0.50, 0.60, 0.70, 0.80, 0.90)
ABSTENTION_PERSISTENCE = (2, 3, 4)


def evaluate(
    rows: DataFrame, runs: DataFrame, classes: Sequence[str], healthy: str, policy: Policy, prefix: str = "p_", cohort: str = "cohort"
) -> DataFrame:
    """One row of row-level, availability and alert figures per cohort.

    ``rows`` carry run_id, tick, elapsed, ``<prefix><class>``, true_class, valid, healthy_part
    and the cohort; ``runs`` carry run_id, fault_class, fault_start and the cohort.
    """
    by = [cohort]
    predicted = rows.withColumn("_pred", alerts.argmax_class(classes, prefix))
    usable = predicted.filter("valid")
    per_class = metrics.per_class_metrics(usable, classes, by, predicted="_pred")
    overall = metrics.overall_metrics(per_class, by).select(cohort, "balanced_accuracy", "macro_f1")
    recall = per_class.filter(F.col("class_label") != healthy).groupBy(*by).agg(F.min("recall").alias("min_recall"))
    healthy_fp = predicted.groupBy(*by).agg(
        F.coalesce(
            F.avg(F.when(F.col("valid") & (F.col("true_class") == healthy), (F.col("_pred") != healthy).cast("double"))), F.lit(0.0)
        ).alias("healthy_fp"),
        F.avg(F.col("valid").cast("double")).alias("coverage"),
    )
    folded = cut_lineage(
        alerts.alert_fold(
            rows, [cohort, "run_id"], classes, healthy, [policy], valid=F.col("valid"), healthy_part=F.col("healthy_part"), prefix=prefix
        )
    )
    alert = alert_figures(folded, runs, cohort)
    return overall.join(recall, by).join(healthy_fp, by).join(alert, by, "left")


def alert_figures(folded: DataFrame, runs: DataFrame, cohort: str = "cohort") -> DataFrame:
    """Gap-aware false-alert and detection figures per cohort."""
    keys = [cohort, "run_id"]
    events, segments = alerts.events_of(folded), alerts.segments_of(folded, keys)
    starts = runs.select("run_id", "fault_start")
    calm = events.join(starts, "run_id").filter(F.col("fault_start").isNull() | (F.col("elapsed") < F.col("fault_start"))).drop("fault_start")
    figures = alerts.false_alert_summary(alerts.episodes(calm, segments, keys), segments, gap_aware=True, by=(cohort,)).select(
        cohort, F.col("events_per_healthy_hour").alias("false_alert_rate"), F.col("healthy_runs_with_alert").alias("healthy_runs_affected")
    )
    fault_runs = runs.filter(F.col("fault_start").isNotNull())
    detected = cut_lineage(
        alerts.run_detection(events, fault_runs).join(runs.select("run_id", cohort), "run_id")
    )
    summary = alerts.detection_summary(detected, (cohort,))
    missed = alerts.missed_fraction_by_class(detected, (cohort, "fault_class")).groupBy(cohort).agg(
        F.max("any_missed_fraction").alias("max_missed_fraction")
    )
    # every cohort keeps its detection figures; without healthy hours there are no false alerts
    every = runs.select(cohort).distinct()
    joined = every.join(figures, cohort, "left").join(summary, cohort, "left").join(missed, cohort, "left")
    return joined.fillna(0, ["false_alert_rate", "healthy_runs_affected"])


def choose_persistence(rows: DataFrame, runs: DataFrame, healthy: str, candidates: Sequence[int] = (2, 3), cadence: float = 10.0) -> DataFrame:
    """Detected share and false alarms per hour per candidate; the best one is marked."""
    parts = []
    for n in candidates:
        fault_rows = rows.filter(F.col("fault_start").isNotNull())
        hit = alerts.first_qualifying_detection(fault_rows, n).agg(F.avg(F.col("detected").cast("double")).alias("detected_fraction"))
        alarms = alerts.false_alarm_events(rows.filter("healthy_part"), n, healthy).agg(
            (F.sum("false_alarm_events") / (F.sum("rows") * F.lit(cadence) / F.lit(3600.0))).alias("false_alarms_per_healthy_hour")
        )
        parts.append(hit.crossJoin(alarms).withColumn("persistence", F.lit(n)))  # one row each
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    best = table.agg(
        F.max_by("persistence", F.struct("detected_fraction", -F.col("false_alarms_per_healthy_hour"), -F.col("persistence"))).alias("_b")
    )
    return table.crossJoin(best).withColumn("chosen", F.col("persistence") == F.col("_b")).drop("_b")  # one row


def abstention_search(
    rows: DataFrame, healthy: str, thresholds: Sequence[float] = CONFIDENCE_THRESHOLDS, persistence: Sequence[int] = ABSTENTION_PERSISTENCE,
    max_missed: int = 1, cadence: float = 10.0,
) -> DataFrame:
    """One row per (confidence threshold, persistence) with its figures; ``chosen`` marks the selected one.

    A row below the threshold is ``uncertain`` and breaks a sequence. Candidates that miss more than ``max_missed`` fault runs
    are rejected; survivors (all, where there are none) are ordered by false alarms per healthy hour, median latency and coverage.

    ``rows`` carry run_id, tick, elapsed, fault_class, fault_start, healthy_part, predicted and confidence. All thresholds run
    in one pass, each as series of its own.
    """
    wide = rows.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    wide = wide.withColumns(
        {
            "diagnosis": F.when(F.col("confidence") >= F.col("threshold"), F.col("predicted")).otherwise("uncertain"),
            "run_id": F.struct("threshold", "run_id"),
        }
    )
    covered = wide.groupBy("threshold").agg(
        F.avg((F.col("diagnosis") != "uncertain").cast("double")).alias("coverage"),
        (F.count_if("healthy_part") * F.lit(cadence) / F.lit(3600.0)).alias("_hours"),
    )
    table = None
    for n in persistence:
        found = alerts.first_qualifying_detection(wide.filter(F.col("fault_start").isNotNull()), n, "diagnosis").withColumn("threshold", F.col("run_id.threshold"))
        missed = found.groupBy("threshold").agg(F.count_if(~F.col("detected")).alias("missed_runs"))
        latency = series.exact_median(found, ["threshold"], "latency", "median_latency")
        alarms = alerts.false_alarm_events(wide.filter("healthy_part"), n, healthy, "diagnosis")
        events = alarms.groupBy(F.col("run_id.threshold").alias("threshold")).agg(F.sum("false_alarm_events").alias("_events"))
        part = covered.join(missed, "threshold").join(events, "threshold", "left").join(latency, "threshold", "left").withColumn("persistence", F.lit(n))
        table = part if table is None else table.unionByName(part)
    rate = F.when(F.col("_hours") > 0, F.coalesce("_events", F.lit(0)) / F.col("_hours")).otherwise(0.0)
    out = table.select(
        "threshold", "persistence", "missed_runs", "median_latency", rate.alias("false_alarms_per_healthy_hour"), "coverage",
        (F.col("missed_runs") > max_missed).alias("rejected"),
    )
    # the candidates are a fixed, small table
    order = Window.orderBy("rejected", "false_alarms_per_healthy_hour", F.asc_nulls_last("median_latency"), F.desc("coverage"), "threshold", "persistence")
    return out.withColumn("chosen", F.row_number().over(order) == 1)


def long_form(df: DataFrame, section: str, name: Column) -> DataFrame:
    """(section, name, metric, value) of all numeric columns of a small table."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    numeric = [c for c, k in kinds.items() if k.split("(")[0] in ("double", "bigint", "int", "decimal", "boolean")]
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in numeric])
    return df.select(F.lit(section).alias("section"), name.cast("string").alias("name"), F.explode(pairs).alias("_p")).select("section", "name", "_p.*")


def calibration_experiment(validation: DataFrame, test: DataFrame, classes: Sequence[str], healthy: str, before: str = "m_", after: str = "c_") -> DataFrame:
    """All figures of a calibration as (section, name, metric, value).

    Both tables carry run_id, tick, elapsed, fault_class, fault_start, healthy_part, true_class and the scores before and after.
    Threshold and persistence are chosen on ``validation``; ``test`` is evaluated once, with the chosen ones.
    """
    view = lambda rows, prefix: rows.withColumns(
        {"predicted": alerts.argmax_class(classes, prefix), "confidence": F.greatest(*[F.col(prefix + c) for c in classes])}
    )
    parts = []
    for stage, prefix in (("before", before), ("after", after)):
        rows = view(validation, prefix)
        loss = rows.agg(metrics.log_loss(classes, prefix=prefix).alias("log_loss"), metrics.brier(classes, prefix=prefix).alias("brier"))
        parts.append(long_form(loss.crossJoin(metrics.expected_calibration_error(rows)), "validation_calibration", F.lit(stage)))  # one row each
        parts.append(long_form(metrics.confidence_bands(rows), f"validation_bands_{stage}", F.col("band")))
    scored = cut_lineage(view(validation, after))
    parts.append(long_form(metrics.coverage_metrics(scored, CONFIDENCE_THRESHOLDS, classes, healthy), "validation_coverage", F.col("threshold")))
    search = cut_lineage(abstention_search(scored, healthy))
    parts.append(long_form(search, "validation_search", F.concat_ws("/", "threshold", "persistence")))
    chosen = search.filter("chosen").first()
    if chosen is not None:
        threshold, n = chosen["threshold"], chosen["persistence"]
        final = cut_lineage(view(test, after).withColumn("diagnosis", F.when(F.col("confidence") >= threshold, F.col("predicted")).otherwise("uncertain")))
        parts.append(long_form(metrics.coverage_metrics(final, [threshold], classes, healthy), "test_coverage", F.col("threshold")))
        detected = alerts.first_qualifying_detection(final.filter(F.col("fault_start").isNotNull()), n, "diagnosis")
        parts.append(long_form(detected.agg(F.count(F.lit(1)).alias("fault_runs"), F.count_if("detected").alias("detected")), "test_detection", F.lit(str(n))))
        alarms = alerts.false_alarm_events(final.filter("healthy_part"), n, healthy, "diagnosis").agg(F.sum("false_alarm_events").alias("false_alarm_events"), F.sum("rows").alias("healthy_rows"))
        parts.append(long_form(alarms, "test_alarms", F.lit(str(n))))
        flips = metrics.flip_metrics(view(test, before).withColumn("predicted_after", alerts.argmax_class(classes, after)), classes)
        parts.append(long_form(flips, "test_flips", F.lit("argmax")))
        base = metrics.overall_metrics(metrics.per_class_metrics(view(test, before), classes))
        parts.append(long_form(base, "test_baseline", F.lit("uncalibrated")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def policy_experiment(
    validation: DataFrame, test: DataFrame, runs: DataFrame, classes: Sequence[str], healthy: str, policies: Sequence[Policy], baseline_persistence: int = 3
) -> DataFrame:
    """(section, name, metric, value): row-sequence baseline on both splits, and one evaluation of the chosen policy on ``test``.

    Rows carry run_id, tick, elapsed, fault_class, fault_start, healthy_part, true_class, predicted and the scores.
    """
    search = cut_lineage(alert_policy_search(validation, runs.join(validation.select("run_id").distinct(), "run_id", "left_semi"), classes, healthy, policies, baseline_persistence))
    parts = [long_form(search.drop("rejection"), "validation_search", F.col("policy_id"))]
    for name, rows in (("validation", validation), ("test", test)):
        detected = alerts.first_qualifying_detection(rows.filter(F.col("fault_start").isNotNull()), baseline_persistence)
        figures = detected.agg(F.count(F.lit(1)).alias("fault_runs"), F.count_if("detected").alias("detected"), F.max("latency").alias("max_latency"))
        parts.append(long_form(figures, f"{name}_baseline_detection", F.lit(str(baseline_persistence))))
        alarms = alerts.row_sequence_false_alerts(rows.filter("healthy_part"), baseline_persistence, healthy)
        parts.append(long_form(alarms, f"{name}_baseline_alerts", F.lit(str(baseline_persistence))))
        parts.append(long_form(metrics.overall_metrics(metrics.per_class_metrics(rows, classes)), f"{name}_rows", F.lit("argmax")))
    chosen = search.filter("chosen").select("policy_id").first()
    if chosen is not None:
        policy = policies[chosen["policy_id"]]
        folded = cut_lineage(alerts.alert_fold(test, ["run_id"], classes, healthy, [policy], healthy_part=F.col("healthy_part")))
        events, segments = alerts.events_of(folded), alerts.segments_of(folded, ["run_id"])
        fault_runs = runs.filter(F.col("fault_start").isNotNull()).join(test.select("run_id").distinct(), "run_id", "left_semi")
        name = F.lit(str(chosen["policy_id"]))
        parts.append(long_form(alerts.detection_summary(alerts.run_detection(events, fault_runs)).drop("policy_id"), "test_detection", name))
        calm = events.join(runs.select("run_id", "fault_start"), "run_id").filter(F.col("fault_start").isNull() | (F.col("elapsed") < F.col("fault_start"))).drop("fault_start")
        figures = alerts.false_alert_summary(alerts.episodes(calm, segments, ["run_id"]), segments)
        parts.append(long_form(figures.drop("policy_id"), "test_alerts", name))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def representative_cases(detected: DataFrame, false_alert_runs: DataFrame) -> DataFrame:
    """One run per category: easiest, most delayed, wrong class first, missed, false alert."""
    row = F.struct("run_id", "fault_class")
    latency = F.col("correct_class_latency")
    found = detected.agg(
        F.min_by(row, F.when(F.col("correct_class_detected"), F.struct(latency, F.col("run_id")))).alias("successful_easy_fault"),
        F.max_by(row, F.when(F.col("correct_class_detected"), F.struct(latency, F.col("run_id")))).alias("delayed_detection"),
        F.min_by(row, F.when(F.col("wrong_class_first"), F.col("run_id"))).alias("incorrect_class_alert"),
        F.min_by(row, F.when(~F.col("any_fault_detected"), F.col("run_id"))).alias("missed_fault"),
    ).crossJoin(false_alert_runs.agg(F.min("run_id").alias("_false")))  # one row each
    names = ["successful_easy_fault", "delayed_detection", "incorrect_class_alert", "missed_fault"]
    entries = [F.struct(F.lit(n).alias("category"), F.col(f"{n}.run_id").alias("run_id"), F.col(f"{n}.fault_class").alias("fault_class")) for n in names]
    entries[1] = F.when(F.col("delayed_detection.run_id") != F.col("successful_easy_fault.run_id"), entries[1])
    last = F.struct(
        F.lit("false_alert_on_healthy_run").alias("category"), F.col("_false").alias("run_id"), F.lit(None).cast("string").alias("fault_class")
    )
    listed = F.array_compact(F.array(*entries, last))
    return found.select(F.explode(listed).alias("_c")).select("_c.*").filter(F.col("run_id").isNotNull())


def case_timeline(cases: DataFrame, rows: DataFrame, states: DataFrame) -> DataFrame:
    """Row timeline of each case; ``states`` are the ``state`` rows of the alert fold."""
    picked = F.broadcast(cases)  # at most five rows
    shown = rows.join(picked.select("category", "run_id"), "run_id")
    state = states.filter(F.col("kind") == "state").select("run_id", F.col("pos").alias("tick"), F.col("to_state").alias("alert_state"))
    return shown.join(state, ["run_id", "tick"])


def evidence_items(
    classes: Sequence[str], residuals: Sequence[str], predicted: Column, progress: Column | None = None, prefix: str = "p_"
) -> Column:
    """Top and runner-up class, two largest residuals and alert progress, at most five items."""
    item = lambda label, value, detail: F.struct(label.alias("label"), value.alias("value"), detail.alias("detail"))
    ranked = F.array_sort(F.array(*[F.struct((-F.col(prefix + c)).alias("s"), F.lit(c).alias("c")) for c in classes]))
    first, second = F.element_at(ranked, 1), F.element_at(ranked, 2)
    top = item(F.lit("top_class_probability"), -first["s"], F.concat(first["c"], F.lit(" (diagnosed: "), predicted, F.lit(")")))
    runner = item(F.lit("runner_up_class_probability"), -second["s"], second["c"])
    by_size = F.array_sort(
        F.array(*[F.struct((-F.abs(F.col(r))).alias("s"), F.lit(r).alias("n"), F.col(r).alias("v")) for r in residuals])
    )
    largest = F.transform(
        F.slice(by_size, 1, 2),
        lambda r: item(F.concat(F.lit("residual:"), r["n"]), r["v"], F.lit("observed minus fixed healthy reference curve")),
    )
    parts = F.concat(F.array(top, runner), largest)
    if progress is not None:
        parts = F.concat(parts, F.array_compact(F.array(progress)))
    return F.slice(parts, 1, 5)


def alert_policy_search(
    rows: DataFrame, runs: DataFrame, classes: Sequence[str], healthy: str, policies: Sequence[Policy], baseline_persistence: int = 3
) -> DataFrame:
    """Candidates with the row-sequence baseline latency as their latency limit."""
    fault_rows = rows.filter(F.col("fault_start").isNotNull())
    baseline = alerts.first_qualifying_detection(fault_rows, baseline_persistence)
    median = series.exact_median(baseline, [], "latency", "median_latency")
    folded = alerts.alert_fold(rows, ["run_id"], classes, healthy, policies, healthy_part=F.col("healthy_part"))
    return alerts.search_policies(folded, runs, policies, median)


def compare_systems(systems: dict[str, DataFrame], metrics_: Sequence[str], must_match: tuple[str, str] | None = None, matching: Sequence[str] = ()) -> DataFrame:
    """Figures of several (model, policy) systems side by side.

    Two systems that share a model must agree on the row-level ``matching`` metrics.
    """
    table = None
    for name, figures in systems.items():
        part = figures.select("cohort", *[F.col(m).alias(f"{m}__{name}") for m in metrics_])
        table = part if table is None else table.join(part, "cohort", "full_outer")
    if must_match:
        a, b = must_match
        same = F.lit(True)
        for m in matching:
            same = same & F.col(f"{m}__{a}").eqNullSafe(F.col(f"{m}__{b}"))
        checked = F.when(same, F.col("cohort")).otherwise(F.raise_error(F.lit("systems with one model differ on row metrics")))
        table = table.withColumn("cohort", checked)
    return table
