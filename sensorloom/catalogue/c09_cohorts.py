"""Cohort evaluation, comparison and decision queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom.catalogue.c04_alerts import EVENTS, POLICY, DETECTION, evaluated, fault_runs, fold_sql, folded, healthy_events
from sensorloom.catalogue.c05_metrics import staged
from sensorloom.catalogue.c06_features import SPEC
from sensorloom.catalogue.registry import query, relation
from sensorloom.functions.hysteresis import Policy
from sensorloom.lineage import cut_lineage, stored
from sensorloom.operators import alerts, cohorts, features, metrics
from sensorloom.operators.cohorts import Bands, Promotion
from sensorloom.plans import evaluation
from sensorloom.sources import warehouse as wh

C = wh.CLASSES
COHORTS = ["pilot", "high_load", "hot_start", "late_onset", "high_noise", "combined_ood_v1"]
ISOLATED = ["high_load", "hot_start", "late_onset", "high_noise"]
BANDS = Bands(accuracy_floor=0.30, recall_floor=0.19, alert_rate_excessive=60.0, alert_rate_acceptable=36.0, missed_excessive=0.9, missed_acceptable=0.5,
              minor_drop=0.005, moderate_drop=0.02, accuracy_drop_acceptable=0.001, minor_alert_rate=10.0)
RULES = Promotion(max_pilot_alert_rate=100.0, min_noise_gain=-0.5, max_noise_alert_rate=100.0, min_combined_gain=-0.5, recall_floor=0.01, max_missed_regression=20, max_pilot_drop=0.2)
NAMES = "['pilot', 'high_load', 'hot_start', 'late_onset', 'high_noise', 'combined_ood_v1']"
relation("cohort_rows", f"SELECT *, {NAMES}[run_id % 6 + 1] AS cohort FROM diagnosed_rows", "diagnosed_rows")
relation(
    "robust_rows",
    """SELECT * REPLACE (a_A AS p_A, a_N AS p_N, a_R AS p_R, greatest(a_A, a_N, a_R) AS confidence, CASE WHEN a_A >= a_N AND a_A >= a_R THEN 'A' WHEN a_N >= a_R THEN 'N' ELSE 'R' END AS predicted) FROM (
       SELECT *, round(wa / (wa + wn + wr), 9) AS a_A, round(wn / (wa + wn + wr), 9) AS a_N, round(wr / (wa + wn + wr), 9) AS a_R FROM (
       SELECT *, 0.6::DOUBLE * p_A AS wa, 1.0::DOUBLE * p_N AS wn, 1.3::DOUBLE * p_R AS wr FROM cohort_rows))""",
    "cohort_rows",
)
relation("fold_robust", "RECURSIVE_ " + fold_sql(0.45, "3", 0.45, "2", valid="s.valid", source="robust_rows").replace("_self_", "fold_robust"), "robust_rows")
relation("events_robust", EVENTS.format(f="fold_robust"), "fold_robust")
relation("detection_robust", DETECTION.format(ev="events_robust"), "events_robust", "runs")


def evaluation_sql(rows: str, fold: str, events: str, detection: str) -> str:
    return f"""WITH pc AS (SELECT cohort, c, count(*) FILTER (true_class = c) AS t, count(*) FILTER (predicted = c) AS p, count(*) FILTER (true_class = c AND predicted = c) AS tp FROM {rows}, (VALUES ('A'), ('N'), ('R')) v(c) WHERE valid GROUP BY 1, 2),
      o AS (SELECT cohort, avg(tp / t) FILTER (t > 0) AS balanced_accuracy, avg(coalesce(2 * tp / nullif(t + p, 0), 0)) AS macro_f1, min(tp / t) FILTER (c <> 'N') AS min_recall FROM pc GROUP BY 1),
      h AS (SELECT cohort, avg((predicted <> 'N')::INT) FILTER (valid AND true_class = 'N') AS healthy_fp, avg(valid::INT) AS coverage FROM {rows} GROUP BY 1),
      cr AS (SELECT run_id, {NAMES}[run_id % 6 + 1] AS cohort FROM runs),
      seg AS (SELECT run_id, count(*) FILTER (valid) AS valid_rows, max(elapsed) + 10.0 AS segment_end FROM {fold} WHERE part GROUP BY 1),
      ep AS (SELECT e.run_id, coalesce(nxt, segment_end) - elapsed AS duration FROM (SELECT *, lead(elapsed) OVER (PARTITION BY run_id ORDER BY pos) AS nxt FROM (SELECT e.* FROM {events} e JOIN runs r USING (run_id) WHERE r.fault_start IS NULL OR e.elapsed < r.fault_start)) e JOIN seg USING (run_id) WHERE event_type <> 'cleared'),
      f AS (SELECT cohort, coalesce(any_value(n), 0) / (sum(valid_rows) * 10.0 / 3600.0) AS false_alert_rate, coalesce(any_value(k), 0) AS healthy_runs_affected FROM seg JOIN cr USING (run_id) LEFT JOIN (SELECT cohort, count(*) AS n, count(DISTINCT run_id) AS k FROM ep JOIN cr USING (run_id) GROUP BY 1) USING (cohort) GROUP BY 1),
      d AS (SELECT cohort, count(*) AS fault_runs, count(*) FILTER (NOT correct_class_detected) AS correct_class_missed, count(*) FILTER (NOT any_fault_detected) AS any_fault_missed, count(*) FILTER (wrong_class_first) AS wrong_class_runs,
        quantile_cont(correct_class_latency, 0.5) AS median_latency, count(*) FILTER (correct_class_latency <= 120) / count(*)::DOUBLE AS within_120s FROM {detection} JOIN cr USING (run_id) GROUP BY 1),
      m AS (SELECT cohort, max(x) AS max_missed_fraction FROM (SELECT cohort, fault_class, avg((NOT any_fault_detected)::INT) AS x FROM {detection} JOIN cr USING (run_id) GROUP BY 1, 2) GROUP BY 1)
      SELECT * FROM o JOIN h USING (cohort) LEFT JOIN f USING (cohort) LEFT JOIN d USING (cohort) LEFT JOIN m USING (cohort)"""


relation("evaluated", evaluation_sql("cohort_rows", "fold_gap", "events_all_gap", "detection_gap"), "cohort_rows", "fold_gap", "events_all_gap", "detection_gap", "runs")
relation("evaluated_robust", evaluation_sql("robust_rows", "fold_robust", "events_robust", "detection_robust"), "robust_rows", "fold_robust", "events_robust", "detection_robust", "runs")
FIGURES = ["balanced_accuracy", "macro_f1", "min_recall", "healthy_fp", "coverage", "false_alert_rate", "healthy_runs_affected", "fault_runs", "correct_class_missed",
           "any_fault_missed", "wrong_class_runs", "median_latency", "within_120s", "max_missed_fraction"]
ROUNDED = ["balanced_accuracy", "macro_f1", "min_recall", "healthy_fp", "coverage", "false_alert_rate", "within_120s", "max_missed_fraction"]


def cohort_name(key):
    return F.element_at(F.array(*[F.lit(c) for c in COHORTS]), (key % 6 + 1).cast("int"))


def cohort_rows(spark, sf):
    rows = evaluated(spark, sf).withColumn("cohort", cohort_name(F.col("run_id")))
    w = {"A": F.col("p_A") * 0.6, "N": F.col("p_N") * 1.0, "R": F.col("p_R") * 1.3}
    return rows.withColumns({f"a_{c}": F.round(w[c] / (w["A"] + w["N"] + w["R"]), 9) for c in C})


def cohort_runs(spark, sf):
    return wh.runs(spark, sf).withColumnRenamed("class_label", "fault_class").withColumn("cohort", cohort_name(F.col("run_id")))


def cohort_table(spark, sf):
    """The rows of the cohorts, numbered once: an evaluation reads them several times, and decisions need two evaluations."""
    scores = [f"{prefix}{c}" for prefix in ("p_", "a_") for c in C]
    return stored(cohort_rows(spark, sf).select("cohort", "run_id", "tick", "elapsed", "true_class", *scores, "valid", "healthy_part"), "cohort-rows")


def figures(spark, sf, prefix="p_", rows=None):
    """Six cohorts: a small table that several decisions read."""
    rows = cohort_table(spark, sf) if rows is None else rows
    return cut_lineage(evaluation.evaluate(rows, cohort_runs(spark, sf), C, "N", POLICY, prefix))


def r8(df, columns=ROUNDED):
    return df.withColumns({c: F.round(c, 8) for c in columns if c in df.columns})


@query(
    "M07_evaluate",
    "SELECT cohort, " + ", ".join(f"round({c}, 8) AS {c}" if c in ROUNDED else c for c in FIGURES) + " FROM evaluated",
    ("evaluated",),
)
def m07(spark, sf):
    return r8(figures(spark, sf)).select("cohort", *FIGURES)


COMPARED = ["balanced_accuracy", "macro_f1", "false_alert_rate", "correct_class_missed"]


@query(
    "J13_compare_cohorts",
    " UNION ALL ".join(
        f"""SELECT a.cohort, '{m}' AS metric, round(a.{m}, 8)::DOUBLE AS base_value, round(b.{m}, 8)::DOUBLE AS other_value, round(b.{m} - a.{m}, 8)::DOUBLE AS absolute_change,
        CASE WHEN abs(a.{m}) >= 1e-12 THEN round((b.{m} - a.{m}) / abs(a.{m}), 8) END::DOUBLE AS relative_change FROM evaluated a JOIN evaluated_robust b USING (cohort)"""
        for m in COMPARED
    ),
    ("evaluated", "evaluated_robust"),
)
def j13(spark, sf):
    rows = cohort_table(spark, sf)
    long = lambda prefix: cohorts.metric_long(figures(spark, sf, prefix, rows), ["cohort"], COMPARED)
    return r8(cohorts.compare(long("p_"), long("a_"), ["cohort"]), ["base_value", "other_value", "absolute_change", "relative_change"])


relation(
    "damage",
    """SELECT *, CASE WHEN min_recall <= 0.19 OR coalesce(max_missed_fraction, 0) > 0.9 OR coalesce(false_alert_rate, 0) > 60 OR balanced_accuracy <= 0.30 THEN 'catastrophic'
         WHEN balanced_accuracy_drop > 0.02 OR coalesce(false_alert_rate, 0) > 36 OR coalesce(max_missed_fraction, 0) > 0.5 THEN 'major' WHEN balanced_accuracy_drop > 0.005 THEN 'moderate'
         WHEN coalesce(false_alert_rate, 0) <= 10 AND coalesce(max_missed_fraction, 0) = 0 THEN 'minor' ELSE 'moderate' END AS tier FROM (
       SELECT e.*, b.ba - balanced_accuracy AS balanced_accuracy_drop, b.f1 - macro_f1 AS macro_f1_drop, healthy_fp - b.fp AS healthy_fp_increase FROM evaluated e, (SELECT balanced_accuracy AS ba, macro_f1 AS f1, healthy_fp AS fp FROM evaluated WHERE cohort = 'pilot') b)""",
    "evaluated",
)


def damaged(spark, sf):
    return cohorts.damage(figures(spark, sf), "pilot", BANDS)


@query(
    "D22_shift_damage",
    "SELECT cohort, round(balanced_accuracy_drop, 8) AS balanced_accuracy_drop, round(macro_f1_drop, 8) AS macro_f1_drop, round(healthy_fp_increase, 8) AS healthy_fp_increase, tier FROM damage",
    ("damage",),
)
def d22(spark, sf):
    out = r8(damaged(spark, sf), ["balanced_accuracy_drop", "macro_f1_drop", "healthy_fp_increase"])
    return out.select("cohort", "balanced_accuracy_drop", "macro_f1_drop", "healthy_fp_increase", "tier")


@query("D21_classify_shift", "SELECT cohort, tier FROM damage", ("damage",))
def d21(spark, sf):
    return damaged(spark, sf).select("cohort", "tier")


@query(
    "D20_ood_verdict",
    """SELECT cohort, concat_ws('|', CASE WHEN min_recall <= 0.19 THEN 'class_recall_collapse' END, CASE WHEN coalesce(max_missed_fraction, 0) > 0.9 THEN 'missed_runs_excessive' END, CASE WHEN coalesce(false_alert_rate, 0) > 60 THEN 'false_alert_rate_excessive' END,
         CASE WHEN balanced_accuracy <= 0.30 THEN 'balanced_accuracy_collapse' END) AS reasons,
       CASE WHEN tier = 'catastrophic' THEN 'DOES NOT GENERALIZE — MODEL OR FEATURE REVISION REQUIRED' WHEN balanced_accuracy_drop <= 0.001 AND coalesce(false_alert_rate, 0) <= 36 AND coalesce(max_missed_fraction, 0) <= 0.5 THEN 'GENERALIZES ACCEPTABLY TO OOD V1'
       ELSE 'GENERALIZES WITH MATERIAL DEGRADATION' END AS verdict FROM damage""",
    ("damage",),
)
def d20(spark, sf):
    return cohorts.ood_verdict(damaged(spark, sf), BANDS).select("cohort", F.array_join("reasons", "|").alias("reasons"), "verdict")


@query(
    "T03_rank_shifts",
    " UNION ALL ".join(f"SELECT '{m}' AS metric, cohort, row_number() OVER (ORDER BY {m} DESC NULLS LAST, cohort)::INTEGER AS rank FROM damage" for m in cohorts.RANKED),
    ("damage",),
)
def t03(spark, sf):
    return cohorts.rank_shifts(damaged(spark, sf)).select("metric", "cohort", "rank")


ISO = "cohort IN ('high_load', 'hot_start', 'late_onset', 'high_noise')"


@query(
    "D21_study_verdict",
    f"""WITH r AS (SELECT cohort, balanced_accuracy_drop AS d, CASE tier WHEN 'minor' THEN 0 WHEN 'moderate' THEN 1 WHEN 'major' THEN 2 ELSE 3 END AS t FROM damage WHERE {ISO}), o AS (SELECT *, row_number() OVER (ORDER BY t DESC, d DESC, cohort) AS k FROM r)
       SELECT (SELECT cohort FROM o WHERE k = 1) AS primary_failure, (SELECT CASE WHEN t >= 1 THEN cohort END FROM o WHERE k = 2) AS secondary_failure,
         CASE WHEN (SELECT max(1 - coverage) FROM damage) > 0.06 THEN 'A' WHEN (SELECT count(*) FROM r WHERE t >= 2) >= 3 THEN 'D' WHEN (SELECT count(*) FROM r WHERE t >= 2) = 1 AND (SELECT t FROM r WHERE cohort = 'high_load') >= 2 THEN 'B' ELSE 'C' END AS recommendation""",
    ("damage",),
)
def d21v(spark, sf):
    table = cut_lineage(damaged(spark, sf))
    invalid = table.select("cohort", (1 - F.col("coverage")).alias("rejection_fraction"))
    bands = Bands(invalid_rows_material=0.06)
    return cohorts.study_verdict(table.filter(F.col("cohort").isin(*ISOLATED)), invalid, bands).drop("recommendation_description")


@query(
    "D23_interaction",
    f"""SELECT round(c, 8) AS combined_drop, wc AS worst_shift, round(w, 8) AS worst_drop, round(s, 8) AS sum_drop, CASE WHEN w <= 0 THEN 'uncertain' WHEN c <= w * 1.15 THEN 'no' WHEN c < s THEN 'uncertain' ELSE 'yes' END AS interaction_likely FROM (
       SELECT max(balanced_accuracy_drop) FILTER (cohort = 'combined_ood_v1') AS c, max(balanced_accuracy_drop) FILTER ({ISO}) AS w, max_by(cohort, balanced_accuracy_drop) FILTER ({ISO}) AS wc, sum(balanced_accuracy_drop) FILTER ({ISO}) AS s FROM damage)""",
    ("damage",),
)
def d23(spark, sf):
    out = cohorts.interaction(damaged(spark, sf), "combined_ood_v1", ISOLATED)
    return r8(out, ["combined_drop", "worst_drop", "sum_drop"]).drop("load_noise_note")


@query(
    "D23_late_onset_note",
    """SELECT round(ramp, 8) AS ramp, round(post_ramp, 8) AS post_ramp, CASE WHEN post_ramp - ramp > 0.15 THEN 'shorter_window' ELSE 'beyond_window' END AS late_onset FROM (SELECT avg(r) FILTER (stage = 'ramp') AS ramp, avg(r) FILTER (stage = 'post_ramp') AS post_ramp FROM (
       SELECT true_class, stage, avg((predicted = true_class)::INT) AS r FROM (SELECT *, CASE WHEN elapsed >= fault_start THEN CASE WHEN elapsed - fault_start < fault_duration THEN 'ramp' ELSE 'post_ramp' END END AS stage FROM cohort_rows WHERE cohort = 'late_onset' AND true_class <> 'N')
       WHERE stage IS NOT NULL GROUP BY 1, 2))""",
    ("cohort_rows",),
)
def d23l(spark, sf):
    rows = staged(spark, sf).filter((cohort_name(F.col("run_id")) == "late_onset") & (F.col("true_class") != "N") & F.col("stage").isNotNull())
    recalls = rows.groupBy("true_class", "stage").agg(F.avg((F.col("predicted") == F.col("true_class")).cast("double")).alias("recall"))
    return r8(cohorts.late_onset_note(recalls), ["ramp", "post_ramp"])


@query(
    "D23_hot_start_note",
    """WITH r AS (SELECT * FROM cohort_rows WHERE cohort = 'hot_start'), t AS (SELECT predicted, count(*) AS n FROM r WHERE true_class = 'N' AND predicted <> 'N' GROUP BY 1), p AS (SELECT predicted AS c, avg((true_class = predicted)::INT) AS precision FROM r WHERE predicted <> 'N' GROUP BY 1)
       SELECT max_by(predicted, n) AS top_target, max(n) AS top_rows, (SELECT min_by(c, precision) FROM p) AS lowest_precision_class, max_by(predicted, n) = 'A' AND (SELECT min_by(c, precision) FROM p) = 'A' AS specific_confusion FROM t""",
    ("cohort_rows",),
)
def d23h(spark, sf):
    rows = wh.raw_scored(spark, sf).filter(cohort_name(F.col("run_id")) == "hot_start").withColumn("predicted", alerts.argmax_class(C))
    return cohorts.hot_start_note(metrics.per_class_metrics(rows, C), metrics.confusion(rows, C), "N", "A")


relation(
    "promotion_rows",
    """SELECT a.cohort, a.balanced_accuracy AS ba_original, b.balanced_accuracy AS ba_robust, b.false_alert_rate AS rate_robust, b.min_recall AS min_recall_robust, a.correct_class_missed AS missed_original, b.correct_class_missed AS missed_robust
       FROM evaluated a JOIN evaluated_robust b USING (cohort)""",
    "evaluated",
    "evaluated_robust",
)


def promotion_rows(spark, sf):
    rows = cohort_table(spark, sf)
    a, b = figures(spark, sf, rows=rows), figures(spark, sf, "a_", rows)
    return a.select("cohort", F.col("balanced_accuracy").alias("ba_original"), F.col("correct_class_missed").alias("missed_original")).join(
        b.select(
            "cohort", F.col("balanced_accuracy").alias("ba_robust"), F.col("false_alert_rate").alias("rate_robust"),
            F.col("min_recall").alias("min_recall_robust"), F.col("correct_class_missed").alias("missed_robust"),
        ),
        "cohort",
    )


def promotion_sql(d: dict, r: Promotion) -> str:
    return f"""SELECT round(pilot_drop, 8) AS pilot_drop, round(noise_gain, 8) AS noise_gain, round(combined_gain, 8) AS combined_gain, collapsed, missed_regressions,
      CASE WHEN pilot_drop > {r.max_pilot_drop} OR pilot_rate > {r.max_pilot_alert_rate} THEN '{d['regression']}' WHEN collapsed > 0 THEN '{d['collapse']}'
        WHEN noise_gain < {r.min_noise_gain} OR combined_gain < {r.min_combined_gain} OR noise_rate > {r.max_noise_alert_rate} OR missed_regressions > 0 THEN '{d['insufficient']}' ELSE '{d['promote']}' END AS decision FROM (
      SELECT coalesce(max(ba_original - ba_robust) FILTER (cohort = 'pilot'), 0) AS pilot_drop, coalesce(max(rate_robust) FILTER (cohort = 'pilot'), 0) AS pilot_rate, coalesce(max(ba_robust - ba_original) FILTER (cohort = 'high_noise'), 0) AS noise_gain,
        coalesce(max(rate_robust) FILTER (cohort = 'high_noise'), 0) AS noise_rate, coalesce(max(ba_robust - ba_original) FILTER (cohort = 'combined_ood_v1'), 0) AS combined_gain, count(*) FILTER (min_recall_robust <= {r.recall_floor}) AS collapsed,
        count(*) FILTER (missed_robust - missed_original > {r.max_missed_regression}) AS missed_regressions FROM promotion_rows)"""


@query("D24_promotion_decision", promotion_sql(cohorts.MODEL_DECISIONS, RULES), ("promotion_rows",))
def d24(spark, sf):
    out = cohorts.promotion(promotion_rows(spark, sf), RULES)
    return r8(out, ["pilot_drop", "noise_gain", "combined_gain"]).drop("pilot_rate", "noise_rate")


@query("D24_policy_promotion_decision", promotion_sql(cohorts.POLICY_DECISIONS, Promotion()), ("promotion_rows",))
def d24p(spark, sf):
    out = cohorts.promotion(promotion_rows(spark, sf), Promotion(), decisions=cohorts.POLICY_DECISIONS)
    return r8(out, ["pilot_drop", "noise_gain", "combined_gain"]).drop("pilot_rate", "noise_rate")


@query(
    "D24_no_survivor",
    f"""SELECT count(*) AS candidates, 0::BIGINT AS survivors, '{cohorts.POLICY_DECISIONS['insufficient']}' AS decision, '{cohorts.NO_SURVIVOR}' AS reason FROM search WHERE missed >= 0""",
    ("search",),
)
def d24n(spark, sf):
    """A search in which every candidate is rejected: the baseline was faster than any of them by more than the tolerance."""
    from sensorloom.catalogue.c04_alerts import policy_search

    impossible = spark.range(1).select(F.lit(-1e6).alias("median_latency"))
    return cohorts.policy_promotion(policy_search(spark, sf, baseline=impossible), promotion_rows(spark, sf))


@query(
    "T05_best_trial",
    """SELECT c_mktsegment AS feature_group, arg_max(c_custkey, (c_acctbal, -c_custkey)) AS trial, max(c_acctbal) AS score FROM customer GROUP BY 1""",
)
def t05(spark, sf):
    trials = wh.table(spark, sf, "customer")
    return trials.groupBy(F.col("c_mktsegment").alias("feature_group")).agg(
        F.max_by("c_custkey", F.struct("c_acctbal", -F.col("c_custkey"))).alias("trial"), F.max("c_acctbal").alias("score")
    )


relation(
    "cases",
    """SELECT 'successful_easy_fault' AS category, run_id, fault_class FROM (SELECT * FROM detection WHERE correct_class_detected ORDER BY correct_class_latency, run_id LIMIT 1)
       UNION ALL SELECT 'delayed_detection', run_id, fault_class FROM (SELECT * FROM detection WHERE correct_class_detected ORDER BY correct_class_latency DESC, run_id DESC LIMIT 1)
       UNION ALL SELECT 'incorrect_class_alert', run_id, fault_class FROM (SELECT * FROM detection WHERE wrong_class_first ORDER BY run_id LIMIT 1)
       UNION ALL SELECT 'missed_fault', run_id, fault_class FROM (SELECT * FROM detection WHERE NOT any_fault_detected ORDER BY run_id LIMIT 1)
       UNION ALL SELECT 'false_alert_on_healthy_run', min(run_id), NULL FROM episodes""",
    "detection",
    "episodes",
)


def cases(spark, sf):
    out = cut_lineage(folded(spark, sf))
    events = alerts.events_of(out)
    detected = alerts.run_detection(events, fault_runs(spark, sf))
    found = alerts.episodes(healthy_events(events, spark, sf), alerts.segments_of(out, ["run_id"]), ["run_id"])
    return evaluation.representative_cases(detected, found)


@query("T06_representative_cases", "SELECT * FROM cases", ("cases",))
def t06(spark, sf):
    return cases(spark, sf)


@query(
    "T06_case_timeline",
    """SELECT c.category, f.run_id, f.tick, d.true_class, d.predicted, CASE WHEN conf <> '' THEN 'confirmed_' || conf WHEN cand <> '' THEN 'pending_' || cand ELSE 'N' END AS alert_state
       FROM fold f JOIN cases c USING (run_id) JOIN diagnosed_rows d ON d.run_id = f.run_id AND d.tick = f.tick""",
    ("cases", "fold", "diagnosed_rows"),
)
def t06t(spark, sf):
    picked = cut_lineage(cases(spark, sf))
    rows = evaluated(spark, sf).join(F.broadcast(picked.select("run_id").distinct()), "run_id", "left_semi")  # at most five runs
    states = folded(spark, sf, rows=rows, row_states=True)
    return evaluation.case_timeline(picked, rows, states).select("category", "run_id", "tick", "true_class", "predicted", "alert_state")


@query(
    "T07_evidence_top_residuals",
    """SELECT run_id, tick, 'top_class_probability|runner_up_class_probability|' || CASE WHEN abs(r1) > abs(r2) OR (abs(r1) = abs(r2)) THEN 'residual:discount__residual|residual:tax__residual' ELSE 'residual:tax__residual|residual:discount__residual' END AS labels FROM (
       SELECT run_id, tick, round(l_discount - (0.05 + l_quantity / 50.0 * 0.01), 9) AS r1, round(l_tax - (0.02 + l_quantity / 50.0 * 0.04), 9) AS r2 FROM scored)""",
    ("scored",),
)
def t07(spark, sf):
    extra = features.Residual("discount__residual", "l_discount", "l_quantity", 0.05, 0.01, 50.0)
    rows = wh.scored(spark, sf).withColumns(
        {r.name: F.round(features.residual_value(r), 9) for r in (*SPEC.residuals, extra)}
    )
    items = evaluation.evidence_items(C, ["tax__residual", "discount__residual"], alerts.argmax_class(C))
    return rows.select("run_id", "tick", F.array_join(F.transform(items, lambda i: i["label"]), "|").alias("labels"))


def persistence_sql(n: int) -> str:
    return f"""SELECT {n} AS persistence, round((SELECT avg((t IS NOT NULL)::INT) FROM runs r LEFT JOIN (SELECT run_id, min(elapsed) AS t FROM (SELECT run_id, elapsed, row_number() OVER (PARTITION BY run_id, g ORDER BY tick) AS k FROM (
        SELECT *, tick - row_number() OVER (PARTITION BY run_id ORDER BY tick) AS g FROM diagnosed_rows WHERE predicted = fault_class AND elapsed >= fault_start)) WHERE k = {n} GROUP BY run_id) d USING (run_id) WHERE r.fault_start IS NOT NULL), 9) AS detected_fraction,
      round((SELECT count(*) FILTER (predicted <> 'N' AND n >= {n}) / (sum(n) * 10.0 / 3600.0) FROM sequence_islands), 9)::DOUBLE AS false_alarms_per_healthy_hour"""


@query(
    "M04_choose_persistence",
    f"""WITH c AS ({persistence_sql(2)} UNION ALL {persistence_sql(3)}) SELECT *, row_number() OVER (ORDER BY detected_fraction DESC, false_alarms_per_healthy_hour, persistence) = 1 AS chosen FROM c""",
    ("diagnosed_rows", "sequence_islands", "runs"),
)
def m04(spark, sf):
    out = evaluation.choose_persistence(evaluated(spark, sf), wh.runs(spark, sf), "N")
    return r8(out, []).withColumns({c: F.round(c, 9) for c in ("detected_fraction", "false_alarms_per_healthy_hour")})


@query("M10_alert_policy_experiment")
def m10(spark, sf):
    rows = cut_lineage(evaluated(spark, sf))
    runs = wh.runs(spark, sf).withColumnRenamed("class_label", "fault_class")
    table = evaluation.alert_policy_search(
        rows.filter(F.col("split") == "validation"), runs.filter(F.col("split") == "validation"), C, "N", alerts.policy_grid()
    )
    return table.drop("entry_probability", "exit_probability")


@query("M10_policy_test_evaluation")
def m10t(spark, sf):
    """The row-sequence baseline of both splits, and the chosen policy evaluated once on the test split."""
    rows = cut_lineage(evaluated(spark, sf))
    runs = wh.runs(spark, sf).withColumnRenamed("class_label", "fault_class")
    return evaluation.policy_experiment(rows.filter(F.col("split") == "validation"), rows.filter(F.col("split") == "test"), runs, C, "N", alerts.policy_grid())


@query("M11_compare_systems")
def m11(spark, sf):
    """Two fitted models and two policies: A (two signals, first policy), B (all signals, first policy), C (all signals, second policy)."""
    from sensorloom.plans import models

    read = ["cohort", "run_id", "tick", "elapsed", "true_class", "valid", "healthy_part"]  # by an evaluation, with one model's scores
    rows = cut_lineage(models.labelled(cohort_rows(spark, sf), C).select(*read, "split", "label", "weight", *wh.SIGNALS))
    train = rows.filter(F.col("split") == "train")
    signals = {"m_": wh.SIGNALS[:2], "n_": wh.SIGNALS}
    for prefix, columns in signals.items():
        rows = models.score(models.train_logistic(train, columns, 1.0), rows, C, prefix).drop("confidence", "predicted")
    rows, runs = stored(rows.select(*read, *[f"{prefix}{c}" for prefix in signals for c in C]), "system-rows"), cohort_runs(spark, sf)
    system = lambda prefix, policy: cut_lineage(evaluation.evaluate(rows, runs, C, "N", policy, prefix))
    systems = {"A": system("m_", Policy(0.35, 3, 0.35, 2)), "B": system("n_", Policy(0.35, 3, 0.35, 2)), "C": system("n_", Policy(0.4, 2, 0.3, 2))}
    return evaluation.compare_systems(systems, ["balanced_accuracy", "macro_f1", "false_alert_rate"], ("B", "C"), ["balanced_accuracy", "macro_f1"])
