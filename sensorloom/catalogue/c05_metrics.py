"""Classification, calibration, shift and split metrics over the scored samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom.catalogue.c04_alerts import DIAG, evaluated, fault_runs, folded, healthy_events
from sensorloom.catalogue.registry import query, relation
from sensorloom.functions import scalar
from sensorloom.operators import alerts, joins, metrics, series
from sensorloom.sources import warehouse as wh

C = wh.CLASSES
relation(
    "rated",
    f"""SELECT *, {DIAG} AS predicted, greatest(p_A, p_N, p_R) AS confidence FROM scored""",
    "scored",
)


def rated(spark, sf):
    """Scored rows with prediction and confidence; no row order needed, so no tick is computed."""
    rows = wh.raw_scored(spark, sf)
    return rows.withColumn("predicted", alerts.argmax_class(C)).withColumn("confidence", F.greatest(*[F.col(f"p_{c}") for c in C]))


def r9(df, *columns):
    return df.withColumns({c: F.round(c, 9) for c in columns})


PER_CLASS = """SELECT c AS class_label, count(*) FILTER (true_class = c) AS support, count(*) FILTER (predicted = c) AS predicted_rows,
  count(*) FILTER (true_class = c AND predicted = c) AS tp FROM rated, (VALUES ('A'), ('N'), ('R')) t(c) GROUP BY c"""
relation(
    "per_class",
    f"""SELECT *, coalesce(tp / nullif(predicted_rows, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall,
        coalesce(2 * tp / nullif(support + predicted_rows, 0), 0) AS f1 FROM ({PER_CLASS})""",
    "rated",
)


@query(
    "A16_per_class_metrics",
    "SELECT class_label, support, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM per_class",
    ("per_class",),
)
def a16(spark, sf):
    out = metrics.per_class_metrics(rated(spark, sf), C)
    return r9(out, "precision", "recall", "f1").select("class_label", "support", "precision", "recall", "f1")


@query(
    "A16_multiclass_metrics",
    """SELECT round(avg(recall), 9) AS balanced_accuracy, round(avg(precision), 9) AS macro_precision, round(avg(recall), 9) AS macro_recall,
       round(avg(f1), 9) AS macro_f1, sum(support)::BIGINT AS rows FROM per_class""",
    ("per_class",),
)
def a16o(spark, sf):
    out = metrics.overall_metrics(metrics.per_class_metrics(rated(spark, sf), C))
    return r9(out, "balanced_accuracy", "macro_precision", "macro_recall", "macro_f1")


@query(
    "A16_confusion_matrix",
    """SELECT t AS true_class, p AS predicted, count(r.true_class) AS rows FROM (VALUES ('A'), ('N'), ('R')) a(t) CROSS JOIN (VALUES ('A'), ('N'), ('R')) b(p)
       LEFT JOIN rated r ON r.true_class = t AND r.predicted = p GROUP BY 1, 2""",
    ("rated",),
)
def a16c(spark, sf):
    return metrics.confusion(rated(spark, sf), C)


BAND = "CASE WHEN severity >= 0.15 AND severity < 0.40 THEN 'mild' WHEN severity >= 0.40 AND severity < 0.70 THEN 'moderate' WHEN severity >= 0.70 AND severity < 1.0000001 THEN 'severe' END"


@query(
    "A17_recall_by_group",
    f"""SELECT g AS "group", round(avg(CASE WHEN predicted = 'A' THEN 1.0 ELSE 0.0 END), 9)::DOUBLE AS recall, count(*) AS row_count, count(DISTINCT run_id) AS run_count,
       count(DISTINCT run_id) < 3 AS small_sample FROM (SELECT r.*, {BAND} AS g FROM rated r JOIN runs USING (run_id)) WHERE true_class = 'A' AND g IS NOT NULL GROUP BY 1""",
    ("rated", "runs"),
)
def a17(spark, sf):
    banded = wh.runs(spark, sf).select("run_id", scalar.severity_band(F.col("severity")).alias("band"))
    rows = rated(spark, sf).join(banded, "run_id")
    return r9(metrics.recall_by_group(rows, "band", "A"), "recall")


@query(
    "A18_healthy_false_positive_rate",
    """SELECT split, round(avg(CASE WHEN predicted <> 'N' THEN 1.0 ELSE 0.0 END) FILTER (true_class = 'N'), 9)::DOUBLE AS rate FROM rated GROUP BY split""",
    ("rated",),
)
def a18(spark, sf):
    return r9(rated(spark, sf).groupBy("split").agg(metrics.healthy_false_positive_rate("N").alias("rate")), "rate")


@query(
    "A19_log_loss",
    "SELECT split, round(avg(-ln(CASE true_class WHEN 'A' THEN p_A WHEN 'N' THEN p_N ELSE p_R END)), 9) AS log_loss FROM rated GROUP BY split",
    ("rated",),
)
def a19(spark, sf):
    return r9(rated(spark, sf).groupBy("split").agg(metrics.log_loss(C).alias("log_loss")), "log_loss")


@query(
    "A20_brier",
    """SELECT split, round(avg(pow(p_A - (true_class = 'A')::INT, 2) + pow(p_N - (true_class = 'N')::INT, 2) + pow(p_R - (true_class = 'R')::INT, 2)), 9) AS brier FROM rated GROUP BY split""",
    ("rated",),
)
def a20(spark, sf):
    return r9(rated(spark, sf).groupBy("split").agg(metrics.brier(C).alias("brier")), "brier")


@query(
    "A21_expected_calibration_error",
    """SELECT split, round(sum(n * abs(acc - conf)) / sum(n), 9) AS ece FROM (SELECT split, greatest(1, ceil(confidence * 10)) AS b, count(*) AS n, avg(confidence) AS conf,
       avg(CASE WHEN predicted = true_class THEN 1.0::DOUBLE ELSE 0.0 END) AS acc FROM rated GROUP BY 1, 2) GROUP BY split""",
    ("rated",),
)
def a21(spark, sf):
    return r9(metrics.expected_calibration_error(rated(spark, sf), by=["split"]), "ece")


BANDS = """CASE WHEN confidence < 0.5 THEN '[0.00, 0.50)' WHEN confidence < 0.6 THEN '[0.50, 0.60)' WHEN confidence < 0.7 THEN '[0.60, 0.70)'
  WHEN confidence < 0.8 THEN '[0.70, 0.80)' WHEN confidence < 0.9 THEN '[0.80, 0.90)' ELSE '[0.90, 1.00]' END"""


@query(
    "A22_confidence_bands",
    f"""SELECT band, sum(n)::BIGINT AS row_count, round(sum(conf) / sum(n), 9) AS mean_confidence, round(sum(ok) / sum(n), 9)::DOUBLE AS accuracy, round(avg(ok / n), 9)::DOUBLE AS balanced_accuracy
       FROM (SELECT {BANDS} AS band, true_class, count(*) AS n, sum(confidence) AS conf, count(*) FILTER (predicted = true_class)::DOUBLE AS ok FROM rated GROUP BY 1, 2) GROUP BY band""",
    ("rated",),
)
def a22(spark, sf):
    return r9(metrics.confidence_bands(rated(spark, sf)), "mean_confidence", "accuracy", "balanced_accuracy")


@query(
    "A23_class_reliability",
    """SELECT c AS class_label, count(r.run_id) AS row_count, round(coalesce(avg(confidence), 0), 9) AS mean_predicted_probability,
       round(coalesce(avg(CASE WHEN true_class = predicted THEN 1.0::DOUBLE WHEN true_class IS NOT NULL THEN 0.0 END), 0), 9) AS empirical_frequency
       FROM (VALUES ('A'), ('N'), ('R')) t(c) LEFT JOIN rated r ON r.predicted = c GROUP BY c""",
    ("rated",),
)
def a23(spark, sf):
    return r9(metrics.class_reliability(rated(spark, sf), C), "mean_predicted_probability", "empirical_frequency")


@query(
    "A24_confidence_distribution",
    "SELECT min(confidence) AS min, max(confidence) AS max, round(avg(confidence), 9) AS mean, "
    + ", ".join(f"round(quantile_cont(confidence, {q}), 9) AS p{int(q * 100)}" for q in metrics.QUANTILES)
    + " FROM rated",
    ("rated",),
)
def a24(spark, sf):
    out = metrics.confidence_distribution(rated(spark, sf))
    return r9(out, "mean", *[f"p{int(q * 100)}" for q in metrics.QUANTILES])


THRESHOLDS = (0.4, 0.45, 0.5, 0.6)
relation(
    "abstained",
    "SELECT r.*, th AS threshold, CASE WHEN confidence >= th THEN predicted ELSE 'uncertain' END AS diagnosis FROM rated r, (VALUES (0.4::DOUBLE), (0.45), (0.5), (0.6)) t(th)",
    "rated",
)


@query(
    "A25_coverage_metrics",
    """WITH base AS (SELECT threshold, avg((diagnosis <> 'uncertain')::INT) AS coverage, avg((diagnosis NOT IN ('uncertain', 'N'))::INT) FILTER (true_class = 'N') AS fp,
         avg((diagnosis = 'uncertain')::INT) FILTER (true_class = 'N') AS uh, avg((diagnosis = 'uncertain')::INT) FILTER (true_class <> 'N') AS uf,
         avg((diagnosis <> 'uncertain')::INT) FILTER (true_class = 'A') AS ra, avg((diagnosis <> 'uncertain')::INT) FILTER (true_class = 'N') AS rn, avg((diagnosis <> 'uncertain')::INT) FILTER (true_class = 'R') AS rr
         FROM abstained GROUP BY 1),
       pc AS (SELECT threshold, c, count(*) FILTER (true_class = c) AS t, count(*) FILTER (diagnosis = c) AS p, count(*) FILTER (true_class = c AND diagnosis = c) AS tp
         FROM abstained, (VALUES ('A'), ('N'), ('R')) v(c) WHERE diagnosis <> 'uncertain' GROUP BY 1, 2),
       sel AS (SELECT threshold, avg(tp / t) FILTER (t > 0) AS ba, avg(coalesce(2 * tp / nullif(t + p, 0), 0)) AS f1 FROM pc GROUP BY 1)
       SELECT threshold, round(coverage, 9) AS coverage, round(fp, 9) AS healthy_false_positive_rate, round(uh, 9) AS uncertain_rate_healthy, round(uf, 9) AS uncertain_rate_active_fault,
         round(ra, 9) AS "retained_A", round(rn, 9) AS "retained_N", round(rr, 9) AS "retained_R", round(coalesce(ba, 0), 9) AS selective_balanced_accuracy, round(coalesce(f1, 0), 9) AS selective_macro_f1
       FROM base LEFT JOIN sel USING (threshold)""",
    ("abstained",),
)
def a25(spark, sf):
    out = metrics.coverage_metrics(rated(spark, sf), THRESHOLDS, C, "N")
    return r9(out, *[c for c in out.columns if c != "threshold"])


STAGE = "CASE WHEN elapsed >= fault_start THEN CASE WHEN elapsed - fault_start < fault_duration THEN 'ramp' ELSE 'post_ramp' END END"


def staged(spark, sf):
    active = F.coalesce(F.col("elapsed") >= F.col("fault_start"), F.lit(False))
    stage = scalar.ramp_stage(active, F.col("elapsed") - F.col("fault_start"), F.col("fault_duration"))
    return evaluated(spark, sf).withColumn("stage", stage)


@query(
    "A26_uncertainty_groups",
    f"""WITH d AS (SELECT *, CASE WHEN confidence >= 0.45 THEN predicted ELSE 'uncertain' END AS diagnosis FROM diagnosed_rows),
       long AS (SELECT 'health' AS dimension, CASE WHEN true_class = 'N' THEN 'N' ELSE 'active_fault' END AS g, diagnosis, confidence FROM d
         UNION ALL SELECT 'stage', {STAGE}, diagnosis, confidence FROM d UNION ALL SELECT 'severity', {BAND}, diagnosis, confidence FROM d
         UNION ALL SELECT 'class', CASE WHEN true_class <> 'N' THEN true_class END, diagnosis, confidence FROM d)
       SELECT dimension, g AS "group", count(*) AS row_count, round(avg((diagnosis = 'uncertain')::INT), 9) AS uncertain_rate, round(avg(confidence), 9) AS mean_confidence FROM long WHERE g IS NOT NULL GROUP BY 1, 2""",
    ("diagnosed_rows",),
)
def a26(spark, sf):
    rows = staged(spark, sf).withColumn("diagnosis", metrics.diagnose(0.45))
    healthy = F.col("true_class") == "N"
    out = metrics.uncertainty_groups(
        rows,
        {
            "health": F.when(healthy, "N").otherwise("active_fault"),
            "stage": F.col("stage"),
            "severity": scalar.severity_band(F.col("severity")),
            "class": F.when(~healthy, F.col("true_class")),
        },
    )
    return r9(out, "uncertain_rate", "mean_confidence")


# "after" scores: a per-class sigmoid-like rescale, renormalised and rounded before any argmax
relation(
    "recalibrated",
    """SELECT *, CASE WHEN a_A >= a_N AND a_A >= a_R THEN 'A' WHEN a_N >= a_R THEN 'N' ELSE 'R' END AS predicted_after FROM (
       SELECT *, round(wa / (wa + wn + wr), 9) AS a_A, round(wn / (wa + wn + wr), 9) AS a_N, round(wr / (wa + wn + wr), 9) AS a_R FROM (
       SELECT *, 0.6::DOUBLE * p_A AS wa, 1.0::DOUBLE * p_N AS wn, 1.3::DOUBLE * p_R AS wr FROM rated))""",
    "rated",
)


def recalibrated(spark, sf):
    w = {"A": F.col("p_A") * 0.6, "N": F.col("p_N") * 1.0, "R": F.col("p_R") * 1.3}
    total = w["A"] + w["N"] + w["R"]
    rows = rated(spark, sf).withColumns({f"a_{c}": F.round(w[c] / total, 9) for c in C})
    return rows.withColumn("predicted_after", alerts.argmax_class(C, "a_"))


@query(
    "A27_ranking_shift",
    """SELECT array_to_string(list_transform(list_sort([{'m': -b[1], 'i': 1, 'c': 'A'}, {'m': -b[2], 'i': 2, 'c': 'N'}, {'m': -b[3], 'i': 3, 'c': 'R'}]), lambda e: e.c), '>') AS order_before,
       array_to_string(list_transform(list_sort([{'m': -a[1], 'i': 1, 'c': 'A'}, {'m': -a[2], 'i': 2, 'c': 'N'}, {'m': -a[3], 'i': 3, 'c': 'R'}]), lambda e: e.c), '>') AS order_after
       FROM (SELECT [avg(p_A), avg(p_N), avg(p_R)] AS b, [avg(a_A), avg(a_N), avg(a_R)] AS a FROM recalibrated)""",
    ("recalibrated",),
)
def a27(spark, sf):
    out = metrics.ranking_shift(recalibrated(spark, sf), C, "p_", "a_")
    return out.select(F.array_join("order_before", ">").alias("order_before"), F.array_join("order_after", ">").alias("order_after"))


@query(
    "A45_argmax_flip_rate",
    """SELECT round(avg((predicted <> predicted_after)::INT), 9) AS flip_rate, (SELECT round(avg(tp / t), 9) FROM (SELECT true_class, count(*) AS t, count(*) FILTER (predicted_after = true_class) AS tp
       FROM recalibrated GROUP BY 1)) AS balanced_accuracy_after FROM recalibrated""",
    ("recalibrated",),
)
def a45(spark, sf):
    return r9(metrics.flip_metrics(recalibrated(spark, sf), C), "flip_rate", "balanced_accuracy_after")


SHIFT_COLUMNS = ["l_quantity", "l_discount", "l_tax", "p_A", "p_N", "p_R"]
relation(
    "shift_long",
    " UNION ALL ".join(f"SELECT '{c}' AS name, {c}::DOUBLE AS v, split = 'train' AS is_train FROM scored WHERE split <> 'validation'" for c in SHIFT_COLUMNS),
    "scored",
)
relation(
    "shift",
    """WITH m AS (SELECT name, avg(v) FILTER (is_train) AS train_mean, stddev_pop(v) FILTER (is_train) AS train_std, min(v) FILTER (is_train) AS train_min, max(v) FILTER (is_train) AS train_max,
         avg(v) FILTER (NOT is_train) AS other_mean, stddev_pop(v) FILTER (NOT is_train) AS other_std FROM shift_long GROUP BY 1),
       c AS (SELECT name, v, count(*) FILTER (is_train) AS a, count(*) FILTER (NOT is_train) AS b FROM shift_long GROUP BY 1, 2),
       w AS (SELECT name, sum(abs(ca / ta - cb / tb) * (nxt - v)) AS wasserstein FROM (SELECT name, v, lead(v) OVER x AS nxt, sum(a) OVER x AS ca, sum(b) OVER x AS cb,
           sum(a) OVER (PARTITION BY name) AS ta, sum(b) OVER (PARTITION BY name) AS tb FROM c WINDOW x AS (PARTITION BY name ORDER BY v)) GROUP BY 1),
       o AS (SELECT name, avg((v < train_min OR v > train_max)::INT) AS out_of_range FROM shift_long JOIN m USING (name) WHERE NOT is_train GROUP BY 1)
       SELECT *, CASE WHEN sqrt((train_std * train_std + other_std * other_std) / 2) > 1e-9 THEN (other_mean - train_mean) / sqrt((train_std * train_std + other_std * other_std) / 2) ELSE other_mean - train_mean END AS smd
       FROM m JOIN w USING (name) JOIN o USING (name)""",
    "shift_long",
)


def shift(spark, sf):
    rows = wh.raw_scored(spark, sf)
    return metrics.feature_shift(rows.filter(F.col("split") == "train"), rows.filter(F.col("split") == "test"), SHIFT_COLUMNS)


@query(
    "A28_feature_shift",
    """SELECT name, round(smd, 8) AS smd, round(wasserstein, 8) AS wasserstein, round(train_mean, 8) AS train_mean, round(train_std, 8) AS train_std, round(other_mean, 8) AS other_mean,
       round(other_std, 8) AS other_std, train_min, train_max, round(out_of_range, 8) AS out_of_range FROM shift""",
    ("shift",),
)
def a28(spark, sf):
    out = shift(spark, sf)
    return out.withColumns({c: F.round(c, 8) for c in ("smd", "wasserstein", "train_mean", "train_std", "other_mean", "other_std", "out_of_range")})


@query(
    "T02_top_shifted_features",
    """SELECT g AS "group", name, rank::INTEGER AS rank, round(smd, 8) AS smd FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY abs(smd) DESC, name) AS rank FROM (
       SELECT *, CASE WHEN name LIKE 'p_%' THEN 'score' ELSE 'raw' END AS g FROM shift)) WHERE rank <= 2""",
    ("shift",),
)
def t02(spark, sf):
    group = F.when(F.col("name").startswith("p_"), "score").otherwise("raw")
    return metrics.top_shifted(shift(spark, sf), group, 2).select("group", "name", "rank", F.round("smd", 8).alias("smd"))


@query(
    "A29_availability_metrics",
    f"""SELECT round(avg(valid::INT), 9) AS valid_feature_coverage, round(avg((NOT valid)::INT), 9) AS insufficient_data_rate, (count(*) FILTER (NOT valid) * 10.0)::DOUBLE AS insufficient_data_seconds,
       count(DISTINCT run_id) FILTER (NOT valid) AS affected_runs, count(*) FILTER (NOT valid AND stage = 'ramp') AS rejected_ramp, count(*) FILTER (NOT valid AND stage = 'post_ramp') AS rejected_post_ramp,
       count(*) FILTER (NOT valid AND stage IS NULL) AS rejected_outside, round(avg((NOT valid)::INT) FILTER (stage = 'ramp'), 9) AS ramp_unavailable_fraction,
       round(avg((NOT valid)::INT) FILTER (stage = 'post_ramp'), 9) AS post_ramp_unavailable_fraction, count(DISTINCT run_id) FILTER (NOT valid AND stage IS NOT NULL) AS interrupted_runs
       FROM (SELECT *, {STAGE} AS stage FROM diagnosed_rows)""",
    ("diagnosed_rows",),
)
def a29(spark, sf):
    out = metrics.availability(staged(spark, sf))
    return r9(out, *[c for c in out.columns if c.endswith(("coverage", "rate", "fraction"))])


@query(
    "A29_availability_counts",
    f"""WITH r AS (SELECT *, coalesce({STAGE}, 'not_in_fault_window') AS stage FROM diagnosed_rows WHERE NOT valid)
        SELECT 'reason' AS kind, 'near_zero_denominator' AS name, count(*) AS rows FROM r HAVING count(*) > 0 UNION ALL SELECT 'class', true_class, count(*) FROM r GROUP BY 2
        UNION ALL SELECT 'stage', stage, count(*) FROM r GROUP BY 2 UNION ALL SELECT 'asset', CAST(run_id AS VARCHAR), count(*) FROM r GROUP BY 2""",
    ("diagnosed_rows",),
)
def a29c(spark, sf):
    reasons = F.when(~F.col("valid"), F.array(F.lit("near_zero_denominator"))).otherwise(F.array())
    rows = staged(spark, sf).withColumns({"reason_codes": reasons, "class_label": F.col("true_class"), "asset_id": F.col("run_id")})
    return metrics.availability_counts(rows)


@query(
    "A29_longest_gap",
    """SELECT max(n) AS longest_streak_rows, max(n) * 10.0::DOUBLE AS longest_streak_seconds FROM (SELECT count(*) AS n FROM (
       SELECT run_id, tick - row_number() OVER (PARTITION BY run_id ORDER BY tick) AS g FROM diagnosed_rows WHERE NOT valid) GROUP BY run_id, g)""",
    ("diagnosed_rows",),
)
def a29g(spark, sf):
    return metrics.longest_gap(staged(spark, sf), ["run_id"])


@query(
    "A30_rejection_counts",
    """SELECT split AS cohort, kind, name, count(*) AS rows FROM samples, (VALUES ('invalid_feature_names', 'price_per_discount'), ('reason_codes', 'near_zero_denominator')) t(kind, name)
       WHERE l_discount < 0.01 GROUP BY ALL""",
    ("samples",),
)
def a30c(spark, sf):
    from sensorloom.catalogue.c06_features import SPEC
    from sensorloom.operators.features import with_point_features

    rows = with_point_features(wh.samples(spark, sf), SPEC)
    return metrics.rejection_counts(rows.withColumnRenamed("split", "cohort"), by=["cohort"])


@query(
    "A30_rejection_summary",
    """SELECT split AS cohort, eligible_rows, rejected_rows, round(f, 9) AS rejection_fraction, affected_runs, row_number() OVER (ORDER BY f DESC, split)::INTEGER AS rank FROM (
       SELECT split, count(*) AS eligible_rows, count(*) FILTER (l_discount < 0.01) AS rejected_rows, avg((l_discount < 0.01)::INT) AS f, count(DISTINCT run_id) FILTER (l_discount < 0.01) AS affected_runs
       FROM samples GROUP BY split)""",
    ("samples",),
)
def a30(spark, sf):
    from sensorloom.catalogue.c04_alerts import RATIO
    from sensorloom.operators.features import ratio_struct

    rows = wh.raw_samples(spark, sf).withColumn("is_valid", ratio_struct(RATIO)["valid"])
    return r9(metrics.rejection_summary(rows.withColumnRenamed("split", "cohort"), ["cohort"]), "rejection_fraction")


@query(
    "A39_clamp_stats",
    """SELECT count(*) AS rows, count(*) FILTER (l_discount >= 0.1 - 1e-4) AS clamped, round_even(100.0::DOUBLE * count(*) FILTER (l_discount >= 0.1 - 1e-4) / count(*), 3) AS clamped_percentage,
       round(var_pop(l_discount), 9) AS variance, round(stddev_pop(l_discount), 9) AS stdev, count(DISTINCT round_even(l_discount, 4)) AS unique_values, min(l_discount) AS min, max(l_discount) AS max FROM samples""",
    ("samples",),
)
def a39(spark, sf):
    return r9(wh.raw_samples(spark, sf).agg(*metrics.clamp_stats("l_discount", 0.1)), "variance", "stdev")


@query(
    "A40_bootstrap_by_run",
    """WITH tally AS (SELECT run_id, row_number() OVER (ORDER BY run_id) AS slot, count(*) FILTER (true_class = 'A' AND predicted = 'A') AS tpa, count(*) FILTER (true_class = 'N' AND predicted = 'N') AS tpn,
         count(*) FILTER (true_class = 'R' AND predicted = 'R') AS tpr, count(*) FILTER (true_class = 'A') AS ta, count(*) FILTER (true_class = 'N') AS tn, count(*) FILTER (true_class = 'R') AS tr FROM rated GROUP BY run_id),
       n AS (SELECT count(*) AS n FROM tally),
       drawn AS (SELECT DISTINCT r AS resample, ('0x' || substr(md5('42:' || r || ':' || slot), 1, 8))::BIGINT % n + 1 AS slot FROM tally, n, range(0, 300) t(r)),
       scores AS (SELECT resample, (sum(tpa) / sum(ta) + sum(tpn) / sum(tn) + sum(tpr) / sum(tr)) / 3 AS score FROM drawn JOIN tally USING (slot) GROUP BY 1)
       SELECT (SELECT round((sum(tpa) / sum(ta) + sum(tpn) / sum(tn) + sum(tpr) / sum(tr)) / 3, 9) FROM tally) AS point_estimate, round(quantile_cont(score, 0.05), 9) AS lower, round(quantile_cont(score, 0.95), 9) AS upper,
         count(*) AS n_resamples, (SELECT n FROM n) AS n_runs FROM scores""",
    ("rated",),
)
def a40(spark, sf):
    return r9(metrics.bootstrap_by_run(rated(spark, sf), C), "point_estimate", "lower", "upper")


@query(
    "A41_stratified_split",
    """WITH s AS (SELECT c_custkey AS run_id, c_mktsegment AS class_label, c_nationkey AS asset_id, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey
           ORDER BY md5('ds:' || c_mktsegment || ':' || c_nationkey || ':' || c_custkey), c_custkey) AS pos, count(*) OVER (PARTITION BY c_mktsegment, c_nationkey) AS n FROM customer),
       b AS (SELECT *, 0.6::DOUBLE * n AS r1, 0.2::DOUBLE * n AS r2, 0.2::DOUBLE * n AS r3 FROM s),
       f AS (SELECT *, floor(r1)::INT AS b1, floor(r2)::INT AS b2, floor(r3)::INT AS b3 FROM b),
       l AS (SELECT *, list_transform(list_sort([{'f': b1 - r1, 'i': 0}, {'f': b2 - r2, 'i': 1}, {'f': b3 - r3, 'i': 2}])[1:n - b1 - b2 - b3], lambda e: e.i) AS lucky FROM f),
       c0 AS (SELECT *, [b1 + list_contains(lucky, 0)::INT, b2 + list_contains(lucky, 1)::INT, b3 + list_contains(lucky, 2)::INT] AS c FROM l),
       c1 AS (SELECT * REPLACE (CASE WHEN n >= 3 AND c[1] = 0 AND list_max(c) > 1 THEN list_transform([1, 2, 3], lambda j: c[j] + (j = 1)::INT - (j = list_position(c, list_max(c)))::INT) ELSE c END AS c) FROM c0),
       c2 AS (SELECT * REPLACE (CASE WHEN n >= 3 AND c[2] = 0 AND list_max(c) > 1 THEN list_transform([1, 2, 3], lambda j: c[j] + (j = 2)::INT - (j = list_position(c, list_max(c)))::INT) ELSE c END AS c) FROM c1),
       c3 AS (SELECT * REPLACE (CASE WHEN n >= 3 AND c[3] = 0 AND list_max(c) > 1 THEN list_transform([1, 2, 3], lambda j: c[j] + (j = 3)::INT - (j = list_position(c, list_max(c)))::INT) ELSE c END AS c) FROM c2)
       SELECT run_id, class_label, asset_id, CASE WHEN pos <= c[1] THEN 'train' WHEN pos <= c[1] + c[2] THEN 'validation' ELSE 'test' END AS split FROM c3""",
)
def a41(spark, sf):
    runs = wh.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("run_id"), F.col("c_mktsegment").alias("class_label"), F.col("c_nationkey").alias("asset_id")
    )
    return metrics.stratified_split(runs, ["class_label", "asset_id"], (0.6, 0.2, 0.2), "ds")


@query(
    "A47_onset_to_confirmation",
    """SELECT asset_id, ((min(idx) - 12) * 10.0)::DOUBLE AS seconds FROM (SELECT asset_id, measurement_type, row_number() OVER (PARTITION BY asset_id ORDER BY timestamp, id) AS idx FROM obs)
       WHERE measurement_type = 'error' AND idx >= 12 GROUP BY asset_id""",
    ("obs",),
)
def a47(spark, sf):
    obs = wh.observations(spark, sf)
    indexed = series.with_position(obs, ["asset_id"], ["timestamp", "id"], F.to_date("timestamp"), name="idx")
    confirmed = indexed.filter((F.col("measurement_type") == "error") & (F.col("idx") >= 12))
    return confirmed.groupBy("asset_id").agg(((F.min("idx") - 12) * F.lit(10.0)).alias("seconds"))


@query(
    "A48_onset_aligned_medians",
    """SELECT fault_class, "offset", round(quantile_cont(l_quantity, 0.5), 6) AS median FROM (SELECT fault_class, l_quantity, (round_even((elapsed - fault_start) / 10.0, 0) * 10)::DOUBLE AS "offset"
       FROM diagnosed_rows WHERE elapsed - fault_start >= -60 AND elapsed - fault_start <= fault_duration + 30) GROUP BY 1, 2""",
    ("diagnosed_rows",),
)
def a48(spark, sf):
    offset = F.col("elapsed") - F.col("fault_start")
    rows = evaluated(spark, sf).filter((offset >= -60) & (offset <= F.col("fault_duration") + 30)).withColumn(
        "offset", F.bround(offset / 10.0) * 10.0
    )
    return series.exact_median(rows, ["fault_class", "offset"], "l_quantity", "median").withColumn("median", F.round("median", 6))


@query(
    "A49_histogram",
    """SELECT fault_class, (floor(l_extendedprice / 5000.0) * 5000.0)::DOUBLE AS bin_start, count(*) AS rows FROM diagnosed_rows GROUP BY 1, 2""",
    ("diagnosed_rows",),
)
def a49(spark, sf):
    labels = wh.runs(spark, sf).select("run_id", F.col("class_label").alias("fault_class"))
    return metrics.histogram(wh.raw_samples(spark, sf).join(labels, "run_id"), ["fault_class"], "l_extendedprice", 5_000.0)


@query(
    "A49_episode_duration_histogram",
    """SELECT (floor(("end" - start) / 10.0) * 10.0)::DOUBLE AS bin_start, count(*) AS rows FROM episodes GROUP BY 1""",
    ("episodes",),
)
def a49e(spark, sf):
    out = folded(spark, sf)
    found = alerts.episodes(healthy_events(alerts.events_of(out), spark, sf), alerts.segments_of(out, ["run_id"]), ["run_id"])
    return metrics.histogram(found.withColumn("duration", F.col("end") - F.col("start")), [], "duration", 10.0)


@query(
    "A50_step_residuals",
    """SELECT (floor(d / 5.0) * 5.0)::DOUBLE AS bin_start, count(*) AS rows FROM (SELECT l_quantity - lag(l_quantity) OVER (PARTITION BY run_id ORDER BY tick) AS d FROM diagnosed_rows WHERE fault_class = 'normal') WHERE d IS NOT NULL GROUP BY 1""",
    ("diagnosed_rows",),
)
def a50(spark, sf):
    rows = evaluated(spark, sf).filter(F.col("fault_class") == "normal")
    steps = series.lagged(rows, ["run_id"], {"step": lambda w: F.col("l_quantity") - F.lag("l_quantity").over(w)}, pos="tick")
    return metrics.histogram(steps, [], "step", 5.0)


@query(
    "X14_argmax_runner_up",
    """SELECT run_id, l_orderkey, l_linenumber, l_partkey, l_quantity, predicted, CASE predicted WHEN 'A' THEN CASE WHEN p_N >= p_R THEN 'N' ELSE 'R' END WHEN 'N' THEN CASE WHEN p_A >= p_R THEN 'A' ELSE 'R' END
       ELSE CASE WHEN p_A >= p_N THEN 'A' ELSE 'N' END END AS runner_up FROM rated""",
    ("rated",),
)
def x14(spark, sf):
    ranked = F.array_sort(F.array(*[F.struct((-F.col(f"p_{c}")).alias("s"), F.lit(c).alias("c")) for c in C]))
    return rated(spark, sf).select(
        "run_id", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "predicted", F.element_at(ranked, 2)["c"].alias("runner_up")
    )


@query("X15_severity_band", f"SELECT run_id, severity, {BAND} AS band FROM runs", ("runs",))
def x15(spark, sf):
    return wh.runs(spark, sf).select("run_id", "severity", scalar.severity_band(F.col("severity")).alias("band"))


@query(
    "X16_audit_severity_band",
    "SELECT run_id, CASE WHEN severity >= 0 AND severity < 0.4 THEN 'low' WHEN severity >= 0.4 AND severity < 0.7 THEN 'mid' WHEN severity >= 0.7 AND severity < 1.0001 THEN 'high' END AS band FROM runs",
    ("runs",),
)
def x16(spark, sf):
    return wh.runs(spark, sf).select("run_id", scalar.audit_severity_band(F.col("severity")).alias("band"))


@query("X17_ramp_stage", f"SELECT run_id, tick, {STAGE} AS stage FROM diagnosed_rows", ("diagnosed_rows",))
def x17(spark, sf):
    return staged(spark, sf).select("run_id", "tick", "stage")


@query(
    "X20_diagnose",
    "SELECT CASE WHEN confidence >= 0.45 THEN predicted ELSE 'uncertain' END AS diagnosis, true_class, count(*) AS rows FROM rated GROUP BY 1, 2",
    ("rated",),
)
def x20(spark, sf):
    return rated(spark, sf).groupBy(metrics.diagnose(0.45).alias("diagnosis"), "true_class").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "X24_relative_change",
    """SELECT o_orderkey, CASE WHEN abs(prev) >= 1e-12 THEN round((o_totalprice - prev) / abs(prev), 9) END AS change FROM (
       SELECT o_orderkey, o_totalprice, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev FROM orders)""",
)
def x24(spark, sf):
    orders = wh.table(spark, sf, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    placed = series.with_position(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], F.to_date("o_orderdate"))
    out = series.lagged(placed, ["o_custkey"], {"prev": lambda w: F.lag("o_totalprice").over(w)})
    return out.select("o_orderkey", F.round(scalar.relative_change(F.col("prev"), F.col("o_totalprice")), 9).alias("change"))
