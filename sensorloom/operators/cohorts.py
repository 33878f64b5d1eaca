"""Decisions over cohort metrics: comparison, shift tiers, interaction and promotion."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.functions.scalar import relative_change


# Acceptance bands and decision names.
@dataclass(frozen=True)
class Bands:
    accuracy_drop_acceptable: float = 0.10
    accuracy_floor: float = 0.40
    recall_floor: float = 0.20
    alert_rate_acceptable: float = 1.0
    alert_rate_excessive: float = 5.0
    missed_acceptable: float = 0.25
    missed_excessive: float = 0.50
    minor_drop: float = 0.05
    moderate_drop: float = 0.15
    minor_alert_rate: float = 0.5
    invalid_rows_material: float = 0.02
    interaction_tolerance: float = 1.15


@dataclass(frozen=True)
class Promotion:
    max_pilot_drop: float = 0.03
    max_pilot_alert_rate: float = 1.0
    min_noise_gain: float = 0.02
    max_noise_alert_rate: float = 1.0
    min_combined_gain: float = 0.02
    recall_floor: float = 0.20
    max_missed_regression: int = 1


OOD_VERDICTS = (
    "DOES NOT GENERALIZE — MODEL OR FEATURE REVISION REQUIRED",
    "GENERALIZES ACCEPTABLY TO OOD V1",
    "GENERALIZES WITH MATERIAL DEGRADATION",
)
TIERS = {"minor": 0, "moderate": 1, "major": 2, "catastrophic": 3}
MODEL_DECISIONS = {
    "regression": "KEEP ORIGINAL MODEL — ID REGRESSION TOO LARGE",
    "collapse": "NO MODEL READY — FURTHER FEATURE/DATA REVISION REQUIRED",
    "insufficient": "KEEP ORIGINAL MODEL — ROBUSTNESS GAINS INSUFFICIENT",
    "promote": "PROMOTE ROBUST MODEL",
}
NO_SURVIVOR = (
    "no candidate policy in the search grid survived the validation rejection rule (zero any-fault misses, at most one correct-class miss,"
    " bounded latency degradation) — see robust_policy_search.json"
)
POLICY_DECISIONS = {
    "regression": "KEEP ORIGINAL MODEL — ID OPERATIONAL REGRESSION",
    "collapse": "NO SYSTEM MEETS PROMOTION CRITERIA",
    "insufficient": "KEEP ORIGINAL MODEL — ALERT POLICY INSUFFICIENT",
    "promote": "PROMOTE ROBUST MODEL AND POLICY",
}
RECOMMENDATIONS = {
    "A": "Numerically harden existing features first — the invalid/null row-ratio behavior is materially important in at"
    " least one cohort.",
    "B": "Add load-conditioned and training-fitted healthy residual features — the high-load shift dominates without major"
    " numerical failures elsewhere.",
    "C": "Broaden training-distribution coverage first — no single isolated shift's failure mode is decisive enough on its"
    " own to justify a targeted feature or architecture change; see `recommendation_reasons` for this study's specific"
    " trigger.",
    "D": "Reconsider the current model/feature architecture — failures are broad and severe even for modest isolated shifts.",
}
RANKED = (
    "balanced_accuracy_drop", "macro_f1_drop", "healthy_fp_increase", "false_alert_rate", "any_fault_missed", "median_latency",
)


def metric_long(wide: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return wide.select(*keys, F.explode(entries).alias("_e")).select(*keys, "_e.*")


def compare(base: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Metric-by-metric change; missing values on either side give null changes."""
    keys = [*keys, "metric"]
    joined = base.withColumnRenamed("value", "base_value").join(other.withColumnRenamed("value", "other_value"), keys, "full_outer")
    return joined.withColumn("absolute_change", F.col("other_value") - F.col("base_value")).withColumn(
        "relative_change", relative_change(F.col("base_value"), F.col("other_value"))
    )


def damage(cohorts: DataFrame, baseline: str, bands: Bands = Bands()) -> DataFrame:
    """Drops of every cohort against the baseline cohort, and its tier.

    ``cohorts`` has one row per cohort with balanced_accuracy, macro_f1, healthy_fp,
    min_recall, false_alert_rate, any_fault_missed, max_missed_fraction, median_latency.
    """
    base = cohorts.filter(F.col("cohort") == baseline).select(
        F.col("balanced_accuracy").alias("_ba"), F.col("macro_f1").alias("_f1"), F.col("healthy_fp").alias("_fp")
    )
    out = cohorts.crossJoin(base).withColumns(  # one baseline row
        {
            "balanced_accuracy_drop": F.col("_ba") - F.col("balanced_accuracy"),
            "macro_f1_drop": F.col("_f1") - F.col("macro_f1"),
            "healthy_fp_increase": F.col("healthy_fp") - F.col("_fp"),
        }
    ).drop("_ba", "_f1", "_fp")
    return out.withColumn("tier", tier(bands))


def tier(b: Bands) -> Column:
    drop, missed = F.col("balanced_accuracy_drop"), F.coalesce("max_missed_fraction", F.lit(0.0))
    rate = F.coalesce("false_alert_rate", F.lit(0.0))  # a cohort without healthy hours has no false alerts
    catastrophic = (
        (F.col("min_recall") <= b.recall_floor)
        | (missed > b.missed_excessive)
        | (rate > b.alert_rate_excessive)
        | (F.col("balanced_accuracy") <= b.accuracy_floor)
    )
    major = (drop > b.moderate_drop) | (rate > b.alert_rate_acceptable) | (missed > b.missed_acceptable)
    calm = (rate <= b.minor_alert_rate) & (missed == 0.0)
    return (
        F.when(catastrophic, "catastrophic")
        .when(major, "major")
        .when(drop > b.minor_drop, "moderate")
        .when(calm, "minor")
        .otherwise("moderate")
    )


def tier_rank(column: Column) -> Column:
    return F.coalesce(*[F.when(column == t, r) for t, r in TIERS.items()])


def ood_verdict(damaged: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """Verdict and reason codes per cohort."""
    b = bands
    rate, missed = F.coalesce("false_alert_rate", F.lit(0.0)), F.coalesce("max_missed_fraction", F.lit(0.0))
    reasons = F.array_compact(
        F.array(
            F.when(F.col("min_recall") <= b.recall_floor, "class_recall_collapse"),
            F.when(missed > b.missed_excessive, "missed_runs_excessive"),
            F.when(rate > b.alert_rate_excessive, "false_alert_rate_excessive"),
            F.when(F.col("balanced_accuracy") <= b.accuracy_floor, "balanced_accuracy_collapse"),
        )
    )
    acceptable = (
        (F.col("balanced_accuracy_drop") <= b.accuracy_drop_acceptable) & (rate <= b.alert_rate_acceptable) & (missed <= b.missed_acceptable)
    )
    return damaged.withColumn("reasons", reasons).withColumn(
        "verdict",
        F.when(F.size("reasons") > 0, OOD_VERDICTS[0]).when(F.coalesce(acceptable, F.lit(False)), OOD_VERDICTS[1]).otherwise(OOD_VERDICTS[2]),
    )


def rank_shifts(damaged: DataFrame, metrics: Sequence[str] = RANKED) -> DataFrame:
    """Worst-first position of every cohort per metric; nulls last, names break ties."""
    long = metric_long(damaged, ["cohort"], metrics)
    order = Window.partitionBy("metric").orderBy(F.desc_nulls_last("value"), F.asc("cohort"))
    return long.withColumn("rank", F.row_number().over(order))


def study_verdict(isolated: DataFrame, invalid: DataFrame, bands: Bands = Bands(), high_load: str = "high_load") -> DataFrame:
    """Primary and secondary failure, and recommendation A–D, from isolated-shift damages.

    ``invalid`` holds each cohort's rejection_fraction. Both tables have one row per cohort.
    """
    ranked = isolated.withColumn("_t", tier_rank(F.col("tier")))
    order = F.struct((-F.col("_t")).alias("a"), (-F.col("balanced_accuracy_drop")).alias("b"), F.col("cohort").alias("c"), F.col("_t").alias("t"))
    summary = ranked.agg(
        F.slice(F.array_sort(F.collect_list(order)), 1, 2).alias("_top"),
        F.count(F.lit(1)).alias("_n"),
        F.count_if(F.col("_t") >= TIERS["major"]).alias("_major"),
        F.count_if((F.col("_t") >= TIERS["major"]) & (F.col("cohort") == high_load)).alias("_load_major"),
        F.count_if(F.col("_t") == TIERS["moderate"]).alias("_moderate"),
    )
    worst = invalid.agg(F.max("rejection_fraction").alias("_invalid"))
    both = summary.crossJoin(worst)  # one row each
    choice = (
        F.when(F.col("_invalid") > bands.invalid_rows_material, "A")
        .when(F.col("_major") >= 3, "D")
        .when((F.col("_load_major") == 1) & (F.col("_major") == 1), "B")
        .otherwise("C")
    )
    second = F.get("_top", F.lit(1))
    out = both.select(
        F.get("_top", F.lit(0))["c"].alias("primary_failure"),
        F.when(second["t"] >= TIERS["moderate"], second["c"]).alias("secondary_failure"),
        choice.alias("recommendation"),
    )
    return out.withColumn(
        "recommendation_description", F.coalesce(*[F.when(F.col("recommendation") == k, F.lit(v)) for k, v in RECOMMENDATIONS.items()])
    )


def interaction(damaged: DataFrame, combined: str, isolated: Sequence[str], bands: Bands = Bands()) -> DataFrame:
    """Is the combined drop explained by the worst single shift, additive, or worse?"""
    drop = F.col("balanced_accuracy_drop")
    single = F.col("cohort").isin(*isolated)
    of = lambda name, column: F.max(F.when(F.col("cohort") == name, F.col(column)))
    summary = damaged.agg(
        F.max(F.when(F.col("cohort") == combined, drop)).alias("combined_drop"),
        F.max(F.when(single, F.struct(drop.alias("d"), F.col("cohort").alias("c")))).alias("_worst"),
        F.coalesce(F.sum(F.when(single, drop)), F.lit(0.0)).alias("sum_drop"),
        of(combined, "false_alert_rate").alias("_rate"),
        of("high_load", "false_alert_rate").alias("_load_rate"),
        of("high_noise", "false_alert_rate").alias("_noise_rate"),
        of(combined, "balanced_accuracy").alias("_ba"),
        of("high_load", "balanced_accuracy").alias("_load_ba"),
        of("high_noise", "balanced_accuracy").alias("_noise_ba"),
    )
    out = summary.select(
        "*", F.col("_worst.c").alias("worst_shift"), F.col("_worst.d").alias("worst_drop")
    )
    unknown = F.col("combined_drop").isNull() | F.col("worst_drop").isNull() | (F.col("worst_drop") <= 0)
    likelihood = (
        F.when(unknown, "uncertain")
        .when(F.col("combined_drop") <= F.col("worst_drop") * bands.interaction_tolerance, "no")
        .when(F.col("combined_drop") < F.col("sum_drop"), "uncertain")
        .otherwise("yes")
    )
    dominant = F.greatest("_load_rate", "_noise_rate")
    ratio = F.when(dominant > 0, F.col("_rate") / dominant)
    tracks = F.coalesce(ratio.between(0.7, 1.3), F.lit(False))
    name = F.when(F.col("_noise_rate") >= F.col("_load_rate"), "high_noise").otherwise("high_load")
    rate_note = F.when(
        tracks,
        F.format_string(
            "combined false-alert rate (%.2f/hr) tracks %s's isolated rate (%.2f/hr) closely", F.col("_rate"), name, dominant
        ),
    ).otherwise(
        F.format_string(
            "combined false-alert rate (%.2f/hr) is well above either isolated rate alone (high_load: %.2f/hr, high_noise: %.2f/hr)",
            F.col("_rate"), F.col("_load_rate"), F.col("_noise_rate"),
        )
    )
    lower = F.col("_ba") < F.least("_load_ba", "_noise_ba")
    accuracy_note = F.when(
        lower,
        F.format_string(
            "combined balanced accuracy (%.3f) is lower than either isolated shift alone (high_load: %.3f, high_noise: %.3f)",
            F.col("_ba"), F.col("_load_ba"), F.col("_noise_ba"),
        ),
    ).otherwise(
        F.format_string("combined balanced accuracy (%.3f) is not lower than the worse of the two isolated shifts alone", F.col("_ba"))
    )
    known = F.col("_rate").isNotNull() & F.col("_load_rate").isNotNull() & F.col("_noise_rate").isNotNull()
    note = F.when(known, F.concat(rate_note, F.lit("; "), accuracy_note, F.lit("."))).otherwise(
        "high_load and/or high_noise cohorts not supplied — compounding cannot be assessed."
    )
    return out.select(
        "combined_drop", "worst_shift", "worst_drop", "sum_drop", likelihood.alias("interaction_likely"), note.alias("load_noise_note")
    )


def late_onset_note(recalls: DataFrame) -> DataFrame:
    """Does late onset merely shorten the post-ramp part? ``recalls``: stage, recall."""
    means = recalls.agg(
        F.avg(F.when(F.col("stage") == "ramp", F.col("recall"))).alias("ramp"),
        F.avg(F.when(F.col("stage") == "post_ramp", F.col("recall"))).alias("post_ramp"),
    )
    gap = F.col("post_ramp") - F.col("ramp")
    code = F.when(gap.isNull(), "no_breakdown").when(gap > 0.15, "shorter_window").otherwise("beyond_window")
    return means.select("ramp", "post_ramp", code.alias("late_onset"))


def hot_start_note(per_class: DataFrame, confusion: DataFrame, healthy: str, suspect: str) -> DataFrame:
    """Is healthy data mistaken for ``suspect`` above all, with the lowest precision there?"""
    top = confusion.filter((F.col("true_class") == healthy) & (F.col("predicted") != healthy)).agg(
        F.max(F.struct("rows", "predicted")).alias("_t")
    )
    low = per_class.filter(F.col("class_label") != healthy).agg(F.min(F.struct("precision", "class_label")).alias("_p"))
    both = top.crossJoin(low)  # one row each
    return both.select(
        F.col("_t.predicted").alias("top_target"),
        F.col("_t.rows").alias("top_rows"),
        F.col("_p.class_label").alias("lowest_precision_class"),
        ((F.col("_t.predicted") == suspect) & (F.col("_p.class_label") == suspect)).alias("specific_confusion"),
    )


def policy_promotion(search: DataFrame, comparison: DataFrame, rules: Promotion = Promotion(), names=("pilot", "high_noise", "combined_ood_v1")) -> DataFrame:
    """The decision on a searched policy, with its reason: where no candidate survived, nothing is compared and the policy is kept.

    ``search`` has a row per candidate with ``rejection`` (null: survived); ``comparison`` as for :func:`promotion`.
    """
    survivors = search.agg(F.count_if(F.col("rejection").isNull()).alias("survivors"), F.count(F.lit(1)).alias("candidates"))
    out = promotion(comparison, rules, names, POLICY_DECISIONS).crossJoin(survivors)  # one row each
    none = F.col("survivors") == 0
    return out.select(
        "candidates", "survivors", F.when(none, POLICY_DECISIONS["insufficient"]).otherwise(F.col("decision")).alias("decision"),
        F.when(none, NO_SURVIVOR).alias("reason"),
    )


def promotion(
    comparison: DataFrame, rules: Promotion = Promotion(), names=("pilot", "high_noise", "combined_ood_v1"), decisions=MODEL_DECISIONS
) -> DataFrame:
    """Ordered gates over one row per cohort with original and robust figures.

    Columns: cohort, ba_original, ba_robust, rate_robust, min_recall_robust, missed_original,
    missed_robust. A missing required cohort fails the query; a missing figure counts as no change and no alerts,
    which is no gain.
    """
    pilot, noise, combined = names
    of = lambda name, c: F.coalesce(F.max(F.when(F.col("cohort") == name, c)), F.lit(0.0))
    gain = F.col("ba_robust") - F.col("ba_original")
    one = comparison.agg(
        F.count_if(F.col("cohort").isin(*names)).alias("_required"),
        of(pilot, -gain).alias("pilot_drop"),
        of(pilot, F.col("rate_robust")).alias("pilot_rate"),
        of(noise, gain).alias("noise_gain"),
        of(noise, F.col("rate_robust")).alias("noise_rate"),
        of(combined, gain).alias("combined_gain"),
        F.count_if(F.col("min_recall_robust") <= rules.recall_floor).alias("collapsed"),
        F.count_if(F.col("missed_robust") - F.col("missed_original") > rules.max_missed_regression).alias("missed_regressions"),
    )
    regression = (F.col("pilot_drop") > rules.max_pilot_drop) | (F.col("pilot_rate") > rules.max_pilot_alert_rate)
    weak = (
        (F.col("noise_gain") < rules.min_noise_gain)
        | (F.col("combined_gain") < rules.min_combined_gain)
        | (F.col("noise_rate") > rules.max_noise_alert_rate)
        | (F.col("missed_regressions") > 0)
    )
    decision = (
        F.when(F.col("_required") < len(names), F.raise_error(F.lit("a required cohort is missing")))
        .when(regression, decisions["regression"])
        .when(F.col("collapsed") > 0, decisions["collapse"])
        .when(weak, decisions["insufficient"])
        .otherwise(decisions["promote"])
    )
    return one.withColumn("decision", decision).drop("_required")
