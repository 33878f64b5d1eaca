"""Latency, throughput, classification, calibration and shift metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.operators import series


def nearest_rank_summary(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Count, excluded (null) count, max and nearest-rank p50/p95; ranks round half to even.

    Ranks come from cumulative counts inside value bins, so a group is never sorted in one task.
    """
    keys = list(keys)
    base = rows.groupBy(*keys).agg(
        F.count(value).alias("count"), F.count_if(F.col(value).isNull()).alias("excluded_count"), F.max(value).alias("max_ms")
    )
    picked = rank_lookup(
        rows, keys, value,
        {"median_ms": lambda n: F.bround(F.lit(0.5) * (n - 1)), "p95_ms": lambda n: F.bround(F.lit(0.95) * (n - 1))},
    )
    return base.join(picked, keys, "left")


def rank_lookup(rows: DataFrame, keys: Sequence[str], value: str, ranks: dict) -> DataFrame:
    """Exact value at given 0-based ranks per group; ``ranks`` maps a name to f(group size)."""
    ranked = series.cumulative_by_value(rows, keys, value, {"n": F.lit(1).cast("long")})
    first, last = F.col("cum_n") - F.col("n"), F.col("cum_n") - 1
    pick = lambda f: F.max(F.when(f(F.col("total_n")).between(first, last), F.col("_v")))
    return ranked.groupBy(*keys).agg(*[pick(f).alias(name) for name, f in ranks.items()])


def steady_state_start(rows: DataFrame, samples: int = 12, key: str = "asset_id", time: str = "timestamp") -> DataFrame:
    """Latest over all assets of each asset's n-th sample time; null when any asset has fewer.

    ``row_number <= n`` prunes to n rows per asset before the shuffle.
    """
    oldest = Window.partitionBy(key).orderBy(time, "id")
    head = rows.withColumn("_rk", F.row_number().over(oldest)).filter(F.col("_rk") <= samples)
    per_asset = head.groupBy(key).agg(F.max("_rk").alias("_n"), F.max(time).alias("_t"))
    return per_asset.agg(F.when(F.min("_n") == samples, F.max("_t")).alias("steady_state_start"))


def repeated_runs(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Count, median, range and average of a metric."""
    base = rows.groupBy(key).agg(
        F.count(value).alias("run_count"), F.min(value).alias("minimum"), F.max(value).alias("maximum"), F.avg(value).alias("average")
    )
    return base.join(series.exact_median(rows, [key], value, "median"), key)


def queue_growth(ingest_per_second: Column, drain_per_second: Column) -> Column:
    """Net queue growth per minute."""
    return (ingest_per_second - drain_per_second) * 60


# --- classification ---------------------------------------------------------


def per_class_metrics(
    rows: DataFrame, classes: Sequence[str], by: Sequence[str] = (), truth: str = "true_class", predicted: str = "predicted"
) -> DataFrame:
    """Precision, recall, F1 and support of every class in the fixed order (0 where undefined).

    One aggregation with 3 conditional counts per class; classes absent from the data keep a row.
    """
    t, p = F.col(truth), F.col(predicted)
    counts = rows.groupBy(*by).agg(
        *[F.count_if((t == c) & (p == c)).alias(f"_tp_{i}") for i, c in enumerate(classes)],
        *[F.count_if(t == c).alias(f"_t_{i}") for i, c in enumerate(classes)],
        *[F.count_if(p == c).alias(f"_p_{i}") for i, c in enumerate(classes)],
    )
    entry = lambda i, c: F.struct(
        F.lit(i).alias("class_no"), F.lit(c).alias("class_label"), F.col(f"_tp_{i}").alias("tp"),
        F.col(f"_t_{i}").alias("support"), F.col(f"_p_{i}").alias("predicted_rows"),
    )
    long = counts.select(*by, F.explode(F.array(*[entry(i, c) for i, c in enumerate(classes)])).alias("_e")).select(*by, "_e.*")
    share = lambda d: F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col(d)), F.lit(0.0))
    out = long.withColumn("precision", share("predicted_rows")).withColumn("recall", share("support"))
    f1 = F.coalesce(F.try_divide(F.lit(2.0) * F.col("tp"), F.col("support") + F.col("predicted_rows")), F.lit(0.0))
    return out.withColumn("f1", f1)


def overall_metrics(per_class: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Balanced accuracy over classes that occur, macro averages over all classes."""
    return per_class.groupBy(*by).agg(
        F.coalesce(F.avg(F.when(F.col("support") > 0, F.col("recall"))), F.lit(0.0)).alias("balanced_accuracy"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
        F.sum("support").alias("rows"),
    )


def confusion(rows: DataFrame, classes: Sequence[str], truth: str = "true_class", predicted: str = "predicted") -> DataFrame:
    """Every (true, predicted) cell of the fixed class order."""
    cells = [
        F.struct(
            F.lit(t).alias("true_class"), F.lit(p).alias("predicted"), F.col(f"_c_{i}_{j}").alias("rows")
        )
        for i, t in enumerate(classes)
        for j, p in enumerate(classes)
    ]
    counts = rows.agg(
        *[
            F.count_if((F.col(truth) == t) & (F.col(predicted) == p)).alias(f"_c_{i}_{j}")
            for i, t in enumerate(classes)
            for j, p in enumerate(classes)
        ]
    )
    return counts.select(F.explode(F.array(*cells)).alias("_e")).select("_e.*")


def recall_by_group(rows: DataFrame, group: str, target: str, truth: str = "true_class", predicted: str = "predicted") -> DataFrame:
    """Row recall of one class per group, with run count and small-sample flag."""
    hit = (F.col(predicted) == target).cast("double")
    return (
        rows.filter((F.col(truth) == target) & F.col(group).isNotNull())
        .groupBy(F.col(group).alias("group"))
        .agg(F.avg(hit).alias("recall"), F.count(F.lit(1)).alias("row_count"), F.count_distinct("run_id").alias("run_count"))
        .withColumn("small_sample", F.col("run_count") < 3)
    )


def healthy_false_positive_rate(healthy: str, truth: str = "true_class", predicted: str = "predicted") -> Column:
    """Aggregate: share of healthy rows predicted otherwise."""
    return F.coalesce(F.avg(F.when(F.col(truth) == healthy, (F.col(predicted) != healthy).cast("double"))), F.lit(0.0))


# --- calibration --------------------------------------------------------------


def probability_of(label: Column, classes: Sequence[str], prefix: str = "p_") -> Column:
    return F.coalesce(*[F.when(label == c, F.col(prefix + c)) for c in classes])


def log_loss(classes: Sequence[str], truth: str = "true_class", prefix: str = "p_") -> Column:
    """Aggregate: mean negative log probability of the true class."""
    p = probability_of(F.col(truth), classes, prefix)
    eps = 2.220446049250313e-16
    return F.avg(-F.log(F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))))


def brier(classes: Sequence[str], truth: str = "true_class", prefix: str = "p_") -> Column:
    """Aggregate: mean squared distance between the scores and the one-hot truth."""
    parts = [F.pow(F.col(prefix + c) - (F.col(truth) == c).cast("double"), F.lit(2)) for c in classes]
    return F.avg(sum(parts[1:], parts[0]))


def expected_calibration_error(rows: DataFrame, bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Top-label calibration error over bins (lo, hi], the first one closed below."""
    bin_no = F.greatest(F.lit(1), F.ceil(F.col("confidence") * bins)).cast("int")
    per_bin = rows.groupBy(*by, bin_no.alias("_bin")).agg(
        F.avg("confidence").alias("_conf"),
        F.avg((F.col("predicted") == F.col("true_class")).cast("double")).alias("_acc"),
        F.count(F.lit(1)).alias("_n"),
    )
    return per_bin.groupBy(*by).agg((F.sum(F.col("_n") * F.abs(F.col("_acc") - F.col("_conf"))) / F.sum("_n")).alias("ece"))


# Confidence bands [lo, hi), the last one closed.
CONFIDENCE_BANDS = ((0.0, 0.5), (0.5, 0.6), (0.6, 0.7), (0.7, 0.8), (0.8, 0.9), (0.9, 1.0 + 1e-9))


def band_label(confidence: Column) -> Column:
    label = lambda lo, hi: f"[{lo:.2f}, {hi:.2f})" if hi <= 1.0 else f"[{lo:.2f}, 1.00]"
    return F.coalesce(*[F.when((confidence >= lo) & (confidence < hi), F.lit(label(lo, hi))) for lo, hi in CONFIDENCE_BANDS])


def confidence_bands(rows: DataFrame) -> DataFrame:
    """Rows, mean confidence, accuracy and balanced accuracy per band that occurs."""
    right = (F.col("predicted") == F.col("true_class")).cast("double")
    per_class = rows.groupBy(band_label(F.col("confidence")).alias("band"), "true_class").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("confidence").alias("_conf"), F.sum(right).alias("_right")
    )
    return per_class.groupBy("band").agg(
        F.sum("_n").alias("row_count"),
        (F.sum("_conf") / F.sum("_n")).alias("mean_confidence"),
        (F.sum("_right") / F.sum("_n")).alias("accuracy"),
        F.avg(F.col("_right") / F.col("_n")).alias("balanced_accuracy"),
    )


def class_reliability(rows: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Per predicted class: rows, mean probability and observed frequency; zeros when it never wins."""
    mine = lambda c, v: F.when(F.col("predicted") == c, v)
    right = (F.col("predicted") == F.col("true_class")).cast("double")
    counts = rows.agg(
        *[F.count(mine(c, F.lit(1))).alias(f"_n_{i}") for i, c in enumerate(classes)],
        *[F.coalesce(F.avg(mine(c, F.col("confidence"))), F.lit(0.0)).alias(f"_p_{i}") for i, c in enumerate(classes)],
        *[F.coalesce(F.avg(mine(c, right)), F.lit(0.0)).alias(f"_f_{i}") for i, c in enumerate(classes)],
    )
    entries = [
        F.struct(
            F.lit(c).alias("class_label"), F.col(f"_n_{i}").alias("row_count"),
            F.col(f"_p_{i}").alias("mean_predicted_probability"), F.col(f"_f_{i}").alias("empirical_frequency"),
        )
        for i, c in enumerate(classes)
    ]
    return counts.select(F.explode(F.array(*entries)).alias("_e")).select("_e.*")


QUANTILES = (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95)


def confidence_distribution(rows: DataFrame) -> DataFrame:
    base = rows.agg(F.min("confidence").alias("min"), F.max("confidence").alias("max"), F.avg("confidence").alias("mean"))
    quantiles = series.exact_quantiles(rows, [], "confidence", QUANTILES)
    named = quantiles.select(*[F.col(f"q{i}").alias(f"p{int(q * 100)}") for i, q in enumerate(QUANTILES)])
    return base.crossJoin(named)  # one row each


UNCERTAIN = "uncertain"


def diagnose(threshold: Column | float) -> Column:
    """Predicted class at or above the confidence threshold, else ``uncertain``."""
    return F.when(F.col("confidence") >= threshold, F.col("predicted")).otherwise(UNCERTAIN)


def coverage_metrics(rows: DataFrame, thresholds: Sequence[float], classes: Sequence[str], healthy: str) -> DataFrame:
    """Coverage, selective accuracy, false positives and abstention per threshold, in one pass."""
    crossed = rows.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))).withColumn(
        "diagnosis", diagnose(F.col("threshold"))
    )
    covered = F.col("diagnosis") != UNCERTAIN
    is_healthy = F.col("true_class") == healthy
    share = lambda cond, value: F.coalesce(F.avg(F.when(cond, value.cast("double"))), F.lit(0.0))
    base = crossed.groupBy("threshold").agg(
        F.avg(covered.cast("double")).alias("coverage"),
        share(is_healthy, covered & (F.col("diagnosis") != healthy)).alias("healthy_false_positive_rate"),
        share(is_healthy, ~covered).alias("uncertain_rate_healthy"),
        share(~is_healthy, ~covered).alias("uncertain_rate_active_fault"),
        *[share(F.col("true_class") == c, covered).alias(f"retained_{c}") for c in classes],
    )
    selective = overall_metrics(
        per_class_metrics(crossed.filter(covered), classes, ["threshold"], predicted="diagnosis"), ["threshold"]
    ).select("threshold", F.col("balanced_accuracy").alias("selective_balanced_accuracy"), F.col("macro_f1").alias("selective_macro_f1"))
    zero = {c: 0.0 for c in ("selective_balanced_accuracy", "selective_macro_f1")}
    return base.join(selective, "threshold", "left").fillna(zero)


def uncertainty_groups(rows: DataFrame, dimensions: dict[str, Column]) -> DataFrame:
    """Rows, uncertain rate and mean confidence per value of each dimension, in one pass."""
    tagged = F.array(*[F.struct(F.lit(n).alias("dimension"), c.cast("string").alias("group")) for n, c in dimensions.items()])
    long = rows.select("confidence", "diagnosis", F.explode(tagged).alias("_d")).select("confidence", "diagnosis", "_d.*")
    return (
        long.filter(F.col("group").isNotNull())
        .groupBy("dimension", "group")
        .agg(
            F.count(F.lit(1)).alias("row_count"),
            F.avg((F.col("diagnosis") == UNCERTAIN).cast("double")).alias("uncertain_rate"),
            F.avg("confidence").alias("mean_confidence"),
        )
    )


def ranking_shift(rows: DataFrame, classes: Sequence[str], before: str, after: str) -> DataFrame:
    """Classes ordered by mean probability before and after; equal means keep class order."""
    means = rows.agg(*[F.avg(prefix + c).alias(f"_{prefix}{c}") for prefix in (before, after) for c in classes])
    ordered = lambda prefix: F.transform(
        F.array_sort(F.array(*[F.struct((-F.col(f"_{prefix}{c}")).alias("m"), F.lit(i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(classes)])),
        lambda e: e["c"],
    )
    out = means.select(ordered(before).alias("order_before"), ordered(after).alias("order_after"))
    return out.withColumn("ranking_changed", F.col("order_before") != F.col("order_after"))


def flip_metrics(rows: DataFrame, classes: Sequence[str], before: str = "predicted", after: str = "predicted_after") -> DataFrame:
    """Share of rows whose top class changed, and balanced accuracy after the change."""
    flips = rows.agg(F.avg((F.col(before) != F.col(after)).cast("double")).alias("flip_rate"))
    return flips.crossJoin(  # one row each
        overall_metrics(per_class_metrics(rows, classes, predicted=after)).select(F.col("balanced_accuracy").alias("balanced_accuracy_after"))
    )


def bootstrap_by_run(
    rows: DataFrame, classes: Sequence[str], resamples: int = 300, confidence: float = 0.90, seed: str = "42"
) -> DataFrame:
    """Balanced accuracy of seeded resamples of run ids (membership counts once) and its interval.

    Rows collapse to one tally per run first; a draw is a hash of (seed, resample, slot), so
    results do not depend on partitioning.
    """
    tallies = rows.groupBy("run_id").agg(
        *[F.count_if((F.col("true_class") == c) & (F.col("predicted") == c)).alias(f"_tp_{i}") for i, c in enumerate(classes)],
        *[F.count_if(F.col("true_class") == c).alias(f"_t_{i}") for i, c in enumerate(classes)],
    )
    indexed = series.with_position(
        tallies.withColumn("_all", F.lit(0)), ["_all"], ["run_id"], F.floor(F.col("run_id") / 100_000), name="_slot"
    )
    size = tallies.agg(F.count(F.lit(1)).alias("_n"))
    drawn = resampled_slots(indexed.select("_slot"), size, resamples, seed).distinct()
    sums = [F.sum(f"_{k}_{i}").alias(f"_{k}_{i}") for k in ("tp", "t") for i in range(len(classes))]
    recalls = F.array_compact(F.array(*[F.when(F.col(f"_t_{i}") > 0, F.col(f"_tp_{i}") / F.col(f"_t_{i}")) for i in range(len(classes))]))
    score = F.aggregate(recalls, F.lit(0.0), lambda a, r: a + r) / F.size(recalls)
    scores = drawn.join(indexed, "_slot").groupBy("resample").agg(*sums).select("resample", score.alias("score"))
    alpha = (1.0 - confidence) / 2.0
    # ``resamples`` values: exact percentiles of a fixed-size set
    interval = scores.agg(
        F.percentile("score", alpha).alias("lower"), F.percentile("score", 1.0 - alpha).alias("upper"), F.count(F.lit(1)).alias("n_resamples")
    )
    point = tallies.agg(*sums).select(score.alias("point_estimate"))
    return point.crossJoin(interval).crossJoin(size.select(F.col("_n").alias("n_runs")))  # one row each


def resampled_slots(slots: DataFrame, size: DataFrame, resamples: int, seed: str) -> DataFrame:
    """The drawn slots of every resample; ``size`` has the number of slots as ``_n``.

    The slots come out of one window in one task, and each has ``resamples`` draws, so they are dealt out first, over a stated
    number of partitions: few bytes as they are, they would be joined into one again.
    """
    spark = slots.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    draws = (
        slots.repartition(parts, "_slot")
        .crossJoin(F.broadcast(size))  # one row: the number of runs
        .withColumn("resample", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    )
    text = F.concat_ws(":", F.lit(seed), F.col("resample").cast("string"), F.col("_slot").cast("string"))
    number = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
    return draws.select("resample", (number % F.col("_n") + 1).alias("_slot"))


# --- distribution shift ---------------------------------------------------------


def feature_shift(train: DataFrame, other: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Standardised mean difference, Wasserstein-1, moments and out-of-range share per column."""
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns])
    side = lambda df, flag: df.select(F.explode(pairs).alias("_p")).select("_p.*", F.lit(flag).alias("is_train"))
    both = side(train, True).unionByName(side(other, False))
    mine, theirs = F.when(F.col("is_train"), F.col("value")), F.when(~F.col("is_train"), F.col("value"))
    moments = both.groupBy("name").agg(
        F.avg(mine).alias("train_mean"), F.stddev_pop(mine).alias("train_std"), F.min(mine).alias("train_min"), F.max(mine).alias("train_max"),
        F.avg(theirs).alias("other_mean"), F.stddev_pop(theirs).alias("other_std"),
    )
    cumulative = series.cumulative_by_value(
        both, ["name"], "value", {"a": F.col("is_train").cast("long"), "b": (~F.col("is_train")).cast("long")}
    )
    gap = F.abs(F.col("cum_a") / F.col("total_a") - F.col("cum_b") / F.col("total_b"))
    distance = cumulative.groupBy("name").agg(F.coalesce(F.sum(gap * (F.col("_next") - F.col("_v"))), F.lit(0.0)).alias("wasserstein"))
    bounds = moments.select("name", "train_min", "train_max")
    outside = (
        both.filter(~F.col("is_train"))
        .join(F.broadcast(bounds), "name")  # one row per column name
        .groupBy("name")
        .agg(F.avg(((F.col("value") < F.col("train_min")) | (F.col("value") > F.col("train_max"))).cast("double")).alias("out_of_range"))
    )
    pooled = F.sqrt((F.pow("train_std", F.lit(2)) + F.pow("other_std", F.lit(2))) / 2.0)
    difference = F.col("other_mean") - F.col("train_mean")
    return (
        moments.withColumn("smd", F.when(pooled > 1e-9, difference / pooled).otherwise(difference))
        .join(distance, "name")
        .join(outside, "name")
    )


def top_shifted(shift: DataFrame, group: Column, k: int = 10) -> DataFrame:
    """The ``k`` columns with the largest |smd| per group; names break ties."""
    order = Window.partitionBy("group").orderBy(F.desc(F.abs("smd")), F.asc("name"))
    return shift.withColumn("group", group).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def clamp_stats(value: str, cap: float = 100.0, tolerance: float = 1e-4) -> list[Column]:
    """Aggregates: rows, rows at the cap, spread, distinct values after rounding, range."""
    at_cap = F.count_if(F.col(value) >= cap - tolerance)
    rows = F.count(value)
    return [
        rows.alias("rows"),
        at_cap.alias("clamped"),
        F.bround(F.lit(100.0) * at_cap / rows, 3).alias("clamped_percentage"),
        F.var_pop(value).alias("variance"),
        F.stddev_pop(value).alias("stdev"),
        F.count_distinct(F.bround(value, 4)).alias("unique_values"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    ]


def availability(rows: DataFrame, cadence: float = 10.0) -> DataFrame:
    """Coverage, rejected time, affected runs and stage shares of eligible rows.

    ``rows`` carry run_id, valid, stage (ramp / post_ramp / null).
    """
    bad = ~F.col("valid")
    stage = lambda s: F.col("stage") == s
    unavailable = lambda s: F.avg(F.when(stage(s), bad.cast("double")))
    return rows.agg(
        F.avg(F.col("valid").cast("double")).alias("valid_feature_coverage"),
        F.avg(bad.cast("double")).alias("insufficient_data_rate"),
        (F.count_if(bad) * F.lit(cadence)).alias("insufficient_data_seconds"),
        F.count_distinct(F.when(bad, F.col("run_id"))).alias("affected_runs"),
        F.count_if(bad & stage("ramp")).alias("rejected_ramp"),
        F.count_if(bad & stage("post_ramp")).alias("rejected_post_ramp"),
        F.count_if(bad & F.col("stage").isNull()).alias("rejected_outside"),
        unavailable("ramp").alias("ramp_unavailable_fraction"),
        unavailable("post_ramp").alias("post_ramp_unavailable_fraction"),
        F.count_distinct(F.when(bad & F.col("stage").isNotNull(), F.col("run_id"))).alias("interrupted_runs"),
    )


def rejection_summary(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rejected share, affected runs and worst-first rank per cohort."""
    bad = ~F.col("is_valid")
    out = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("eligible_rows"),
        F.count_if(bad).alias("rejected_rows"),
        F.avg(bad.cast("double")).alias("rejection_fraction"),
        F.count_distinct(F.when(bad, F.col("run_id"))).alias("affected_runs"),
    )
    # one row per cohort name, a fixed short list
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("rejection_fraction"), *by)))


def rejection_counts(rows: DataFrame, columns: Sequence[str] = ("reason_codes", "invalid_feature_names"), by: Sequence[str] = ()) -> DataFrame:
    """(kind, name, rows): occurrences of every reason code and feature name, a rejected row counting once for each it has."""
    kinds = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).cast("array<string>").alias("names")) for c in columns])
    each = rows.select(*by, F.explode(kinds).alias("_k")).select(*by, "_k.kind", F.explode("_k.names").alias("name"))
    return each.groupBy(*by, "kind", "name").agg(F.count(F.lit(1)).alias("rows"))


def availability_counts(rows: DataFrame) -> DataFrame:
    """(kind, name, rows) of the rejected rows: by reason code, class, stage of the fault and asset.

    ``rows`` carry valid, reason_codes, class_label, stage and asset_id.
    """
    bad = rows.filter(~F.col("valid"))
    named = {"class": F.col("class_label"), "stage": F.coalesce("stage", F.lit("not_in_fault_window")), "asset": F.col("asset_id").cast("string")}
    kinds = [F.struct(F.lit("reason").alias("kind"), F.col("reason_codes").cast("array<string>").alias("names"))]
    kinds += [F.struct(F.lit(k).alias("kind"), F.array(c).cast("array<string>").alias("names")) for k, c in named.items()]
    each = bad.select(F.explode(F.array(*kinds)).alias("_k")).select("_k.kind", F.explode("_k.names").alias("name"))
    return each.groupBy("kind", "name").agg(F.count(F.lit(1)).alias("rows"))


def longest_gap(rows: DataFrame, keys: Sequence[str], cadence: float = 10.0) -> DataFrame:
    """One row: the longest run of rejected rows one cadence apart in any series, in rows and in seconds."""
    from sensorloom.operators import alerts

    streaks = alerts.longest_streak(rows.filter(~F.col("valid")).select(*keys, "elapsed"), keys, cadence=cadence)
    longest = F.coalesce(F.max("longest_streak"), F.lit(0)).cast("long")
    return streaks.agg(longest.alias("longest_streak_rows"), (longest * F.lit(cadence)).alias("longest_streak_seconds"))


# --- thresholds, histograms, splits ----------------------------------------------


def best_threshold(rows: DataFrame, keys: Sequence[str], value: str, is_fault: Column) -> DataFrame:
    """Best single-split balanced accuracy per group, with the threshold and its fault side.

    Splits lie between distinct values; the lowest split wins a tie, ``above`` before ``below``.
    """
    split = series.cumulative_by_value(
        rows, keys, value, {"fault": is_fault.cast("long"), "ok": (~is_fault).cast("long")}
    )
    usable = (F.col("total_fault") > 0) & (F.col("total_ok") > 0) & F.col("_next").isNotNull()
    above = 0.5 * ((F.col("total_fault") - F.col("cum_fault")) / F.col("total_fault") + F.col("cum_ok") / F.col("total_ok"))
    candidate = lambda score, side, rank: F.struct(
        score.alias("score"), (-F.col("_next")).alias("neg"), F.lit(rank).alias("rank"), F.lit(side).alias("side")
    )
    best = F.max(F.when(usable, F.greatest(candidate(above, "above", 1), candidate(1.0 - above, "below", 0))))
    grouped = split.groupBy(*keys).agg(
        best.alias("_b"), F.min("_v").alias("_low"), F.count(F.lit(1)).alias("_distinct")
    )
    better = F.coalesce(F.col("_b.score") > 0.5, F.lit(False))
    return grouped.select(
        *keys,
        F.when(better, F.col("_b.score")).otherwise(0.5).alias("balanced_accuracy"),
        F.when(better, -F.col("_b.neg")).otherwise(F.col("_low")).alias("threshold"),
        F.when(better, F.col("_b.side")).otherwise("above").alias("side"),
    )


def threshold_rule_accuracy(value: Column, threshold: Column, side: Column, is_fault: Column) -> Column:
    """Aggregate: balanced accuracy of a fixed threshold rule (0.5 when a class is absent)."""
    flagged = F.when(side == "below", value < threshold).otherwise(value >= threshold).cast("double")
    sensitivity, specificity = F.avg(F.when(is_fault, flagged)), F.avg(F.when(~is_fault, 1.0 - flagged))
    return F.coalesce(0.5 * (sensitivity + specificity), F.lit(0.5))


def band_edges(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``sorted[n // 3]`` and ``sorted[2n // 3]`` per group; the smallest value twice below three rows."""
    picked = rank_lookup(
        rows, keys, value,
        {
            "low_edge": lambda n: F.when(n >= 3, F.floor(n / 3)).otherwise(0),
            "high_edge": lambda n: F.when(n >= 3, F.floor(2 * n / 3)).otherwise(0),
        },
    )
    return picked


def band_for(value: Column, low: Column, high: Column) -> Column:
    return F.when(value <= low, "low").when(value >= high, "high").otherwise("mid")


def histogram(rows: DataFrame, keys: Sequence[str], value: str, width: float, origin: float = 0.0) -> DataFrame:
    """Equal-width counts; ``bin_start`` is the left border."""
    number = F.floor((F.col(value) - F.lit(origin)) / F.lit(width))
    return rows.filter(F.col(value).isNotNull()).groupBy(*keys, (F.lit(origin) + number * F.lit(width)).alias("bin_start")).agg(
        F.count(F.lit(1)).alias("rows")
    )


def _fill_empty(counts: Column, index: int, allowed: Column) -> Column:
    """Move one item from the first largest count to ``counts[index]`` when that one is empty."""
    largest = F.array_max(counts)
    donor = F.array_position(counts, largest).cast("int") - 1
    moves = allowed & (F.element_at(counts, index + 1) == 0) & (largest > 1)
    shifted = F.transform(counts, lambda c, j: c + F.when(j == index, 1).otherwise(0) - F.when(j == donor, 1).otherwise(0))
    return F.when(moves, shifted).otherwise(counts)


def with_apportionment(sizes: DataFrame, shares: Sequence[float], n: str = "_n", name: str = "_c") -> DataFrame:
    """Add array<int>: largest-remainder counts, with no empty split where the size permits.

    Each step is its own column, so no step is repeated inside the next one.
    """
    size = F.col(n)
    raw = [F.lit(float(p)) * size for p in shares]
    base = [F.floor(r).cast("int") for r in raw]
    spare = size.cast("int") - sum(base[1:], base[0])
    order = F.array_sort(F.array(*[F.struct((b - r).alias("f"), F.lit(i).alias("i")) for i, (r, b) in enumerate(zip(raw, base, strict=True))]))
    lucky = F.transform(F.slice(order, F.lit(1), F.greatest(spare, F.lit(0))), lambda e: e["i"])
    out = sizes.withColumn("_lucky", lucky).withColumn(
        name, F.array(*[b + F.when(F.array_contains("_lucky", F.lit(i)), 1).otherwise(0) for i, b in enumerate(base)])
    )
    wanted = [i for i, p in enumerate(shares) if p > 0]
    for i in wanted:
        out = out.withColumn(name, _fill_empty(F.col(name), i, size >= len(wanted)))
    return out.drop("_lucky")


def stratified_split(runs: DataFrame, strata: Sequence[str], shares: Sequence[float], dataset_id: str) -> DataFrame:
    """Assign train/validation/test per stratum in an order given by a hash of the run id."""
    keyed = runs.withColumn("_h", F.md5(F.concat_ws(":", F.lit(dataset_id), *[F.col(s).cast("string") for s in strata], F.col("run_id").cast("string"))))
    numbered = series.with_position(keyed, strata, ["_h", "run_id"], F.substring("_h", 1, 3), name="_pos")
    sizes = with_apportionment(runs.groupBy(*strata).agg(F.count(F.lit(1)).alias("_n")), shares)
    joined = numbered.join(sizes, list(strata))
    first, second = F.element_at("_c", 1), F.element_at("_c", 1) + F.element_at("_c", 2)
    label = F.when(F.col("_pos") <= first, "train").when(F.col("_pos") <= second, "validation").otherwise("test")
    return joined.withColumn("split", label).drop("_h", "_pos", "_n", "_c")
