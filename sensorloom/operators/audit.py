"""Data-quality audit: every check returns rows (check, severity, category, rows, detail)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.functions.scalar import audit_severity_band
from sensorloom.lineage import cut_lineage
from sensorloom.operators import series

# Severity order, verdicts and thresholds.
SEVERITY_RANK = {"blocking": 0, "high": 1, "medium": 2, "low": 3}
VERDICTS = {
    "blocking": "NOT READY — SIMULATOR OR LABEL CORRECTIONS REQUIRED",
    "high": "READY WITH DATASET POLICY CHANGES",
    "ok": "READY FOR FEATURE ENGINEERING",
}
TOLERANCE = 1e-6
DIRECTION_CONSISTENCY = 0.7
NOISE_CONSISTENCY = 0.5
MIN_RUNS_FOR_BLOCKING = 5
STRONG_COHERENCE = 0.85
MIN_RUNS_FOR_STRONG = 10
TRIVIAL_SEPARABILITY = 0.95
HEALTHY_SPREAD = 0.5


def finding(df: DataFrame, check: str, severity: str, category: str, rows: Column, detail: Column | str = "") -> DataFrame:
    """Turn a one-row or per-item result into findings; rows with a zero count vanish."""
    text = F.lit(detail) if isinstance(detail, str) else detail
    out = df.select(
        F.lit(check).alias("check"), F.lit(severity).alias("severity"), F.lit(category).alias("category"),
        rows.cast("long").alias("rows"), text.cast("string").alias("detail"),
    )
    return out.filter(F.col("rows") > 0)


def schema_status(spark, name: str, actual, declared) -> DataFrame:
    """One row per declared or extra column: ok, missing, undeclared, wrong_order, wrong_type."""
    have = {f.name: (i, f.dataType.simpleString()) for i, f in enumerate(actual.fields)}
    names = [n for n, _, _ in declared]
    there, expected = [n for n in have if n in names], [n for n in names if n in have]
    rows = []
    for column, kind, _ in declared:
        if column not in have:
            status = "missing"
        elif have[column][1] != kind:
            status = "wrong_type"
        else:
            status = "ok" if there.index(column) == expected.index(column) else "wrong_order"
        rows.append((name, column, status))
    rows += [(name, column, "undeclared") for column in have if column not in names]
    return spark.createDataFrame(rows, "table string, column string, status string")


def nullability_status(footers: DataFrame, declared) -> DataFrame:
    """(column, status) of declared columns that the files' footers call nullable where none may be, or the other way round."""
    said = footers.sparkSession.createDataFrame([(n, nullable) for n, _, nullable in declared], "column string, declared boolean")
    odd = footers.join(said, "column").filter(F.col("nullable") != F.col("declared"))
    return odd.select("column", F.lit("wrong_nullability").alias("status")).distinct()


def split_count_mismatches(membership: DataFrame, declared: DataFrame) -> DataFrame:
    """(split, declared, actual) where the manifest's number of runs differs from the membership's."""
    actual = membership.groupBy("split").agg(F.count_distinct("run_id").alias("actual"))
    joined = declared.join(actual, "split", "full_outer").fillna({"declared": 0, "actual": 0})
    return joined.filter(F.col("declared") != F.col("actual"))


def derived_split_mismatches(membership: DataFrame, derived: DataFrame) -> DataFrame:
    """Runs whose split differs from the one derived again, or that one of the two does not know."""
    said = derived.select("run_id", F.col("split").alias("derived"))
    return membership.select("run_id", "split").join(said, "run_id", "full_outer").filter(~F.col("split").eqNullSafe(F.col("derived")))


def row_count_mismatches(actual: DataFrame, declared: DataFrame, key: str) -> DataFrame:
    """Keys whose row count differs from the declared one."""
    joined = declared.join(actual, key, "full_outer")
    return joined.filter(~F.col("declared_rows").eqNullSafe(F.col("actual_rows")))


def round_robin_counts(class_counts: DataFrame, assets: Sequence[str]) -> DataFrame:
    """Expected runs per (class, asset) when each class walks the assets in turn."""
    size = len(assets)
    entry = F.array(*[
        F.struct(F.lit(a).alias("asset_id"), F.floor((F.col("runs") + F.lit(size - 1 - i)) / F.lit(size)).alias("expected"))
        for i, a in enumerate(assets)
    ])
    return class_counts.select("class_label", F.explode(entry).alias("_e")).select("class_label", "_e.*").filter(F.col("expected") > 0)


def plan_mismatches(runs: DataFrame, assets: Sequence[str]) -> DataFrame:
    """(class, asset) cells whose run count differs from the round-robin plan."""
    actual = runs.groupBy("class_label", "asset_id").agg(F.count(F.lit(1)).alias("actual"))
    expected = round_robin_counts(runs.groupBy("class_label").agg(F.count(F.lit(1)).alias("runs")), assets)
    joined = expected.join(actual, ["class_label", "asset_id"], "full_outer").fillna({"expected": 0, "actual": 0})
    return joined.filter(F.col("expected") != F.col("actual"))


def split_overlaps(membership: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs in two splits per pair, runs in no split and unknown runs in a split."""
    has = lambda s: F.max((F.col("split") == s).cast("int"))
    per_run = membership.groupBy("run_id").agg(has("train").alias("a"), has("validation").alias("b"), has("test").alias("c"))
    both = per_run.join(runs.select("run_id").distinct().withColumn("known", F.lit(1)), "run_id", "full_outer")
    counts = both.agg(
        F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("train/validation"),
        F.count_if((F.col("a") == 1) & (F.col("c") == 1)).alias("train/test"),
        F.count_if((F.col("b") == 1) & (F.col("c") == 1)).alias("validation/test"),
        F.count_if(F.col("a").isNull()).alias("missing_from_splits"),
        F.count_if(F.col("known").isNull()).alias("unknown_in_splits"),
    )
    entries = [F.struct(F.lit(c).alias("check"), F.col(f"`{c}`").alias("rows")) for c in counts.columns]
    return counts.select(F.explode(F.array(*entries)).alias("_e")).select("_e.*")


def cadence_flags(rows: DataFrame, keys: Sequence[str], pos: str, elapsed: str, step: float) -> DataFrame:
    """Per series: does time always increase, and is every step the nominal one?"""
    stepped = series.lagged(rows, keys, {"_d": lambda w: F.col(elapsed) - F.lag(elapsed).over(w)}, pos)
    monotonic = F.coalesce(F.bool_and(F.col("_d") > 0), F.lit(True))
    regular = F.coalesce(F.bool_and(F.abs(F.col("_d") - step) <= TOLERANCE), F.lit(True))
    return stepped.groupBy(*keys).agg(monotonic.alias("monotonic"), regular.alias("regular"))


def unstable_units(rows: DataFrame, measurement: str = "measurement_type", unit: str = "unit") -> DataFrame:
    distinct = rows.select(measurement, unit).distinct().groupBy(measurement)
    return distinct.agg(F.count(F.lit(1)).alias("units"), F.array_join(F.array_sort(F.collect_list(unit)), "|").alias("names")).filter(
        F.col("units") > 1
    )


def duplicate_keys(rows: DataFrame, keys: Sequence[str], examples: int = 5) -> DataFrame:
    """Surplus rows of repeated keys and the first few such keys."""
    repeated = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    head = repeated.orderBy(*keys).limit(examples)  # a report detail: top-k by key, never a collected group
    shown = head.agg(F.array_sort(F.collect_list(F.struct(*keys))).alias("_x"))
    text = F.array_join(F.transform("_x", lambda e: F.concat_ws("/", *[e[k].cast("string") for k in keys])), ",")
    total = repeated.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("rows"))
    return total.crossJoin(shown.select(text.alias("examples")))  # one row each


def truth_mismatch() -> Column:
    """Reported ground truth differs from the recomputed one (``x_`` columns)."""
    close = lambda a, b: F.abs(F.col(a) - F.col(b)) <= TOLERANCE
    nulls = F.col("seconds_since_fault_start").isNull() != F.col("x_seconds_since_fault_start").isNull()
    return (
        (F.col("fault_type") != F.col("x_fault_type"))
        | (F.col("fault_active") != F.col("x_fault_active"))
        | ~close("fault_severity", "x_fault_severity")
        | nulls
        | F.coalesce(~close("seconds_since_fault_start", "x_seconds_since_fault_start"), F.lit(False))
        | (F.col("corruption") != F.col("x_corruption"))
    )


def label_problems(rows: DataFrame, healthy_class: str, corruption_class: str) -> DataFrame:
    """Six label checks as one aggregation: (check, severity, rows).

    ``rows`` carry the reported truth, ``class_label`` and ``is_target`` of their run.
    """
    named = F.when(F.col("class_label") == corruption_class, "none").otherwise(F.col("class_label"))
    bias = F.when(F.col("class_label") == corruption_class, "bias").otherwise("none")
    labelled = (F.col("fault_type") != "none") | F.col("fault_active") | (F.col("corruption") != "none")
    since, severity = F.col("seconds_since_fault_start"), F.col("fault_severity")
    checks = {
        "non_target_labelled": ("blocking", ~F.col("is_target") & labelled),
        "inactive_nonzero_severity": ("blocking", ~F.col("fault_active") & (severity != 0.0)),
        "active_nonpositive_severity": (
            "high", F.col("fault_active") & ((severity < 0) | F.coalesce((since > 0) & (severity <= 0), F.lit(False))),
        ),
        "null_mismatch": ("blocking", F.col("fault_active") == since.isNull()),
        "class_mismatch": (
            "blocking",
            F.col("is_target") & F.col("fault_active") & (F.col("class_label") != healthy_class)
            & ((F.col("fault_type") != named) | (F.col("corruption") != bias)),
        ),
        "healthy_run_labelled": ("blocking", (F.col("class_label") == healthy_class) & labelled),
    }
    counts = rows.agg(*[F.count_if(c).alias(n) for n, (_, c) in checks.items()])
    entries = [F.struct(F.lit(n).alias("check"), F.lit(s).alias("severity"), F.col(n).alias("rows")) for n, (s, _) in checks.items()]
    return counts.select(F.explode(F.array(*entries)).alias("_e")).select("_e.*")


def falling_ramps(rows: DataFrame, keys: Sequence[str], pos: str = "tick") -> DataFrame:
    """Series whose active severity drops by more than the tolerance, with the number of drops."""
    active = rows.filter("fault_active")
    drop = lambda w: F.col("fault_severity") < F.lag("fault_severity").over(w) - TOLERANCE
    # the active part is the tail of a run, so positions stay consecutive
    marked = series.lagged(active, keys, {"_drop": drop}, pos)
    return marked.groupBy(*keys).agg(F.count_if("_drop").alias("drops")).filter(F.col("drops") > 0)


def numeric_profile(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, min, max, mean, population deviation and distinct values after rounding, per column."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    long = rows.select(F.explode(pairs).alias("_p")).select("_p.*").filter(F.col("value").isNotNull())
    return long.groupBy("column").agg(
        F.count(F.lit(1)).alias("count"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("stdev"),
        F.count_distinct(F.bround("value", 6)).alias("distinct"),
    )


def class_split_counts(runs: DataFrame) -> DataFrame:
    """Counts by class, asset, split and their combinations from one grouping-sets pass."""
    sets = [["class_label"], ["asset_id"], ["split"], ["class_label", "split"], ["class_label", "asset_id", "split"]]
    out = runs.groupingSets(sets, "class_label", "asset_id", "split").agg(
        F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("runs")
    )
    level = F.coalesce(*[F.when(F.col("_g") == g, n) for n, g in (("class", 3), ("asset", 5), ("split", 6), ("class/split", 2), ("all", 0))])
    return out.select(level.alias("level"), "class_label", "asset_id", "split", "runs")


def phases(rows: DataFrame, runs: DataFrame, elapsed: str = "elapsed") -> DataFrame:
    """Label rows pre / active around each run's fault start; other rows drop out."""
    start, duration, t = F.col("fault_start"), F.col("fault_duration"), F.col(elapsed)
    phase = F.when((t >= F.greatest(F.lit(0.0), start - duration)) & (t < start), "pre").when(
        (t >= start) & (t < start + duration), "active"
    )
    windows = runs.filter(start.isNotNull()).select("run_id", "class_label", "fault_start", "fault_duration", "severity")
    return rows.join(windows, "run_id").withColumn("phase", phase).filter(F.col("phase").isNotNull())


def run_effects(long_rows: DataFrame) -> DataFrame:
    """Median before and during the fault per (run, measurement); runs lacking a phase drop out."""
    keys = ["run_id", "class_label", "severity", "measurement", "phase"]
    medians = series.exact_median(long_rows, keys, "value", "median")
    pick = lambda p: F.max(F.when(F.col("phase") == p, F.col("median")))
    both = medians.groupBy("run_id", "class_label", "severity", "measurement").agg(
        pick("pre").alias("median_pre"), pick("active").alias("median_active")
    )
    return both.filter(F.col("median_pre").isNotNull() & F.col("median_active").isNotNull()).withColumn(
        "change", F.col("median_active") - F.col("median_pre")
    )


def fault_effects(effects: DataFrame) -> DataFrame:
    """Median change, majority direction and consistency per (class, measurement)."""
    keys = ["class_label", "measurement"]
    effects = cut_lineage(effects)  # one row per (run, measurement), read several times below
    names = ("median_pre", "median_active", "change")
    entries = F.array(*[F.struct(F.lit(n).alias("which"), F.col(n).alias("v")) for n in names])
    long = effects.select(*keys, F.explode(entries).alias("_e")).select(*keys, "_e.*")
    mids = series.exact_median(long, [*keys, "which"], "v", "mid")
    medians = mids.groupBy(*keys).agg(*[F.max(F.when(F.col("which") == n, F.col("mid"))).alias(f"{n}_mid") for n in names])
    epsilon = F.greatest(F.lit(1e-6), F.lit(0.01) * F.abs("median_pre_mid"))
    marked = effects.join(medians, keys).withColumn(
        "_dir", F.when(F.col("change") > epsilon, 1).when(F.col("change") < -epsilon, -1).otherwise(0)
    )
    counted = marked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_runs"), F.count_if(F.col("_dir") == 1).alias("_up"), F.count_if(F.col("_dir") == -1).alias("_down")
    )
    majority = F.when(F.col("_up") + F.col("_down") == 0, 0).when(F.col("_up") >= F.col("_down"), 1).otherwise(-1)
    share = F.when(majority == 1, F.col("_up")).when(majority == -1, F.col("_down")).otherwise(0) / F.col("n_runs")
    return (
        counted.withColumn("majority_direction", majority)
        .withColumn("direction_consistency", share)
        .join(medians, keys)
        .select(
            *keys, "n_runs", F.col("median_pre_mid").alias("median_pre"), F.col("median_active_mid").alias("median_active"),
            F.col("change_mid").alias("median_change"), "majority_direction", "direction_consistency",
        )
    )


def effect_by_severity(effects: DataFrame) -> DataFrame:
    banded = effects.withColumn("band", audit_severity_band(F.col("severity"))).filter(F.col("band").isNotNull())
    return series.exact_median(banded, ["class_label", "measurement", "band"], "change", "median_change")


def signature_status(effects: DataFrame, signatures: DataFrame) -> DataFrame:
    """Grade observed effects against expected signatures (class, measurement, expected, hard)."""
    joined = F.broadcast(signatures)  # a fixed rule table
    out = effects.join(joined, ["class_label", "measurement"], "right")
    seen, same, n = F.col("majority_direction"), F.col("direction_consistency"), F.col("n_runs")
    wanted, hard = F.col("expected"), F.col("hard")
    soft = F.when(hard, "concerning").otherwise("acceptable")
    grave = F.when(hard & (n >= MIN_RUNS_FOR_BLOCKING), "blocking").otherwise("concerning")
    directed = (
        F.when((seen == wanted) & (same >= DIRECTION_CONSISTENCY), "matches")
        .when((seen == -wanted) & (same >= DIRECTION_CONSISTENCY), grave)
        .otherwise(soft)
    )
    quiet = (
        F.when((seen == 0) | (same <= NOISE_CONSISTENCY), "matches")
        .when((same < STRONG_COHERENCE) | (n < MIN_RUNS_FOR_STRONG), soft)
        .otherwise(grave)
    )
    status = F.when(n.isNull(), soft).when(wanted != 0, directed).otherwise(quiet)
    return out.withColumn("status", status)


def class_ranges(rows: DataFrame) -> DataFrame:
    keys = ["class_label", "measurement"]
    base = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"), F.min("value").alias("min"), F.max("value").alias("max"))
    return base.join(series.exact_median(rows, keys, "value", "median"), keys)


def separability(healthy: DataFrame, faulty: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Best threshold accuracy of every fault class against healthy rows, per measurement (and band).

    Both sides collapse to counts per distinct value; the healthy counts are then repeated for
    each fault class, a short list.
    """
    keys = ["class_label", "measurement", *by]
    counted_ok = healthy.groupBy("measurement", *by, "value").agg(F.count(F.lit(1)).alias("_ok"))
    classes = faulty.agg(F.collect_set("class_label").alias("_classes"))
    repeated = counted_ok.crossJoin(F.broadcast(classes)).withColumn("class_label", F.explode("_classes")).drop("_classes")  # one row: a short vocabulary
    ok = repeated.withColumn("_fault", F.lit(0).cast("long"))
    bad = faulty.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("_fault")).withColumn("_ok", F.lit(0).cast("long"))
    weighted = ok.unionByName(bad)
    split = series.cumulative_by_value(weighted, keys, "value", {"fault": F.col("_fault"), "ok": F.col("_ok")})
    usable = (F.col("total_fault") > 0) & (F.col("total_ok") > 0) & F.col("_next").isNotNull()
    above = 0.5 * ((F.col("total_fault") - F.col("cum_fault")) / F.col("total_fault") + F.col("cum_ok") / F.col("total_ok"))
    best = F.max(F.when(usable, F.greatest(above, 1.0 - above)))
    return split.groupBy(*keys).agg(F.greatest(F.lit(0.5), F.coalesce(best, F.lit(0.5))).alias("balanced_accuracy"))


def severity_correlation(effects: DataFrame) -> DataFrame:
    """Pearson correlation of severity and absolute change; null below three pairs or without spread."""
    size = F.abs("change")
    enough = (F.count(F.lit(1)) >= 3) & (F.min("severity") < F.max("severity")) & (F.min(size) < F.max(size))
    return effects.groupBy("class_label", "measurement").agg(
        F.count(F.lit(1)).alias("pairs"), F.when(enough, F.corr("severity", size)).alias("correlation")
    )


def missing_combinations(rows: DataFrame, left: str, right: str, counts: Column | None = None) -> DataFrame:
    """Values of ``right`` seen somewhere but in no row of a given ``left`` value for which ``counts`` holds.

    Both columns are short vocabularies (splits, classes, assets).
    """
    seen = F.col(right) if counts is None else F.when(counts, F.col(right))
    present = rows.groupBy(left).agg(F.collect_set(seen).alias("_seen"))
    every = rows.agg(F.collect_set(right).alias("_all"))
    return present.crossJoin(F.broadcast(every)).select(left, F.explode(F.array_except("_all", "_seen")).alias(right))  # one row: a short vocabulary


def variation_problems(runs: DataFrame, numeric: Sequence[str], ranges: dict[str, tuple[float, float]], grid: tuple[float, float], healthy: str) -> DataFrame:
    """Identical configurations, narrow healthy spread, values out of range, starts off the grid."""
    configs = runs.groupBy("class_label").agg(
        F.count(F.lit(1)).alias("_n"), F.count_distinct(F.struct(*numeric, "fault_start", "severity")).alias("_d")
    )
    same = finding(
        configs.filter((F.col("_n") > 1) & (F.col("_d") == 1)), "identical_configuration", "high", "variation", F.col("_n"), F.col("class_label")
    )
    spreads = runs.filter(F.col("class_label") == healthy).agg(
        *[F.when((F.count(F.lit(1)) >= 2) & (F.stddev_pop(c) < HEALTHY_SPREAD), 1).otherwise(0).alias(c) for c in numeric]
    )
    outside = runs.agg(
        *[F.count_if((F.col(c) < lo - TOLERANCE) | (F.col(c) > hi + TOLERANCE)).alias(c) for c, (lo, hi) in ranges.items()]
    )
    start, step = grid
    rest = F.pmod(F.col("fault_start") - start, F.lit(step))
    off = runs.filter(F.col("fault_start").isNotNull() & (rest > TOLERANCE) & (rest < step - TOLERANCE)).groupBy("class_label").agg(
        F.count(F.lit(1)).alias("_n")
    )
    unpivot = lambda df, columns, check, severity: finding(
        df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("long").alias("n")) for c in columns])).alias("_e")),
        check, severity, "variation", F.col("_e.n"), F.col("_e.c"),
    )
    return (
        same.unionByName(unpivot(spreads, numeric, "narrow_healthy_spread", "medium"))
        .unionByName(unpivot(outside, list(ranges), "out_of_range", "blocking"))
        .unionByName(finding(off, "start_off_grid", "blocking", "variation", F.col("_n"), F.col("class_label")))
    )


def leakage_probes(runs: DataFrame, channels: DataFrame, assets: Sequence[str]) -> DataFrame:
    """Eleven probes (probe, flagged, severity): could something besides the signals predict the class?

    ``runs`` carry run_id, dataset_id, class_label, asset_id, split, duration, sample_count,
    start_time, noise and fault_start; ``channels`` is run_id x measurement_type.
    """
    per_class = runs.groupBy("class_label").agg(
        F.count_distinct("asset_id").alias("_assets"),
        F.count_distinct("duration").alias("_durations"),
        F.min("fault_start").alias("_lo"),
        F.max("fault_start").alias("_hi"),
    )
    totals = runs.agg(
        F.count_distinct("dataset_id").alias("datasets"),
        F.count_distinct("duration").alias("durations"),
        F.count_distinct("sample_count").alias("counts"),
        F.count_distinct("start_time").alias("starts"),
        F.count_distinct("noise").alias("noises"),
        F.count_distinct("class_label").alias("classes"),
        F.count_distinct("split").alias("splits"),
        F.count_distinct("split", "class_label").alias("split_classes"),
    )
    classes = per_class.agg(
        F.count_if(F.col("_assets") < len(assets)).alias("unbalanced"), F.count_if(F.col("_durations") == 1).alias("single_duration")
    )
    # one row per class, a short vocabulary
    order = Window.orderBy("_lo", "_hi").rowsBetween(Window.unboundedPreceding, -1)
    apart = (
        per_class.filter(F.col("_lo").isNotNull())
        .withColumn("_before", F.min("_hi").over(order))
        .agg(F.count_if(F.col("_lo") > F.col("_before")).alias("apart"))
    )
    sets = channels.groupBy("run_id").agg(F.array_join(F.array_sort(F.collect_set("measurement_type")), "|").alias("_set")).agg(
        F.count_distinct("_set").alias("channel_sets")
    )
    one = totals.crossJoin(classes).crossJoin(apart).crossJoin(sets)  # one row each
    probe = lambda name, flag, severity: F.struct(F.lit(name).alias("probe"), flag.alias("flagged"), F.lit(severity).alias("severity"))
    yes = F.lit(True)
    probes = [
        probe("run_id_string", yes, "low"),
        probe("dataset_id", F.col("datasets") > 1, "low"),
        probe("target_asset_id", F.col("unbalanced") > 0, "high"),
        probe("split_assignment", F.col("split_classes") < F.col("splits") * F.col("classes"), "medium"),
        probe("run_duration", (F.col("durations") > 1) & (F.col("single_duration") > 0), "high"),
        probe("row_count", F.col("counts") > 1, "medium"),
        probe("run_start_time", F.col("starts") > 1, "low"),
        probe("missingness_pattern", yes, "low"),
        probe("noise_configuration", F.col("noises") > 1, "low"),
        probe("measurement_availability", F.col("channel_sets") > 1, "high"),
        probe("fault_start_policy", F.col("apart") > 0, "medium"),
    ]
    return one.select(F.explode(F.array(*probes)).alias("_p")).select("_p.*")


def training_checks(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Non-finite cells, runs in several splits and duplicate keys of a training table."""
    bad = sum((F.when(F.isnan(c) | F.col(c).isNull() | (F.abs(c) == float("inf")), 1).otherwise(0) for c in columns), F.lit(0))
    cells = rows.agg(F.coalesce(F.sum(bad), F.lit(0)).alias("rows")).select(F.lit("non_finite").alias("check"), "rows")
    leaks = rows.groupBy("run_id").agg(F.count_distinct("split").alias("_s")).agg(F.count_if(F.col("_s") > 1).alias("rows"))
    twice = rows.groupBy("run_id", "tick").agg(F.count(F.lit(1)).alias("_n")).agg(F.count_if(F.col("_n") > 1).alias("rows"))
    return cells.unionByName(leaks.select(F.lit("run_in_several_splits").alias("check"), "rows")).unionByName(
        twice.select(F.lit("duplicate_key").alias("check"), "rows")
    )


def verdict(findings: DataFrame) -> DataFrame:
    """Counts by severity and the overall verdict; an audit without findings is ready."""
    count = lambda s: F.count_if(F.col("severity") == s)
    return findings.agg(
        *[count(s).alias(s) for s in SEVERITY_RANK],
        F.when(count("blocking") > 0, VERDICTS["blocking"]).when(count("high") > 0, VERDICTS["high"]).otherwise(VERDICTS["ok"]).alias("verdict"),
    )


def audit_rollup(findings: DataFrame, by: str) -> DataFrame:
    """Per cohort: findings by severity, those at medium or above, and mean physical consistency."""
    count = lambda s: F.count_if(F.col("severity") == s)
    notable = F.col("severity").isin("blocking", "high", "medium")
    return findings.groupBy(by).agg(
        *[count(s).alias(s) for s in SEVERITY_RANK],
        F.count_if(notable).alias("at_or_above_medium"),
        F.avg(F.when(notable & (F.col("category") == "physical"), F.col("direction_consistency"))).alias("mean_consistency"),
    )


def cohort_compatibility(cohorts: DataFrame) -> DataFrame:
    """Repeated cohort names, and whether all cohorts share one model and policy fingerprint."""
    names = cohorts.groupBy("cohort").agg(F.count(F.lit(1)).alias("_n")).agg(F.count_if(F.col("_n") > 1).alias("duplicate_names"))
    prints = cohorts.agg(F.count_distinct("model_hash", "policy_hash").alias("fingerprints"))
    return names.crossJoin(prints).withColumn(  # one row each
        "compatible", (F.col("duplicate_names") == 0) & (F.col("fingerprints") <= 1)
    )


def severity_order(column: str = "severity") -> Column:
    return F.coalesce(*[F.when(F.col(column) == s, r) for s, r in SEVERITY_RANK.items()])


