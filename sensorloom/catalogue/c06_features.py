"""Feature, label, ground-truth and dataset queries over the samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom.catalogue.registry import query, relation
from sensorloom.operators import features, joins, metrics, series
from sensorloom.operators.features import FeatureSpec, Ratio, Residual
from sensorloom.sources import dataset
from sensorloom.sources import warehouse as wh

SPEC = FeatureSpec(
    signals=tuple(wh.SIGNALS),
    ratios=(Ratio("price_per_discount", "l_extendedprice", "l_discount", 0.01),),
    residuals=(Residual("tax__residual", "l_tax", "l_quantity", 0.02, 0.04, 50.0),),
)
QUANTITY = FeatureSpec(signals=("l_quantity",))
KEYS = ["run_id", "tick"]


def fault_runs(spark, sf):
    """Runs with the fault type (class A) or sensor corruption (class R) their faults carry."""
    return wh.runs(spark, sf).withColumns(
        {
            "fault_type": F.when(F.col("class_label") == "A", "A").otherwise("none"),
            "corruption": F.when(F.col("class_label") == "R", "bias").otherwise("none"),
        }
    )


def truth(spark, sf):
    runs = fault_runs(spark, sf).select("run_id", "class_label", "fault_start", "fault_duration", "severity", "fault_type", "corruption")
    return features.ground_truth(wh.samples(spark, sf), runs.withColumnRenamed("class_label", "run_class"))


def built(spark, sf, spec=SPEC):
    return features.build_features(wh.samples(spark, sf), spec, ["run_id"])


def write_features(spark, sf, path):
    """The two feature tables of all samples; each is made from the columns that it holds."""
    rows = wh.samples(spark, sf).select(*KEYS, "elapsed", *wh.SIGNALS)
    valid = features.build_features(rows, SPEC, ["run_id"], whole=True)
    dataset.write_features(path, valid, features.feature_columns(SPEC), KEYS, rejected=features.build_features(rows, SPEC, ["run_id"]))


relation(
    "truth",
    """SELECT *, CASE WHEN NOT fault_active THEN 'healthy' WHEN fault_type <> 'none' THEN fault_type WHEN corruption = 'bias' THEN 'sensor_anomaly' ELSE 'healthy' END AS derived_label FROM (
       SELECT s.*, r.class_label AS run_class, r.fault_start, r.fault_duration, r.severity, CASE WHEN r.class_label = 'A' THEN 'A' ELSE 'none' END AS fault_type,
         CASE WHEN r.class_label = 'R' THEN 'bias' ELSE 'none' END AS corruption, coalesce(elapsed >= r.fault_start, false) AS fault_active,
         CASE WHEN elapsed >= r.fault_start THEN elapsed - r.fault_start END AS seconds_since_fault_start,
         CASE WHEN elapsed >= r.fault_start THEN r.severity * least(1.0, (elapsed - r.fault_start) / r.fault_duration) ELSE 0.0 END::DOUBLE AS fault_severity
       FROM samples s JOIN runs r USING (run_id))""",
    "samples",
    "runs",
)


@query(
    "W01_diff_and_rate",
    """SELECT run_id, tick, round(l_quantity - lag(l_quantity) OVER w, 6) AS diff, round((l_quantity - lag(l_quantity) OVER w) / 10.0, 6) AS rate
       FROM samples WINDOW w AS (PARTITION BY run_id ORDER BY tick)""",
    ("samples",),
)
def w01(spark, sf):
    diff, rate = QUANTITY.steps("l_quantity")
    out = series.lagged(wh.samples(spark, sf), ["run_id"], features.step_columns(QUANTITY), pos="tick")
    return out.select(*KEYS, F.round(diff, 6).alias("diff"), F.round(rate, 6).alias("rate"))


def frame_sql(k: int) -> str:
    w = f"OVER (PARTITION BY run_id ORDER BY tick ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
    s = int(k * 10)
    return f"""round(avg(l_quantity) {w}, 5) AS mean_{s}, round(stddev_pop(l_quantity) {w}, 5) AS std_{s}, min(l_quantity) {w} AS min_{s}, max(l_quantity) {w} AS max_{s},
      round(regr_slope(l_quantity, elapsed) {w}, 5) AS slope_{s}, round(l_quantity - first_value(l_quantity) {w}, 5) AS delta_{s}"""


@query(
    "W02_trailing_stats",
    f"""SELECT * EXCLUDE (n) FROM (SELECT run_id, tick, tick AS n, {', '.join(frame_sql(k) for k in (3, 6, 12))} FROM samples) WHERE n >= 12""",
    ("samples",),
)
def w02(spark, sf):
    rows = wh.samples(spark, sf).select(*KEYS, "elapsed", "l_quantity")
    out = features.drop_warmup(features.with_windows(rows, QUANTITY, ["run_id"], whole=True))
    columns = []
    for name in QUANTITY.windowed("l_quantity"):
        stat, width = name.split("__")[1].rsplit("_", 1)
        value = F.col(name) if stat in ("min", "max") else F.round(name, 5)
        columns.append(value.alias(f"{stat}_{width[:-1]}"))
    return out.select(*KEYS, *columns)


@query(
    "W03_drop_warmup",
    "SELECT run_id, count(*) FILTER (tick < 12) AS dropped, count(*) FILTER (tick >= 12) AS eligible FROM samples GROUP BY 1",
    ("samples",),
)
def w03(spark, sf):
    # counts per run need no order: a run drops its first 11 samples, or all of a shorter run
    rows = wh.raw_samples(spark, sf).groupBy("run_id").agg(F.count(F.lit(1)).alias("_n"))
    dropped = F.least(F.col("_n"), F.lit(features.WARMUP - 1).cast("long"))
    return rows.select("run_id", dropped.alias("dropped"), (F.col("_n") - dropped).alias("eligible"))


@query(
    "X08_safe_divide",
    """SELECT run_id, tick, CASE WHEN l_discount >= 0.01 THEN round(l_extendedprice / l_discount, 4) END AS value, l_discount >= 0.01 AS valid,
       CASE WHEN l_discount < 0.01 THEN 'near_zero_denominator' END AS reason FROM samples""",
    ("samples",),
)
def x08(spark, sf):
    result = features.ratio_struct(SPEC.ratios[0])
    return wh.samples(spark, sf).select(
        *KEYS, F.round(result["value"], 4).alias("value"), result["valid"].alias("valid"), result["reason"].alias("reason")
    )


@query(
    "X09_cross_signal",
    """SELECT run_id, tick, CASE WHEN l_discount >= 0.01 THEN round(l_extendedprice / l_discount, 4) END AS price_per_discount,
       CASE WHEN l_quantity >= 1.0 THEN round(l_tax / l_quantity, 9) END AS tax_per_quantity FROM samples""",
    ("samples",),
)
def x09(spark, sf):
    second = features.ratio_struct(Ratio("tax_per_quantity", "l_tax", "l_quantity", 1.0))
    return wh.samples(spark, sf).select(
        *KEYS,
        F.round(features.ratio_struct(SPEC.ratios[0])["value"], 4).alias("price_per_discount"),
        F.round(second["value"], 9).alias("tax_per_quantity"),
    )


@query(
    "X10_healthy_residuals",
    "SELECT run_id, tick, round(l_tax - (0.02 + l_quantity / 50.0 * 0.04), 9) AS tax_residual FROM samples",
    ("samples",),
)
def x10(spark, sf):
    return wh.samples(spark, sf).select(*KEYS, F.round(features.residual_value(SPEC.residuals[0]), 9).alias("tax_residual"))


@query(
    "X11_derived_telemetry",
    """SELECT run_id, tick, round_even(l_quantity / 7.3::DOUBLE * l_tax / 1000.0, 4) AS power, round_even(least(100.0, (l_quantity / 7.3::DOUBLE * l_tax / 1000.0) / greatest(l_discount * 0.033, 1e-6) * 100.0), 4) AS efficiency FROM samples""",
    ("samples",),
)
def x11(spark, sf):
    derived = features.derived_telemetry(F.col("l_quantity") / 7.3, F.col("l_tax"), F.col("l_discount"))
    return wh.samples(spark, sf).select(*KEYS, derived["power"].alias("power"), derived["efficiency"].alias("efficiency"))


W12 = "OVER (PARTITION BY run_id ORDER BY tick ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"
relation(
    "feature_rows",
    f"""SELECT * FROM (SELECT run_id, tick, elapsed, split, l_quantity, l_discount, l_quantity - lag(l_quantity) OVER (PARTITION BY run_id ORDER BY tick) AS diff, avg(l_discount) {W12} AS mean_discount,
         max(l_quantity) {W12} AS max_quantity, l_tax - (0.02 + l_quantity / 50.0 * 0.04) AS residual, l_discount >= 0.01 AS valid FROM samples) WHERE tick >= 12""",
    "samples",
)


@query(
    "X12_feature_row",
    """SELECT run_id, tick, round(diff, 6) AS diff, round(mean_discount, 6) AS mean_discount, max_quantity, round(residual, 9) AS residual, valid AS is_valid,
       CASE WHEN valid THEN '' ELSE 'near_zero_denominator' END AS reasons, CASE WHEN valid THEN '' ELSE 'price_per_discount' END AS invalid FROM feature_rows""",
    ("feature_rows",),
)
def x12(spark, sf):
    return built(spark, sf).select(
        *KEYS,
        F.round("l_quantity__diff_10s", 6).alias("diff"),
        F.round("l_discount__mean_120s", 6).alias("mean_discount"),
        F.col("l_quantity__max_120s").alias("max_quantity"),
        F.round("tax__residual", 9).alias("residual"),
        "is_valid",
        F.array_join("reason_codes", "|").alias("reasons"),
        F.array_join("invalid_feature_names", "|").alias("invalid"),
    )


@query("X18_derive_label", "SELECT run_id, derived_label AS label, count(*) AS rows FROM truth GROUP BY 1, 2", ("truth",))
def x18(spark, sf):
    labelled = features.label_rows(truth(spark, sf))
    return labelled.groupBy("run_id", F.col("class_label").alias("label")).agg(F.count(F.lit(1)).alias("rows"))


@query(
    "X19_compute_ground_truth",
    """SELECT run_id, tick, fault_active, round(fault_severity, 9) AS fault_severity, seconds_since_fault_start, CASE WHEN fault_type = 'A' THEN 'A' ELSE 'none' END AS fault_type, corruption FROM truth""",
    ("truth",),
)
def x19(spark, sf):
    return truth(spark, sf).select(
        *KEYS, "fault_active", F.round("fault_severity", 9).alias("fault_severity"), "seconds_since_fault_start", "fault_type", "corruption"
    )


@query(
    "X21_diagnostics_json",
    """SELECT run_id, tick, '{"l_discount":' || CAST(l_discount AS VARCHAR) || '}' AS diagnostics FROM samples WHERE l_discount < 0.01""",
    ("samples",),
)
def x21(spark, sf):
    out = features.with_point_features(wh.samples(spark, sf), SPEC)
    return out.filter(~F.col("is_valid")).select(*KEYS, F.col("diagnostic_values_json").alias("diagnostics"))


@query(
    "P15_feature_columns",
    "SELECT run_id, tick, l_quantity, l_extendedprice, l_discount, l_tax FROM samples",
    ("samples",),
)
def p15(spark, sf):
    return wh.samples(spark, sf).select(*KEYS, *features.feature_columns(SPEC, "A"))


@query("P16_assert_no_forbidden")
def p16(spark, sf):
    columns = features.feature_columns(SPEC)
    features.assert_no_forbidden(columns)
    return built(spark, sf).select(*columns).groupBy().agg(F.count(F.lit(1)).alias("rows"), F.lit(len(columns)).alias("columns"))


@query(
    "P11_target_asset_only",
    """SELECT s.run_id, tick FROM samples s JOIN supplier p ON s.run_id = p.s_suppkey WHERE s.l_linenumber = p.s_nationkey % 7 + 1""",
    ("samples",),
)
def p11(spark, sf):
    targets = wh.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("run_id"), (F.col("s_nationkey") % 7 + 1).alias("l_linenumber")
    )
    return wh.samples(spark, sf).join(targets, ["run_id", "l_linenumber"]).select(*KEYS)


@query(
    "P12_healthy_segment",
    "SELECT run_id, tick FROM samples JOIN runs USING (run_id) WHERE fault_start IS NULL OR elapsed < fault_start",
    ("samples", "runs"),
)
def p12(spark, sf):
    starts = wh.runs(spark, sf).select("run_id", "fault_start")
    return wh.samples(spark, sf).join(starts, "run_id").filter(
        F.col("fault_start").isNull() | (F.col("elapsed") < F.col("fault_start"))
    ).select(*KEYS)


def labels(spark, sf):
    return features.label_rows(truth(spark, sf)).select("run_id", "tick", "class_label", "is_anomalous", "fault_severity")


@query(
    "J01_join_features_labels",
    """SELECT f.run_id, f.tick, round(f.diff, 6) AS diff, t.derived_label AS class_label FROM feature_rows f JOIN truth t ON f.run_id = t.run_id AND f.tick = t.tick WHERE f.valid""",
    ("feature_rows", "truth"),
)
def j01(spark, sf):
    valid = built(spark, sf, SPEC).filter("is_valid").select(*KEYS, F.round("l_quantity__diff_10s", 6).alias("diff"))
    eligible = labels(spark, sf).join(valid.select(*KEYS), KEYS, "left_semi")
    return joins.strict_one_to_one(valid, eligible, KEYS).select(*KEYS, "diff", "class_label")


@query(
    "J02_attach_seconds_since_fault",
    "SELECT f.run_id, f.tick, coalesce(t.seconds_since_fault_start, 'nan'::DOUBLE) AS seconds FROM feature_rows f JOIN truth t ON f.run_id = t.run_id AND f.tick = t.tick",
    ("feature_rows", "truth"),
)
def j02(spark, sf):
    rows = features.drop_warmup(wh.samples(spark, sf)).select(*KEYS)
    seconds = truth(spark, sf).select(*KEYS, "seconds_since_fault_start")
    return rows.join(seconds, KEYS, "left").select(*KEYS, F.coalesce("seconds_since_fault_start", F.lit(float("nan"))).alias("seconds"))


@query(
    "J03_attach_run_metadata",
    "SELECT run_id, tick, class_label, severity FROM samples JOIN runs USING (run_id)",
    ("samples", "runs"),
)
def j03(spark, sf):
    # the runs table grows with the data, so its size decides between broadcast and shuffle at run time
    return wh.samples(spark, sf).join(wh.runs(spark, sf).drop("split"), "run_id").select(*KEYS, "class_label", "severity")


@query(
    "J04_eligible_ground_truth",
    "SELECT t.run_id, t.tick, t.fault_active FROM truth t JOIN feature_rows f ON f.run_id = t.run_id AND f.tick = t.tick WHERE f.valid",
    ("feature_rows", "truth"),
)
def j04(spark, sf):
    eligible = features.drop_warmup(features.with_point_features(wh.samples(spark, sf), SPEC)).filter("is_valid").select(*KEYS)
    return truth(spark, sf).join(eligible, KEYS, "left_semi").select(*KEYS, "fault_active")


@query(
    "U03_merge_valid_rejected",
    """SELECT run_id, tick, valid, CASE WHEN valid THEN p_A ELSE 0 END AS "p_A" FROM (SELECT *, l_discount >= 0.01 AS valid FROM scored)""",
    ("scored",),
)
def u03(spark, sf):
    rows = features.with_point_features(wh.scored(spark, sf), SPEC)
    good = rows.filter("is_valid").select(*KEYS, "p_A", F.lit(True).alias("valid"))
    gaps = rows.filter(~F.col("is_valid")).select(*KEYS, F.lit(False).alias("valid"))
    return good.unionByName(gaps, allowMissingColumns=True).fillna({"p_A": 0.0})


# --- dataset tables -----------------------------------------------------------------


def long_tables(spark, sf):
    """Telemetry (one row per sample and signal) and ground truth in the declared dataset layout."""
    base = truth(spark, sf)
    stamp = F.timestamp_micros((F.col("elapsed") * 1_000_000).cast("long"))
    head = [
        F.lit("ds").alias("dataset_id"),
        F.col("run_id").cast("string").alias("simulation_run_id"),
        stamp.alias("timestamp"),
        F.col("elapsed").alias("elapsed_sim_seconds"),
        F.concat(F.lit("asset-"), (F.col("run_id") % 4).cast("string")).alias("asset_id"),
    ]
    signals = F.array(*[F.struct(F.lit(s).alias("measurement_type"), F.col(s).alias("value")) for s in wh.SIGNALS])
    telemetry = base.select(*head, "tick", F.explode(signals).alias("_s")).select("*", "_s.*").drop("_s")
    telemetry = telemetry.withColumn("observation_id", F.concat_ws("-", "simulation_run_id", "tick", "measurement_type")).withColumn("unit", F.lit("u"))
    ground = base.select(
        *head, "fault_type", "fault_active", "fault_severity", "seconds_since_fault_start", F.col("corruption").alias("sensor_corruption_type")
    )
    return telemetry, ground


def exported(spark, sf):
    path = dataset.scratch_dir(spark) + "/dataset"
    telemetry, ground = long_tables(spark, sf)
    dataset.write_dataset(path, telemetry, ground, wh.runs(spark, sf))
    return path


@query(
    "S05_write_dataset",
    """SELECT name, rows FROM (SELECT 'telemetry' AS name, 4 * count(*) AS rows FROM samples UNION ALL SELECT 'ground_truth', count(*) FROM samples UNION ALL SELECT 'runs', count(*) FROM runs)""",
    ("samples", "runs"),
)
def s05(spark, sf):
    tables = dataset.load_dataset(spark, exported(spark, sf))
    parts = [t.agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("rows")) for n, t in tables.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "S06_load_dataset",
    """SELECT CAST(run_id AS VARCHAR) AS simulation_run_id, count(*) AS rows, round(sum(l_quantity), 4) AS quantity FROM samples GROUP BY 1""",
    ("samples",),
)
def s06(spark, sf):
    telemetry = dataset.load_dataset(spark, exported(spark, sf))["telemetry"].filter(F.col("measurement_type") == "l_quantity")
    return telemetry.groupBy("simulation_run_id").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("value"), 4).alias("quantity"))


@query(
    "S07_write_features",
    """SELECT 'features' AS name, count(*) FILTER (valid) AS rows FROM feature_rows UNION ALL SELECT 'rejections', count(*) FILTER (NOT valid) FROM feature_rows
       UNION ALL SELECT 'labels', count(*) FILTER (valid) FROM feature_rows""",
    ("feature_rows",),
)
def s07(spark, sf):
    path = dataset.scratch_dir(spark) + "/features"
    write_features(spark, sf, path)
    eligible = spark.read.parquet(f"{path}/features").select(*KEYS)
    dataset.write_labels(path, labels(spark, sf).join(eligible, KEYS, "left_semi"))
    parts = [spark.read.parquet(f"{path}/{n}").agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("rows")) for n in ("features", "rejections", "labels")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "S11_table_manifest",
    """SELECT 'fault_severity' AS "column", count(*) AS rows, count(*) FILTER (NOT fault_active) AS nulls FROM truth UNION ALL SELECT 'class_label', count(*), 0 FROM truth
       UNION ALL SELECT 'reason:near_zero_denominator', count(*), count(*) FILTER (l_discount < 0.01) FROM truth""",
    ("truth",),
)
def s11(spark, sf):
    counted = dataset.null_counts(labels(spark, sf), ["fault_severity", "class_label"])
    rejected = features.with_point_features(wh.samples(spark, sf), SPEC).agg(
        F.lit("reason:near_zero_denominator").alias("column"), F.count(F.lit(1)).alias("rows"), F.sum(F.size("reason_codes")).alias("nulls")
    )
    return counted.unionByName(rejected)


@query("S11_file_manifest")
def s11f(spark, sf):
    return dataset.file_manifest(spark, exported(spark, sf))


@query(
    "S11_rejections",
    """SELECT kind, name, count(*) AS rows FROM feature_rows, (VALUES ('invalid_feature_names', 'price_per_discount'), ('reason_codes', 'near_zero_denominator')) t(kind, name) WHERE NOT valid GROUP BY ALL""",
    ("feature_rows",),
)
def s11r(spark, sf):
    """Reasons and features of the rejections table, as the manifest counts them."""
    path = dataset.scratch_dir(spark) + "/features"
    write_features(spark, sf, path)
    return metrics.rejection_counts(spark.read.parquet(f"{path}/rejections"))
