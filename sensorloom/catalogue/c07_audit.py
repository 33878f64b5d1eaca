"""Data-quality and audit queries over the samples, runs and dataset tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom.catalogue.c04_alerts import evaluated
from sensorloom.catalogue.c06_features import KEYS, SPEC, built, exported, fault_runs, long_tables, truth
from sensorloom.catalogue.registry import ORACLES, query, relation
from sensorloom.lineage import cut_lineage
from sensorloom.operators import audit, fingerprints, joins, metrics, series
from sensorloom.sources import dataset, files
from sensorloom.sources import warehouse as wh

SIGNALS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
ASSETS = ["asset-0", "asset-1", "asset-2", "asset-3"]
relation(
    "long_rows",
    " UNION ALL ".join(
        f"SELECT run_id, tick, elapsed, fault_class, fault_start, fault_duration, severity, '{s}' AS measurement, {s} AS value FROM diagnosed_rows" for s in SIGNALS
    ),
    "diagnosed_rows",
)


def long_samples(rows):
    pairs = F.array(*[F.struct(F.lit(s).alias("measurement"), F.col(s).alias("value")) for s in SIGNALS])
    keep = [c for c in rows.columns if c not in SIGNALS]
    return rows.select(*keep, F.explode(pairs).alias("_p")).select(*keep, "_p.*")


def phased(spark, sf):
    return long_samples(audit.phases(wh.samples(spark, sf).drop("split"), wh.runs(spark, sf)))


relation(
    "phased",
    """SELECT *, CASE WHEN elapsed < fault_start THEN 'pre' ELSE 'active' END AS phase FROM long_rows WHERE elapsed >= greatest(0, fault_start - fault_duration) AND elapsed < fault_start + fault_duration""",
    "long_rows",
)
relation(
    "effects",
    """SELECT *, median_active - median_pre AS change FROM (SELECT run_id, fault_class AS class_label, any_value(severity) AS severity, measurement, quantile_cont(value, 0.5) FILTER (phase = 'pre') AS median_pre,
       quantile_cont(value, 0.5) FILTER (phase = 'active') AS median_active FROM phased GROUP BY run_id, fault_class, measurement) WHERE median_pre IS NOT NULL AND median_active IS NOT NULL""",
    "phased",
)
relation(
    "fault_effects",
    """SELECT class_label, measurement, n_runs, median_pre, median_active, median_change, m AS majority_direction, CASE m WHEN 1 THEN up WHEN -1 THEN down ELSE 0 END / n_runs AS direction_consistency FROM (
       SELECT *, CASE WHEN up + down = 0 THEN 0 WHEN up >= down THEN 1 ELSE -1 END AS m FROM (
         SELECT e.class_label, e.measurement, count(*) AS n_runs, any_value(mp) AS median_pre, any_value(ma) AS median_active, any_value(mc) AS median_change,
           count(*) FILTER (change > greatest(1e-6, 0.01 * abs(mp))) AS up, count(*) FILTER (change < -greatest(1e-6, 0.01 * abs(mp))) AS down
         FROM effects e JOIN (SELECT class_label, measurement, quantile_cont(median_pre, 0.5) AS mp, quantile_cont(median_active, 0.5) AS ma, quantile_cont(change, 0.5) AS mc FROM effects GROUP BY 1, 2) USING (class_label, measurement)
         GROUP BY 1, 2))""",
    "effects",
)


def fault_effects(spark, sf):
    return audit.fault_effects(audit.run_effects(phased(spark, sf)))


@query(
    "J10_pre_active_windows",
    "SELECT run_id, measurement, phase, count(*) AS rows, round(sum(value), 4) AS total FROM phased GROUP BY 1, 2, 3",
    ("phased",),
)
def j10(spark, sf):
    return phased(spark, sf).groupBy("run_id", "measurement", "phase").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum("value"), 4).alias("total")
    )


@query(
    "A06_numeric_profile",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS stdev, count(DISTINCT round_even({c}, 6)) AS "distinct" FROM runs"""
        for c in ("fault_start", "fault_duration", "severity", "load_baseline")
    ),
    ("runs",),
)
def a06(spark, sf):
    out = audit.numeric_profile(wh.runs(spark, sf), ["fault_start", "fault_duration", "severity", "load_baseline"])
    return out.withColumn("mean", F.round("mean", 6)).withColumn("stdev", F.round("stdev", 6))


relation("placed_runs", "SELECT *, 'asset-' || (s_nationkey % 4) AS asset_id FROM runs JOIN (SELECT s_suppkey AS run_id, s_nationkey FROM supplier) USING (run_id)", "runs")


def placed_runs(spark, sf):
    nation = wh.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("run_id"), F.concat(F.lit("asset-"), (F.col("s_nationkey") % 4).cast("string")).alias("asset_id")
    )
    return fault_runs(spark, sf).join(nation, "run_id")


@query(
    "A07_class_split_counts",
    """SELECT CASE grouping(class_label, asset_id, split) WHEN 3 THEN 'class' WHEN 5 THEN 'asset' WHEN 6 THEN 'split' WHEN 2 THEN 'class/split' ELSE 'all' END AS level, class_label, asset_id, split, count(*) AS runs
       FROM placed_runs GROUP BY GROUPING SETS ((class_label), (asset_id), (split), (class_label, split), (class_label, asset_id, split))""",
    ("placed_runs",),
)
def a07(spark, sf):
    return audit.class_split_counts(placed_runs(spark, sf))


@query(
    "A08_fault_effect",
    """SELECT class_label, measurement, n_runs, round(median_pre, 6) AS median_pre, round(median_active, 6) AS median_active, round(median_change, 6) AS median_change, majority_direction,
       round(direction_consistency, 9) AS direction_consistency FROM fault_effects""",
    ("fault_effects",),
)
def a08(spark, sf):
    out = fault_effects(spark, sf)
    out = out.withColumns({c: F.round(c, 6) for c in ("median_pre", "median_active", "median_change")})
    return out.withColumn("direction_consistency", F.round("direction_consistency", 9))


@query(
    "A08_effect_by_severity",
    """SELECT class_label, measurement, CASE WHEN severity < 0.4 THEN 'low' WHEN severity < 0.7 THEN 'mid' ELSE 'high' END AS band, round(quantile_cont(change, 0.5), 6) AS median_change FROM effects
       WHERE severity < 1.0001 GROUP BY 1, 2, 3""",
    ("effects",),
)
def a08s(spark, sf):
    return audit.effect_by_severity(audit.run_effects(phased(spark, sf))).withColumn("median_change", F.round("median_change", 6))


SIGNATURES = [
    ("A", "l_quantity", 1, True), ("A", "l_extendedprice", 0, True), ("A", "l_discount", -1, False), ("A", "l_tax", 0, False),
    ("R", "l_quantity", -1, True), ("R", "l_extendedprice", 1, False), ("R", "l_discount", 0, True), ("R", "l_tax", 1, True),
]
relation("signatures", "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', {c}, {str(d).lower()})" for a, b, c, d in SIGNATURES) + ") t(class_label, measurement, expected, hard)")
relation(
    "graded",
    """SELECT class_label, measurement, n_runs, direction_consistency, CASE WHEN n_runs IS NULL THEN soft WHEN expected <> 0 THEN CASE WHEN majority_direction = expected AND direction_consistency >= 0.7 THEN 'matches'
         WHEN majority_direction = -expected AND direction_consistency >= 0.7 THEN grave ELSE soft END
       ELSE CASE WHEN majority_direction = 0 OR direction_consistency <= 0.5 THEN 'matches' WHEN direction_consistency < 0.85 OR n_runs < 10 THEN soft ELSE grave END END AS status FROM (
       SELECT s.*, n_runs, majority_direction, direction_consistency, CASE WHEN hard THEN 'concerning' ELSE 'acceptable' END AS soft, CASE WHEN hard AND n_runs >= 5 THEN 'blocking' ELSE 'concerning' END AS grave
       FROM signatures s LEFT JOIN fault_effects USING (class_label, measurement))""",
    "signatures",
    "fault_effects",
)


def graded(spark, sf):
    table = spark.createDataFrame(SIGNATURES, "class_label string, measurement string, expected int, hard boolean")
    return audit.signature_status(fault_effects(spark, sf), table)


@query("A09_signature_status", "SELECT class_label, measurement, status FROM graded", ("graded",))
def a09(spark, sf):
    return graded(spark, sf).select("class_label", "measurement", "status")


@query(
    "Q17_physical_signature",
    """SELECT class_label || ':' || measurement AS detail, CASE status WHEN 'blocking' THEN 'blocking' ELSE 'medium' END AS severity FROM graded WHERE status IN ('blocking', 'concerning')""",
    ("graded",),
)
def q17(spark, sf):
    return signature_findings(spark, sf).select("detail", "severity")


def signature_findings(spark, sf):
    bad = graded(spark, sf).filter(F.col("status").isin("blocking", "concerning"))
    return bad.select(
        F.lit("signature").alias("check"), F.when(F.col("status") == "blocking", "blocking").otherwise("medium").alias("severity"),
        F.lit("physical").alias("category"), F.lit(1).cast("long").alias("rows"), F.concat_ws(":", "class_label", "measurement").alias("detail"),
    )


relation("active_rows", "SELECT fault_class AS class_label, measurement, value, run_id FROM long_rows WHERE elapsed >= fault_start AND elapsed < fault_start + fault_duration", "long_rows")
relation("healthy_rows", "SELECT measurement, value, run_id FROM long_rows WHERE fault_class = 'normal'", "long_rows")


def active_and_healthy(spark, sf):
    rows = long_samples(evaluated(spark, sf).select("run_id", "elapsed", "fault_class", "fault_start", "fault_duration", *SIGNALS))
    t, start = F.col("elapsed"), F.col("fault_start")
    active = rows.filter((t >= start) & (t < start + F.col("fault_duration"))).withColumnRenamed("fault_class", "class_label")
    return active, rows.filter(F.col("fault_class") == "normal")


@query(
    "A10_class_ranges",
    "SELECT class_label, measurement, count(*) AS count, min(value) AS min, max(value) AS max, round(quantile_cont(value, 0.5), 6) AS median FROM active_rows GROUP BY 1, 2",
    ("active_rows",),
)
def a10(spark, sf):
    active, _ = active_and_healthy(spark, sf)
    return audit.class_ranges(active).withColumn("median", F.round("median", 6))


def threshold_sql(keys: str, source: str, is_fault: str) -> str:
    return f"""WITH c AS (SELECT {keys}, value, count(*) FILTER ({is_fault}) AS f, count(*) FILTER (NOT ({is_fault})) AS h FROM {source} GROUP BY {keys}, value),
      w AS (SELECT {keys}, value, lead(value) OVER x AS nxt, sum(f) OVER x AS cf, sum(h) OVER x AS ch, sum(f) OVER (PARTITION BY {keys}) AS tf, sum(h) OVER (PARTITION BY {keys}) AS th FROM c WINDOW x AS (PARTITION BY {keys} ORDER BY value)),
      s AS (SELECT {keys}, nxt, 0.5::DOUBLE * ((tf - cf) / tf + ch / th) AS above FROM w WHERE nxt IS NOT NULL AND tf > 0 AND th > 0),
      b AS (SELECT {keys}, nxt, side, score FROM (SELECT {keys}, nxt, 'above' AS side, above AS score, 0 AS o FROM s UNION ALL SELECT {keys}, nxt, 'below', 1.0 - above, 1 FROM s)
            QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, nxt, o) = 1)
      SELECT {keys}, CASE WHEN score > 0.5 THEN score ELSE 0.5 END AS balanced_accuracy, nxt AS threshold, side FROM b"""


relation("split_rows", "SELECT measurement, value, fault_class <> 'normal' AS is_fault FROM long_rows", "long_rows")
relation("best_split", threshold_sql("measurement", "split_rows", "is_fault"), "split_rows")


def best_split(spark, sf):
    labels = wh.runs(spark, sf).select("run_id", (F.col("class_label") != "normal").alias("is_fault"))
    rows = long_samples(wh.raw_samples(spark, sf).join(labels, "run_id").select("run_id", "split", "is_fault", *SIGNALS))
    return rows, metrics.best_threshold(rows, ["measurement"], "value", F.col("is_fault"))


@query(
    "A11_best_threshold",
    "SELECT measurement, round(balanced_accuracy, 9) AS balanced_accuracy, threshold, side FROM best_split",
    ("best_split",),
)
def a11(spark, sf):
    return best_split(spark, sf)[1].withColumn("balanced_accuracy", F.round("balanced_accuracy", 9))


@query(
    "A12_apply_threshold_rule",
    """SELECT measurement, round(0.5 * (avg(hit) FILTER (is_fault) + avg(1 - hit) FILTER (NOT is_fault)), 9) AS balanced_accuracy FROM (
       SELECT measurement, is_fault, CASE WHEN side = 'below' THEN value < threshold ELSE value >= threshold END::INT::DOUBLE AS hit FROM split_rows JOIN best_split USING (measurement)) GROUP BY 1""",
    ("split_rows", "best_split"),
)
def a12(spark, sf):
    rows, rules = best_split(spark, sf)
    applied = rows.join(F.broadcast(rules), "measurement")  # one rule per measurement
    score = metrics.threshold_rule_accuracy(F.col("value"), F.col("threshold"), F.col("side"), F.col("is_fault"))
    return applied.groupBy("measurement").agg(F.round(score, 9).alias("balanced_accuracy"))


relation(
    "edges",
    """SELECT class_label, max(load_baseline) FILTER (rk = CASE WHEN n >= 3 THEN n // 3 ELSE 0 END) AS low_edge, max(load_baseline) FILTER (rk = CASE WHEN n >= 3 THEN 2 * n // 3 ELSE 0 END) AS high_edge FROM (
       SELECT class_label, load_baseline, row_number() OVER (PARTITION BY class_label ORDER BY load_baseline) - 1 AS rk, count(*) OVER (PARTITION BY class_label) AS n FROM runs) GROUP BY 1""",
    "runs",
)
relation(
    "banded_runs",
    "SELECT run_id, class_label, CASE WHEN load_baseline <= low_edge THEN 'low' WHEN load_baseline >= high_edge THEN 'high' ELSE 'mid' END AS band FROM runs JOIN edges USING (class_label)",
    "edges",
    "runs",
)


def banded_runs(spark, sf):
    runs = wh.runs(spark, sf)
    edges = metrics.band_edges(runs, ["class_label"], "load_baseline")
    band = metrics.band_for(F.col("load_baseline"), F.col("low_edge"), F.col("high_edge"))
    return runs.join(F.broadcast(edges), "class_label").select("run_id", "class_label", band.alias("band"))  # one row per class


@query("A13_load_bands", "SELECT * FROM banded_runs", ("banded_runs",))
def a13(spark, sf):
    return banded_runs(spark, sf)


relation(
    "separable",
    "SELECT h.measurement, h.value, c.class_label, false AS is_fault, b.band FROM healthy_rows h JOIN banded_runs b USING (run_id), (SELECT DISTINCT class_label FROM active_rows) c UNION ALL SELECT a.measurement, a.value, a.class_label, true, b.band FROM active_rows a JOIN banded_runs b USING (run_id)",
    "healthy_rows",
    "active_rows",
    "banded_runs",
)
relation("separable_best", threshold_sql("class_label, measurement, band", "separable", "is_fault"), "separable")
relation("separable_all", threshold_sql("class_label, measurement", "separable", "is_fault"), "separable")


@query(
    "A14_separability_by_band",
    """SELECT class_label, measurement, band, round(greatest(0.5, balanced_accuracy), 9) AS balanced_accuracy FROM separable_best""",
    ("separable_best",),
)
def a14(spark, sf):
    active, healthy = active_and_healthy(spark, sf)
    bands = banded_runs(spark, sf).select("run_id", "band")
    out = audit.separability(healthy.join(bands, "run_id"), active.join(bands, "run_id"), ["band"])
    return out.withColumn("balanced_accuracy", F.round("balanced_accuracy", 9))


@query(
    "A15_severity_effect_corr",
    """SELECT class_label, measurement, count(*) AS pairs, CASE WHEN count(*) >= 3 AND min(severity) < max(severity) AND min(abs(change)) < max(abs(change)) THEN round(corr(severity, abs(change)), 8) END AS correlation FROM effects GROUP BY 1, 2""",
    ("effects",),
)
def a15(spark, sf):
    return audit.severity_correlation(audit.run_effects(phased(spark, sf))).withColumn("correlation", F.round("correlation", 8))


@query(
    "Q16_trivially_separable",
    """SELECT class_label, measurement, balanced_accuracy >= 0.51 AS flagged FROM separable_all""",
    ("separable_all",),
)
def q16(spark, sf):
    active, healthy = active_and_healthy(spark, sf)
    out = audit.separability(healthy, active)
    return out.select("class_label", "measurement", (F.col("balanced_accuracy") >= 0.51).alias("flagged"))


@query("Q01_schema_check")
def q01(spark, sf):
    path = exported(spark, sf)
    return audit.schema_status(spark, "telemetry", spark.read.parquet(f"{path}/telemetry").schema, dataset.TELEMETRY)


@query(
    "Q02_unexpected_nulls",
    """SELECT 'fault_severity' AS "column", count(*) AS rows, 0 AS nulls FROM truth UNION ALL SELECT 'seconds_since_fault_start', count(*), count(*) FILTER (NOT fault_active) FROM truth UNION ALL SELECT 'fault_active', count(*), 0 FROM truth""",
    ("truth",),
)
def q02(spark, sf):
    return dataset.null_counts(truth(spark, sf), ["fault_severity", "seconds_since_fault_start", "fault_active"])


@query(
    "Q03_manifest_row_counts",
    """SELECT run_id, 600::BIGINT AS declared_rows, count(*) AS actual_rows FROM samples GROUP BY run_id HAVING count(*) <> 600""",
    ("samples",),
)
def q03(spark, sf):
    actual = wh.raw_samples(spark, sf).groupBy("run_id").agg(F.count(F.lit(1)).alias("actual_rows"))
    declared = wh.runs(spark, sf).select("run_id", F.lit(600).cast("long").alias("declared_rows"))
    return audit.row_count_mismatches(actual, declared, "run_id").select("run_id", "declared_rows", "actual_rows")


@query("Q04_file_hashes")
def q04(spark, sf):
    actual = dataset.file_manifest(spark, exported(spark, sf))
    declared = actual.withColumn("sha256", F.when(F.col("size_bytes") % 2 == 0, F.col("sha256")).otherwise("stale"))
    changed = dataset.compare_manifest(actual, declared)
    return actual.agg(F.count(F.lit(1)).alias("files")).crossJoin(changed.agg(F.count(F.lit(1)).alias("changed")))  # one row each


@query(
    "Q05_plan_counts",
    """WITH a AS (SELECT class_label, asset_id, count(*) AS actual FROM placed_runs GROUP BY 1, 2), c AS (SELECT class_label, count(*) AS n FROM placed_runs GROUP BY 1),
       e AS (SELECT class_label, 'asset-' || i AS asset_id, (n + 3 - i) // 4 AS expected FROM c, range(0, 4) t(i))
       SELECT class_label, asset_id, coalesce(expected, 0) AS expected, coalesce(actual, 0) AS actual FROM (SELECT * FROM e WHERE expected > 0) FULL JOIN a USING (class_label, asset_id) WHERE coalesce(expected, 0) <> coalesce(actual, 0)""",
    ("placed_runs",),
)
def q05(spark, sf):
    return audit.plan_mismatches(placed_runs(spark, sf), ASSETS).select("class_label", "asset_id", "expected", "actual")


relation("membership", "SELECT run_id, split FROM runs WHERE run_id % 11 <> 0 UNION SELECT run_id, 'test' FROM runs WHERE run_id % 7 = 0 UNION SELECT run_id + 1000000, 'train' FROM runs WHERE run_id % 13 = 0", "runs")


def membership(spark, sf):
    """Split lists with planted faults: missing, repeated and unknown runs."""
    runs = wh.runs(spark, sf)
    key = F.col("run_id")
    lists = F.array_compact(
        F.array(
            F.when(key % 11 != 0, F.struct(key.alias("run_id"), F.col("split").alias("split"))),
            F.when(key % 7 == 0, F.struct(key.alias("run_id"), F.lit("test").alias("split"))),
            F.when(key % 13 == 0, F.struct((key + 1_000_000).alias("run_id"), F.lit("train").alias("split"))),
        )
    )
    return runs.select(F.explode(lists).alias("_m")).select("_m.*").distinct()


OVERLAP = """WITH m AS (SELECT run_id, bool_or(split = 'train') AS a, bool_or(split = 'validation') AS b, bool_or(split = 'test') AS c FROM membership GROUP BY 1)
  SELECT 'train/validation' AS "check", count(*) FILTER (a AND b) AS rows FROM m UNION ALL SELECT 'train/test', count(*) FILTER (a AND c) FROM m UNION ALL SELECT 'validation/test', count(*) FILTER (b AND c) FROM m
  UNION ALL SELECT 'missing_from_splits', count(*) FROM runs WHERE run_id NOT IN (SELECT run_id FROM m) UNION ALL SELECT 'unknown_in_splits', count(*) FROM m WHERE run_id NOT IN (SELECT run_id FROM runs)"""


@query("U02_split_overlap", OVERLAP, ("membership", "runs"))
def u02(spark, sf):
    return audit.split_overlaps(membership(spark, sf), wh.runs(spark, sf))


@query("Q06_split_checks", f"SELECT * FROM ({OVERLAP}) WHERE rows > 0", ("membership", "runs"))
def q06(spark, sf):
    return audit.split_overlaps(membership(spark, sf), wh.runs(spark, sf)).filter(F.col("rows") > 0)


@query(
    "U01_missing_extra",
    """SELECT run_id, 'extra' AS side FROM membership WHERE run_id NOT IN (SELECT run_id FROM runs) UNION SELECT run_id, 'missing' FROM runs WHERE run_id NOT IN (SELECT run_id FROM membership)""",
    ("membership", "runs"),
)
def u01(spark, sf):
    return joins.two_way_anti(membership(spark, sf), wh.runs(spark, sf), ["run_id"], "extra", "missing")


DANGLING = """SELECT o_custkey AS custkey, 'unknown_run' AS side FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) UNION
  SELECT c_custkey, 'run_without_rows' FROM customer WHERE c_acctbal > 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders)"""


@query("J05_dangling_references", DANGLING)
def j05(spark, sf):
    facts = wh.table(spark, sf, "orders").select(F.col("o_custkey").alias("custkey"))
    known = wh.table(spark, sf, "customer").filter(F.col("c_acctbal") > 0).select(F.col("c_custkey").alias("custkey"))
    return joins.two_way_anti(facts, known, ["custkey"], "unknown_run", "run_without_rows")


@query("Q07_row_references", f"SELECT side AS \"check\", count(*) AS rows FROM ({DANGLING}) GROUP BY 1")
def q07(spark, sf):
    return j05(spark, sf).groupBy(F.col("side").alias("check")).agg(F.count(F.lit(1)).alias("rows"))


CADENCE = """SELECT run_id, coalesce(bool_and(d > 0), true) AS monotonic, coalesce(bool_and(abs(d - 86400) <= 1e-6), true) AS regular FROM (
  SELECT run_id, epoch(l_shipdate) - lag(epoch(l_shipdate)) OVER (PARTITION BY run_id ORDER BY tick) AS d FROM samples) GROUP BY 1"""


def cadence(spark, sf):
    rows = wh.samples(spark, sf).withColumn("seconds", F.unix_micros(F.col("l_shipdate").cast("timestamp")) / 1_000_000)
    return audit.cadence_flags(rows, ["run_id"], "tick", "seconds", 86_400.0)


@query("W21_cadence_check", CADENCE, ("samples",))
def w21(spark, sf):
    return cadence(spark, sf)


@query("Q08_cadence_findings", f"SELECT count(*) FILTER (NOT monotonic) AS non_monotonic, count(*) FILTER (monotonic AND NOT regular) AS bad_cadence FROM ({CADENCE})", ("samples",))
def q08(spark, sf):
    return cadence(spark, sf).agg(
        F.count_if(~F.col("monotonic")).alias("non_monotonic"), F.count_if(F.col("monotonic") & ~F.col("regular")).alias("bad_cadence")
    )


@query(
    "Q09_unit_per_measurement",
    """SELECT l_returnflag AS measurement_type, count(DISTINCT l_linestatus) AS units, string_agg(DISTINCT l_linestatus, '|' ORDER BY l_linestatus) AS names FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linestatus) > 1""",
)
def q09(spark, sf):
    rows = wh.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("measurement_type"), F.col("l_linestatus").alias("unit"))
    return audit.unstable_units(rows)


@query(
    "Q10_duplicate_keys",
    """WITH d AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)
       SELECT (SELECT sum(n - 1)::BIGINT FROM d) AS rows, (SELECT string_agg(l_orderkey || '/' || l_linenumber, ',' ORDER BY l_orderkey, l_linenumber) FROM (SELECT * FROM d ORDER BY 1, 2 LIMIT 5)) AS examples""",
)
def q10(spark, sf):
    return audit.duplicate_keys(wh.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


# Reported truth with planted errors, derived from the sample itself.
relation(
    "reported",
    """SELECT run_id, tick, elapsed, run_class AS class_label, fault_active AS x_active, fault_severity AS x_severity, seconds_since_fault_start AS x_since, fault_type AS x_type, corruption AS x_corruption,
         CASE WHEN l_linenumber = 7 AND l_tax = 0.08 THEN NOT fault_active ELSE fault_active END AS fault_active, fault_severity - CASE WHEN l_discount = 0.05 THEN 0.01 ELSE 0 END AS fault_severity,
         CASE WHEN l_linenumber <> 6 OR l_tax > 0 THEN seconds_since_fault_start END AS seconds_since_fault_start, CASE WHEN l_quantity = 50 THEN 'other' ELSE fault_type END AS fault_type, corruption, l_linenumber <> 1 AS is_target FROM truth""",
    "truth",
)


def reported(spark, sf):
    base = truth(spark, sf)
    keep = ["fault_active", "fault_severity", "seconds_since_fault_start", "fault_type", "corruption"]
    out = base.select(
        *KEYS, "elapsed", F.col("run_class").alias("class_label"), "l_linenumber", "l_tax", "l_discount", "l_quantity", *keep,
        *[F.col(c).alias(f"x_{c}") for c in keep],
    )
    flip = (F.col("l_linenumber") == 7) & (F.col("l_tax") == 0.08)
    return out.withColumns(
        {
            "fault_active": F.when(flip, ~F.col("fault_active")).otherwise(F.col("fault_active")),
            "fault_severity": F.col("fault_severity") - F.when(F.col("l_discount") == 0.05, 0.01).otherwise(0.0),
            "seconds_since_fault_start": F.when((F.col("l_linenumber") != 6) | (F.col("l_tax") > 0), F.col("seconds_since_fault_start")),
            "fault_type": F.when(F.col("l_quantity") == 50, "other").otherwise(F.col("fault_type")),
            "is_target": F.col("l_linenumber") != 1,
        }
    )


@query(
    "Q11_labels_recomputed",
    """SELECT class_label, count(*) AS mismatches FROM reported WHERE fault_type <> x_type OR fault_active <> x_active OR abs(fault_severity - x_severity) > 1e-6 OR (seconds_since_fault_start IS NULL) <> (x_since IS NULL)
       OR coalesce(abs(seconds_since_fault_start - x_since) > 1e-6, false) GROUP BY 1""",
    ("reported",),
)
def q11(spark, sf):
    bad = reported(spark, sf).filter(audit.truth_mismatch())
    return bad.groupBy("class_label").agg(F.count(F.lit(1)).alias("mismatches"))


LABELLED = "(fault_type <> 'none' OR fault_active OR corruption <> 'none')"
relation(
    "label_problems",
    f"""SELECT 'non_target_labelled' AS "check", 'blocking' AS severity, count(*) FILTER (NOT is_target AND {LABELLED}) AS rows FROM reported
       UNION ALL SELECT 'inactive_nonzero_severity', 'blocking', count(*) FILTER (NOT fault_active AND fault_severity <> 0) FROM reported
       UNION ALL SELECT 'active_nonpositive_severity', 'high', count(*) FILTER (fault_active AND (fault_severity < 0 OR coalesce(seconds_since_fault_start > 0 AND fault_severity <= 0, false))) FROM reported
       UNION ALL SELECT 'null_mismatch', 'blocking', count(*) FILTER (fault_active = (seconds_since_fault_start IS NULL)) FROM reported
       UNION ALL SELECT 'class_mismatch', 'blocking', count(*) FILTER (is_target AND fault_active AND class_label <> 'normal' AND (fault_type <> CASE WHEN class_label = 'R' THEN 'none' ELSE class_label END
         OR corruption <> CASE WHEN class_label = 'R' THEN 'bias' ELSE 'none' END)) FROM reported
       UNION ALL SELECT 'healthy_run_labelled', 'blocking', count(*) FILTER (class_label = 'normal' AND {LABELLED}) FROM reported""",
    "reported",
)


@query("Q12_label_problems", "SELECT * FROM label_problems", ("label_problems",))
def q12(spark, sf):
    return audit.label_problems(reported(spark, sf), "normal", "R")


RAMP = """SELECT run_id, count(*) FILTER (fault_severity < prev - 1e-6) AS drops FROM (SELECT run_id, fault_severity - CASE WHEN l_discount = 0.05 THEN 0.01 ELSE 0 END AS fault_severity,
  lag(fault_severity - CASE WHEN l_discount = 0.05 THEN 0.01 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY tick) AS prev FROM truth WHERE fault_active) GROUP BY 1 HAVING count(*) FILTER (fault_severity < prev - 1e-6) > 0"""


def ramps(spark, sf):
    dented = truth(spark, sf).withColumn("fault_severity", F.col("fault_severity") - F.when(F.col("l_discount") == 0.05, 0.01).otherwise(0.0))
    return audit.falling_ramps(dented, ["run_id"])


@query("W22_monotone_ramp", RAMP, ("truth",))
def w22(spark, sf):
    return ramps(spark, sf)


@query("Q13_non_monotone_ramps", f"SELECT count(*) AS runs, sum(drops)::BIGINT AS drops FROM ({RAMP})", ("truth",))
def q13(spark, sf):
    return ramps(spark, sf).agg(F.count(F.lit(1)).alias("runs"), F.sum("drops").alias("drops"))


VARIATION = """SELECT 'out_of_range' AS "check", 'blocking' AS severity, 'load_baseline' AS detail, count(*) AS rows FROM runs WHERE load_baseline < -100.000001 OR load_baseline > 9000.000001 HAVING count(*) > 0
  UNION ALL SELECT 'start_off_grid', 'blocking', class_label, count(*) FROM (SELECT class_label, (fault_start - 1000.0) % 20.0 AS r FROM runs WHERE fault_start IS NOT NULL) WHERE r > 1e-6 AND r < 20 - 1e-6 GROUP BY class_label"""


def variation(spark, sf):
    return audit.variation_problems(wh.runs(spark, sf), ["load_baseline"], {"load_baseline": (-100.0, 9_000.0)}, (1_000.0, 20.0), "normal")


@query("Q14_variation", VARIATION, ("runs",))
def q14(spark, sf):
    return variation(spark, sf).select("check", "severity", "detail", "rows")


@query(
    "U05_classes_missing",
    """SELECT s AS split, c AS class_label FROM (SELECT DISTINCT asset_id AS s FROM placed_runs), (SELECT DISTINCT class_label AS c FROM placed_runs) WHERE (s, c) NOT IN (SELECT (asset_id, class_label) FROM placed_runs WHERE severity IS NULL OR severity < 0.5)""",
    ("placed_runs",),
)
def u05(spark, sf):
    runs = placed_runs(spark, sf)
    mild = F.col("severity").isNull() | (F.col("severity") < 0.5)
    return audit.missing_combinations(runs, "asset_id", "class_label", mild).select(F.col("asset_id").alias("split"), "class_label")


LEAK = """WITH c AS (SELECT class_label, count(DISTINCT asset_id) AS assets, count(DISTINCT duration) AS durations, min(fault_start) AS lo, max(fault_start) AS hi FROM leak_runs GROUP BY 1),
  t AS (SELECT count(DISTINCT duration) AS durations, count(DISTINCT sample_count) AS counts, count(DISTINCT class_label) AS classes, count(DISTINCT split) AS splits, count(DISTINCT (split, class_label)) AS sc FROM leak_runs),
  s AS (SELECT count(DISTINCT st) AS sets FROM (SELECT l_suppkey, string_agg(DISTINCT l_returnflag, '|' ORDER BY l_returnflag) AS st FROM lineitem GROUP BY 1))
  SELECT 'run_id_string' AS probe, true AS flagged, 'low' AS severity UNION ALL SELECT 'dataset_id', false, 'low' UNION ALL SELECT 'target_asset_id', (SELECT count(*) FROM c WHERE assets < 4) > 0, 'high'
  UNION ALL SELECT 'split_assignment', sc < splits * classes, 'medium' FROM t UNION ALL SELECT 'run_duration', durations > 1 AND (SELECT count(*) FROM c WHERE durations = 1) > 0, 'high' FROM t
  UNION ALL SELECT 'row_count', counts > 1, 'medium' FROM t UNION ALL SELECT 'run_start_time', false, 'low' UNION ALL SELECT 'missingness_pattern', true, 'low' UNION ALL SELECT 'noise_configuration', false, 'low'
  UNION ALL SELECT 'measurement_availability', sets > 1, 'high' FROM s
  UNION ALL SELECT 'fault_start_policy', (SELECT count(*) FROM c a, c b WHERE a.class_label < b.class_label AND (a.hi < b.lo OR b.hi < a.lo)) > 0, 'medium'"""
relation(
    "leak_runs",
    "SELECT p.*, n * 10.0 AS duration, n AS sample_count FROM placed_runs p JOIN (SELECT l_suppkey AS run_id, count(*) AS n FROM lineitem GROUP BY 1) USING (run_id)",
    "placed_runs",
)


def leakage(spark, sf):
    items = wh.table(spark, sf, "lineitem")
    sizes = items.groupBy(F.col("l_suppkey").alias("run_id")).agg(F.count(F.lit(1)).alias("sample_count"))
    runs = placed_runs(spark, sf).join(sizes, "run_id").withColumns(
        {"duration": F.col("sample_count") * 10.0, "dataset_id": F.lit("ds"), "start_time": F.lit(0), "noise": F.lit("{}")}
    )
    channels = items.select(F.col("l_suppkey").alias("run_id"), F.col("l_returnflag").alias("measurement_type"))
    return audit.leakage_probes(runs, channels, ASSETS)


@query("Q15_leakage_probes", LEAK, ("leak_runs",))
def q15(spark, sf):
    return leakage(spark, sf)


@query(
    "Q18_feature_input_checks",
    """SELECT 'duplicate_observation' AS "check", sum(n - 1)::BIGINT AS rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
       UNION ALL SELECT 'unit_mismatch', count(*) FROM (SELECT l_returnflag FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linestatus) > 1)
       UNION ALL SELECT 'unsupported_cadence', count(*) FROM (SELECT * FROM (SELECT run_id, elapsed - lag(elapsed) OVER (PARTITION BY run_id ORDER BY tick) AS d FROM samples) WHERE abs(d - 10) > 1e-6)""",
    ("samples",),
)
def q18(spark, sf):
    items = wh.table(spark, sf, "lineitem")
    twice = audit.duplicate_keys(items, ["l_orderkey", "l_linenumber"]).select(F.lit("duplicate_observation").alias("check"), "rows")
    units = audit.unstable_units(items, "l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("rows"))
    steps = series.lagged(wh.samples(spark, sf), ["run_id"], {"_d": lambda w: F.col("elapsed") - F.lag("elapsed").over(w)}, "tick")
    odd = steps.agg(F.count_if(F.abs(F.col("_d") - 10.0) > 1e-6).alias("rows"))
    return twice.unionByName(units.select(F.lit("unit_mismatch").alias("check"), "rows")).unionByName(
        odd.select(F.lit("unsupported_cadence").alias("check"), "rows")
    )


@query(
    "Q19_training_set_checks",
    """SELECT 'non_finite' AS "check", count(*) AS rows FROM feature_rows WHERE NOT valid UNION ALL SELECT 'run_in_several_splits', 0 UNION ALL SELECT 'duplicate_key', 0""",
    ("feature_rows",),
)
def q19(spark, sf):
    return audit.training_checks(built(spark, sf), ["l_quantity__diff_10s", "l_discount__mean_120s", "price_per_discount"])


relation(
    "findings",
    f"""SELECT "check", severity, 'labeling' AS category, rows, '' AS detail FROM label_problems WHERE rows > 0 UNION ALL SELECT "check", severity, 'variation', rows, detail FROM ({VARIATION})
      UNION ALL SELECT 'signature', CASE status WHEN 'blocking' THEN 'blocking' ELSE 'medium' END, 'physical', 1, class_label || ':' || measurement FROM graded WHERE status IN ('blocking', 'concerning')
      UNION ALL SELECT probe, severity, 'leakage', 1, '' FROM ({LEAK}) WHERE flagged""",
    "label_problems",
    "runs",
    "graded",
    "leak_runs",
)


def findings(spark, sf):
    label = audit.label_problems(reported(spark, sf), "normal", "R").filter(F.col("rows") > 0).select(
        "check", "severity", F.lit("labeling").alias("category"), "rows", F.lit("").alias("detail")
    )
    leaks = leakage(spark, sf).filter("flagged").select(
        F.col("probe").alias("check"), "severity", F.lit("leakage").alias("category"), F.lit(1).cast("long").alias("rows"), F.lit("").alias("detail")
    )
    return label.unionByName(variation(spark, sf)).unionByName(signature_findings(spark, sf)).unionByName(leaks)


@query("Q20_run_audit", "SELECT * FROM findings", ("findings",))
def q20(spark, sf):
    return findings(spark, sf).orderBy(audit.severity_order(), "check", "detail")


@query(
    "D25_audit_verdict",
    """SELECT count(*) FILTER (severity = 'blocking') AS blocking, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low,
       CASE WHEN count(*) FILTER (severity = 'blocking') > 0 THEN 'NOT READY — SIMULATOR OR LABEL CORRECTIONS REQUIRED' WHEN count(*) FILTER (severity = 'high') > 0 THEN 'READY WITH DATASET POLICY CHANGES'
       ELSE 'READY FOR FEATURE ENGINEERING' END AS verdict FROM findings""",
    ("findings",),
)
def d25(spark, sf):
    return audit.verdict(findings(spark, sf))


@query(
    "A46_audit_rollup",
    """SELECT class_label AS cohort, count(*) FILTER (status = 'blocking') AS blocking, 0 AS high, count(*) FILTER (status = 'concerning') AS medium, count(*) FILTER (status IN ('matches', 'acceptable')) AS low,
       count(*) FILTER (status IN ('blocking', 'concerning')) AS at_or_above_medium, round(avg(direction_consistency) FILTER (status IN ('blocking', 'concerning')), 9) AS mean_consistency FROM graded GROUP BY 1""",
    ("graded",),
)
def a46(spark, sf):
    rows = graded(spark, sf).select(
        F.col("class_label").alias("cohort"), F.lit("physical").alias("category"), "direction_consistency",
        F.when(F.col("status") == "blocking", "blocking").when(F.col("status") == "concerning", "medium").otherwise("low").alias("severity"),
    )
    return audit.audit_rollup(rows, "cohort").withColumn("mean_consistency", F.round("mean_consistency", 9))


@query(
    "Q21_cohort_compatibility",
    """SELECT (SELECT count(*) FROM (SELECT c_mktsegment FROM customer GROUP BY 1 HAVING count(*) > 1)) AS duplicate_names, (SELECT count(DISTINCT (c_nationkey, c_mktsegment)) FROM customer) AS fingerprints, false AS compatible""",
)
def q21(spark, sf):
    cohorts = wh.table(spark, sf, "customer").select(
        F.col("c_mktsegment").alias("cohort"), F.col("c_nationkey").alias("model_hash"), F.col("c_mktsegment").alias("policy_hash")
    )
    return audit.cohort_compatibility(cohorts)


FILE_COLUMNS = [n for n, _, _ in dataset.TELEMETRY if n not in ("dataset_id", "value", "asset_id")]


@query(
    "Q01_file_schema",
    "SELECT * FROM (VALUES ('value', 'wrong_type'), ('asset_id', 'missing'), ('note', 'undeclared'), ('unit', 'wrong_nullability'), "
    + ", ".join(f"('{n}', 'ok')" for n in FILE_COLUMNS)
    + ') t("column", status)',
)
def q01f(spark, sf):
    """Files written with a unit that may be null, values as text, no asset and a column of their own, against the declared schema."""
    path = dataset.scratch_dir(spark) + "/telemetry"
    telemetry, _ = long_tables(spark, sf)
    whole = dataset.conform(telemetry, dataset.TELEMETRY).drop("dataset_id", "asset_id")
    whole.withColumns({"unit": F.when(F.col("observation_id") != "", F.col("unit")), "value": F.col("value").cast("string"), "note": F.lit("x")}).write.parquet(path)
    declared = [d for d in dataset.TELEMETRY if d[0] != "dataset_id"]
    typed = audit.schema_status(spark, "telemetry", spark.read.parquet(path).schema, declared).drop("table")
    return typed.unionByName(audit.nullability_status(files.footer_columns(spark, path), declared))


@query("Q04_file_tree", "SELECT * FROM (VALUES ('content', 1), ('missing', 1), ('size', 1), ('unlisted', 1)) t(problem, files)")
def q04t(spark, sf):
    """A manifest written first; then one file changes a byte, one grows, one goes and one comes."""
    path = exported(spark, sf)
    files.write_manifest(spark, path, 1 << 16)
    names = [r["path"] for r in files.listing(spark, path).filter(F.col("name").endswith(".parquet")).orderBy(F.desc("size_bytes"), "path").limit(3).collect()]
    for kind, name in zip(("content", "size", "missing"), names):
        store, place = files.filesystem(name)
        with store.open_input_stream(place) as stream:
            data = bytearray(stream.read())
        if kind == "missing":
            store.delete_file(place)
            continue
        data[len(data) // 2] ^= 1
        with store.open_output_stream(place) as out:
            out.write(bytes(data) if kind == "content" else bytes(data) + b"x")
    with store.open_output_stream(place.rsplit("/", 1)[0] + "/later.parquet") as out:
        out.write(b"PAR1")
    return files.verify_manifest(spark, path).groupBy("problem").agg(F.count(F.lit(1)).cast("int").alias("files"))


@query(
    "Q06_declared_splits",
    """WITH m AS (SELECT run_id, split AS derived, CASE WHEN run_id % 13 = 0 THEN 'test' ELSE split END AS split FROM runs),
       d AS (SELECT derived AS split, count(*) AS declared FROM m GROUP BY 1), a AS (SELECT split, count(*) AS actual FROM m GROUP BY 1)
       SELECT 'count:' || split AS "check", declared, actual FROM d FULL JOIN a USING (split) WHERE declared <> actual
       UNION ALL SELECT 'derived', count(*), count(*) FILTER (split <> derived) FROM m""",
    ("runs",),
)
def q06d(spark, sf):
    """A membership in which some runs were moved to the test split, against the declared counts and the split derived again."""
    runs = wh.runs(spark, sf)
    moved = runs.withColumn("split", F.when(F.col("run_id") % 13 == 0, "test").otherwise(F.col("split")))
    declared = runs.groupBy("split").agg(F.count(F.lit(1)).alias("declared"))
    counts = audit.split_count_mismatches(moved, declared).select(F.concat(F.lit("count:"), "split").alias("check"), "declared", "actual")
    wrong = audit.derived_split_mismatches(moved, runs).agg(F.count(F.lit(1)).alias("actual"))
    whole = runs.agg(F.lit("derived").alias("check"), F.count(F.lit(1)).alias("declared")).crossJoin(wrong)  # one row each
    return counts.unionByName(whole)


@query(
    "Q19_fingerprints",
    """SELECT * FROM (VALUES ('cell', 'content', ''), ('cell', 'cells', 'l_quantity'), ('doubled', 'rows', ''), ('doubled', 'keys', ''), ('doubled', 'content', ''),
       ('swapped', 'content', ''), ('swapped', 'cells', 'l_tax'), ('swapped', 'cells', 'l_discount'), ('order', 'order', 'l_tax'), ('order', 'order', 'l_discount')) t(variant, "check", "column")
       UNION ALL SELECT 'doubled', 'cells', unnest(['run_id', 'tick', 'l_quantity', 'l_discount', 'l_tax'])""",
)
def q19f(spark, sf):
    """Fingerprints of a training table before and after one cell changes, a row is doubled, and columns swap values or places."""
    keys, columns = ["run_id", "tick"], ["run_id", "tick", "l_quantity", "l_discount", "l_tax"]
    rows = wh.samples(spark, sf).select(*columns)
    one = (F.col("run_id") == 1) & (F.col("tick") == 7)
    variants = {
        "same": rows.repartition(7, "tick"),
        "cell": rows.withColumn("l_quantity", F.when(one, F.col("l_quantity") + 1).otherwise(F.col("l_quantity"))),
        "doubled": rows.unionByName(rows.filter(one)),
        "swapped": rows.select("run_id", "tick", "l_quantity", F.col("l_tax").alias("l_discount"), F.col("l_discount").alias("l_tax")),
        "order": rows.select("run_id", "tick", "l_quantity", "l_tax", "l_discount"),
    }
    declared = cut_lineage(fingerprints.merged(fingerprints.fingerprint(rows.filter("run_id <= 40"), keys).unionByName(fingerprints.fingerprint(rows.filter("run_id > 40"), keys))))
    parts = []
    for name, changed in variants.items():
        actual = cut_lineage(fingerprints.fingerprint(changed, keys))
        found = fingerprints.differences(declared, actual).select(F.lit(name).alias("variant"), "check", "column")
        parts.append(found.filter("NOT (variant = 'order' AND check = 'content')"))  # the row hash follows the order of columns
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(
    "Q19_key_alignment",
    """SELECT * FROM (VALUES ('equal', false, false), ('one_less', true, true), ('one_other', false, true)) t(variant, rows, keys)""",
)
def q19k(spark, sf):
    """Features against labels: the same keys in another order, one label less, and one label of another key."""
    rows = wh.samples(spark, sf).select("run_id", "tick")
    one = (F.col("run_id") == 1) & (F.col("tick") == 7)
    variants = {
        "equal": rows.repartition(5, "tick"),
        "one_less": rows.filter(~one),
        "one_other": rows.withColumn("tick", F.when(one, F.col("tick") + 100_000).otherwise(F.col("tick"))),
    }
    parts = [fingerprints.misaligned_keys(rows, other, ["run_id", "tick"]).select(F.lit(name).alias("variant"), "rows", "keys") for name, other in variants.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _of(name: str) -> str:
    return f"({ORACLES[name]})"


FULL_AUDIT = " UNION ALL ".join(
    [
        f'SELECT "check", severity, category, CAST(rows AS BIGINT) AS rows, detail FROM {_of("Q20_run_audit")}',
        f"SELECT 'plan_counts', 'blocking', 'structural', count(*), '' FROM {_of('Q05_plan_counts')} HAVING count(*) > 0",
        f"SELECT 'split:' || \"check\", 'blocking', 'structural', rows, '' FROM {_of('Q06_split_checks')} WHERE rows > 0",
        f"SELECT 'reference:' || side, CASE side WHEN 'unknown_run' THEN 'blocking' ELSE 'high' END, 'structural', count(*), '' FROM ({DANGLING}) GROUP BY side",
        f"SELECT 'non_monotonic', 'blocking', 'structural', non_monotonic, '' FROM {_of('Q08_cadence_findings')} WHERE non_monotonic > 0",
        f"SELECT 'bad_cadence', 'blocking', 'structural', bad_cadence, '' FROM {_of('Q08_cadence_findings')} WHERE bad_cadence > 0",
        f"SELECT 'unit:' || measurement_type, 'blocking', 'structural', units, names FROM {_of('Q09_unit_per_measurement')}",
        f"SELECT 'duplicate_keys', 'blocking', 'structural', rows, examples FROM {_of('Q10_duplicate_keys')} WHERE rows > 0",
        f"SELECT 'row_counts', 'blocking', 'structural', count(*), '' FROM {_of('Q03_manifest_row_counts')} HAVING count(*) > 0",
        f"SELECT 'trivially_separable', 'low', 'separability', count(*), '' FROM {_of('Q16_trivially_separable')} WHERE flagged HAVING count(*) > 0",
    ]
)


@query("Q20_full_audit", FULL_AUDIT)
def q20f(spark, sf):
    """Structure, labels, variation, signatures, separability and leakage in one table of findings."""
    total = F.count(F.lit(1))
    counted = lambda df, name, severity, category: audit.finding(df.agg(total.alias("n")), name, severity, category, F.col("n"))
    named = lambda df, prefix, column, rows, detail: df.select(
        F.concat(F.lit(prefix), F.col(column)).alias("check"), F.lit("blocking").alias("severity"), F.lit("structural").alias("category"),
        F.col(rows).cast("long").alias("rows"), detail.cast("string").alias("detail"),
    ).filter("rows > 0")
    lost = named(q07(spark, sf), "reference:", "check", "rows", F.lit(""))
    steps = q08(spark, sf)
    parts = [
        counted(q05(spark, sf), "plan_counts", "blocking", "structural"),
        named(q06(spark, sf), "split:", "check", "rows", F.lit("")),
        lost.withColumn("severity", F.when(F.col("check") == "reference:unknown_run", "blocking").otherwise("high")),
        *[audit.finding(steps, name, "blocking", "structural", F.col(name)) for name in ("non_monotonic", "bad_cadence")],
        named(q09(spark, sf), "unit:", "measurement_type", "units", F.col("names")),
        audit.finding(q10(spark, sf), "duplicate_keys", "blocking", "structural", F.col("rows"), F.col("examples")),
        counted(q03(spark, sf), "row_counts", "blocking", "structural"),
        counted(q16(spark, sf).filter("flagged"), "trivially_separable", "low", "separability"),
    ]
    out = findings(spark, sf)
    for part in parts:
        out = out.unionByName(part)
    return out
