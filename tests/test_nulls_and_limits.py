from pyspark.sql import functions as F

from sensorloom.functions.scalar import parse_iso
from sensorloom.operators import cohorts, joins, reads, series


def numbered(spark):
    rows = [(None, k, float(k % 3)) for k in range(1, 11)] + [("a", k, float(k)) for k in range(1, 8)]
    return spark.createDataFrame(rows, "asset string, pos long, value double")


def test_running_figures_with_a_null_key_at_any_block_size(spark, monkeypatch):
    df = numbered(spark)
    results = []
    for size in (4, 10_000):
        monkeypatch.setattr(series, "BLOCK_ROWS", size)
        total = series.running_total(df, ["asset"], F.lit(1).cast("long"), "n")
        top = series.running_max(total, ["asset"], F.col("value"), "top")
        results.append(sorted((r["asset"] or "", r["pos"], r["n"], r["top"]) for r in top.collect()))
    assert results[0] == results[1]
    assert [r[2] for r in results[0]] == [*range(1, 11), *range(1, 8)]


def test_positions_with_a_null_key_at_any_threshold(spark):
    df = numbered(spark).withColumn("chunk", F.floor(F.col("pos") / 3))
    for hot in (2, 10_000):
        out = series.with_position(df, ["asset"], ["pos"], F.col("chunk"), name="n", hot_rows=hot)
        assert all(r["n"] == r["pos"] for r in out.collect())


def test_quantiles_keep_the_null_group(spark):
    got = {r["asset"]: r["m"] for r in series.exact_median(numbered(spark), ["asset"], "value", "m").collect()}
    assert got == {None: 1.0, "a": 4.0}


def test_as_of_join_with_a_null_key_across_buckets(spark):
    left = spark.createDataFrame([(None, "2024-01-05 00:00:00", 1)], "k string, t string, i int").withColumn("t", F.to_timestamp("t"))
    right = spark.createDataFrame([(None, "2024-01-01 00:00:00", 7)], "k string, t string, v int").withColumn("t", F.to_timestamp("t"))
    assert joins.as_of_join(left, right, ["k"], "t", "t", ["v"]).first()["v"] == 7


def test_history_is_whole_unless_a_limit_is_passed(spark):
    obs = spark.createDataFrame([(str(k), "a", k, "t", float(k), "u") for k in range(1500)], "id string, asset_id string, s long, measurement_type string, value double, unit string")
    obs = obs.withColumn("timestamp", F.timestamp_seconds("s"))
    assert len(reads.build_series(obs).first()["samples"]) == 1500
    assert len(reads.build_series(obs, reads.DEFAULT_HISTORY_LIMIT).first()["samples"]) == 1000


def test_only_whole_iso_timestamps(spark):
    good = {"2024-01-05": "2024-01-05 00:00:00", "2024-01-05T10:00": "2024-01-05 10:00:00", "2024-01-05 10:00:01.5Z": "2024-01-05 10:00:01.5", "2024-01-05T10:00:00+02:00": "2024-01-05 08:00:00"}
    bad = ["2024", "2024-01", "2024-1-5", "10:00:00", "T10:00", "", "x", None, "2024-13-01", "2024-01-05T1:00"]
    df = spark.createDataFrame([(t,) for t in [*good, *bad]], "t string")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = {r["t"]: r["p"] for r in df.select("t", (F.unix_micros(parse_iso(F.col("t"))) / 1e6).alias("p")).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    want = {r["t"]: r["p"] for r in spark.createDataFrame(list(good.items()), "t string, w string").select("t", (F.unix_micros(F.to_timestamp("w")) / 1e6).alias("p")).collect()}
    assert {t: got[t] for t in good} == want and all(got[t] is None for t in bad)


def test_missing_figures_do_not_promote(spark):
    columns = "cohort string, ba_original double, ba_robust double, rate_robust double, min_recall_robust double, missed_original long, missed_robust long"
    rows = [("pilot", 0.9, 0.9, 0.0, 0.9, 0, 0), ("high_noise", 0.5, None, None, 0.9, 0, 0), ("combined_ood_v1", 0.5, 0.9, 0.0, 0.9, 0, 0)]
    row = cohorts.promotion(spark.createDataFrame(rows, columns)).first()
    assert row["noise_gain"] == 0.0 and row["decision"] == cohorts.MODEL_DECISIONS["insufficient"]
    columns = "cohort string, balanced_accuracy double, balanced_accuracy_drop double, min_recall double, false_alert_rate double, max_missed_fraction double"
    quiet = spark.createDataFrame([("c", 0.99, 0.0, 0.9, None, None)], columns)
    assert quiet.select(cohorts.tier(cohorts.Bands()).alias("t")).first()["t"] == "minor"
    assert cohorts.ood_verdict(quiet).first()["verdict"] == cohorts.OOD_VERDICTS[1]
