import os
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sensorloom.operators import audit, cohorts, fingerprints, joins, metrics, series
from sensorloom.sources import dataset, files, text


def test_topic_payloads_of_every_kind(spark):
    topic = "site/v1/plant/a1/telemetry/temp"
    good = '"unit": "C", "timestamp": "2026-01-01T00:00:00+00:00"'
    cases = [
        (topic, "{%s, \"value\": 1.5, \"id\": \"x\"}" % good, None, "x", 1.5),
        (topic, "{%s, \"value\": \"2.5\"}" % good, None, "mqtt-a1-temp-1767225600000", 2.5),
        (topic, "{%s, \"value\": true, \"id\": 7}" % good, None, "mqtt-a1-temp-1767225600000", 1.0),
        (topic, "{%s, \"value\": null}" % good, "invalid_value", None, None),
        (topic, "{%s, \"value\": [1]}" % good, "invalid_value", None, None),
        (topic, "{%s}" % good, "missing_value", None, None),
        (topic, "[1, 2]", "invalid_payload", None, None),
        (topic, "not json", "invalid_payload", None, None),
        (topic, '{"value": 1, "unit": 3, "timestamp": "2026-01-01T00:00:00"}', "missing_unit", None, None),
        (topic, '{"value": 1, "unit": "C", "timestamp": 12}', "invalid_timestamp", None, None),
        ("other/topic", "{%s, \"value\": 1}" % good, "unsupported_topic", None, None),
    ]
    rows = spark.createDataFrame([(k, t, p) for k, (t, p, *_) in enumerate(cases)], "k int, topic string, payload string")
    for k, (_, _, reason, identity, value) in enumerate(cases):
        got = text.parse_topic_payload(rows.filter(F.col("k") == k), "site/v1").first()
        assert got["reject_reason"] == reason, cases[k]
        if reason is None:
            assert (got["id"], got["value"]) == (identity, value)


def test_hash_tree_finds_each_kind_of_change(spark, tmp_path):
    folder = str(tmp_path / "table")
    spark.range(2000).repartition(4).write.parquet(folder)
    files.write_manifest(spark, folder, slice_bytes=1000)
    assert files.verify_manifest(spark, folder).count() == 0
    names = sorted(n for n in os.listdir(folder) if n.endswith(".parquet"))
    whole = {n: open(f"{folder}/{n}", "rb").read() for n in names}
    open(f"{folder}/{names[0]}", "wb").write(whole[names[0]][:1200] + b"?" + whole[names[0]][1201:])
    open(f"{folder}/{names[1]}", "ab").write(b"more")
    os.remove(f"{folder}/{names[2]}")
    open(f"{folder}/new.parquet", "wb").write(b"x")
    for name in names[:3]:
        if os.path.exists(f"{folder}/.{name}.crc"):
            os.remove(f"{folder}/.{name}.crc")
    got = {r["name"]: r["problem"] for r in files.verify_manifest(spark, folder).collect()}
    assert got == {names[0]: "content", names[1]: "size", names[2]: "missing", "new.parquet": "unlisted"}


def test_required_columns_are_written_as_such_and_reject_nulls(spark, tmp_path):
    declared = (("a", "string", False), ("b", "double", True), ("c", "timestamp", False))
    rows = spark.createDataFrame([("x", None, "2026-01-01 00:00:00")], "a string, b double, c string")
    path = str(tmp_path / "t")
    dataset.conform(rows, declared).write.parquet(path)
    footers = files.footer_columns(spark, path)
    assert {(r["column"], r["nullable"]) for r in footers.collect()} == {("a", False), ("b", True), ("c", False)}
    assert audit.nullability_status(footers, declared).count() == 0
    wrong = audit.nullability_status(footers, (("a", "string", True), ("b", "double", True), ("c", "timestamp", False)))
    assert [tuple(r) for r in wrong.collect()] == [("a", "wrong_nullability")]
    with pytest.raises(Exception, match="null in the required column a"):
        dataset.conform(rows.withColumn("a", F.lit(None).cast("string")), declared).write.parquet(str(tmp_path / "u"))


def table(spark, rows):
    return spark.createDataFrame(rows, "k long, x double, y double, s string")


ROWS = [(k, float(k % 7), float(k % 5), None if k % 3 else f"s{k}") for k in range(60)]


def found(a, b):
    return sorted(tuple(r) for r in fingerprints.differences(fingerprints.fingerprint(a, ["k"]), fingerprints.fingerprint(b, ["k"])).collect())


def test_fingerprints(spark):
    base = table(spark, ROWS)
    shuffled = list(ROWS)
    random.Random(1).shuffle(shuffled)
    assert found(base, table(spark, shuffled).repartition(5)) == []
    assert found(base, table(spark, [*ROWS, ROWS[4], ROWS[4]])) != []  # a pair would vanish in an exclusive or
    assert ("rows", "") in found(base, table(spark, [*ROWS, ROWS[4]]))
    assert found(base, table(spark, [(k, x + (k == 9), y, s) for k, x, y, s in ROWS])) == [("cells", "x"), ("content", "")]
    swapped = [(k, ROWS[(k + 1) % 60][1], y, s) if k < 2 else (k, x, y, s) for k, x, y, s in ROWS]  # values change rows
    assert ("cells", "x") in found(base, table(spark, swapped))
    assert found(base, table(spark, [(k, y, x, s) for k, x, y, s in ROWS])) == [("cells", "x"), ("cells", "y"), ("content", "")]
    nulls = [(k, None if k == 3 else x, y, s) for k, x, y, s in ROWS]
    moved = [(k, x, None if k == 3 else y, s) for k, x, y, s in ROWS]
    assert ("content", "") in found(table(spark, nulls), table(spark, moved))
    assert found(base, base.drop("s"))[0] == ("content", "") and ("missing", "s") in found(base, base.drop("s"))
    parts = fingerprints.fingerprint(base.filter("k < 20"), ["k"]).unionByName(fingerprints.fingerprint(base.filter("k >= 20"), ["k"]))
    assert fingerprints.differences(fingerprints.fingerprint(base, ["k"]), fingerprints.merged(parts)).count() == 0
    empty = table(spark, [])
    assert found(empty, empty) == [] and ("rows", "") in found(base, empty)


def test_key_alignment(spark):
    base = table(spark, ROWS)
    flags = lambda other: tuple(fingerprints.misaligned_keys(base, other, ["k"]).first())
    assert flags(base.repartition(4)) == (False, False)
    assert flags(base.filter("k <> 5")) == (True, True)
    assert flags(base.withColumn("k", F.when(F.col("k") == 5, 6).otherwise(F.col("k")))) == (False, True)


def skewed(spark):
    """Nine tenths of the rows lie in one asset, most of them at one timestamp."""
    rng = random.Random(5)
    rows = [("hot", 0 if rng.random() < 0.8 else rng.randint(0, 50), k) for k in range(900)]
    rows += [(rng.choice(["a", "b", None]), rng.randint(0, 50), 900 + k) for k in range(100)]
    return spark.createDataFrame(rows, "asset string, at long, id long")


def test_positions_and_cells_of_one_hot_timestamp(spark):
    df = skewed(spark)
    plain = df.withColumn("n", F.row_number().over(Window.partitionBy("asset").orderBy("at", "id")).cast("long"))
    cut = series.with_position(df, ["asset"], ["at", "id"], name="n", hot_rows=50)
    assert sorted(map(tuple, cut.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
    cells, several = series.in_cells(df, ["asset"], ["at"], hot_rows=50)
    sizes = [r["count"] for r in cells.filter("asset = 'hot'").groupBy("_cell").count().collect()]
    assert several and len(sizes) > 10 and max(sizes) <= 2 * sorted(sizes)[len(sizes) // 2]


@pytest.mark.parametrize("forward", [False, True])
def test_as_of_join_with_hot_keys(spark, monkeypatch, forward):
    left, right = skewed(spark), skewed(spark).withColumns({"at": F.col("at") + F.col("id") % 3, "rid": F.col("id")}).drop("id")
    stamp = lambda df: df.withColumn("t", F.timestamp_seconds("at"))
    run = lambda: sorted(
        map(tuple, joins.as_of_join(stamp(left), stamp(right), ["asset"], "t", "t", ["rid"], forward=forward, tie=["rid"]).select("id", "rid").collect())
    )
    whole = run()
    monkeypatch.setattr(series, "HOT_ROWS", 40)
    assert run() == whole
    rows = right.collect()
    expected = {}
    for r in left.collect():
        able = [(x["at"], x["rid"]) for x in rows if x["asset"] == r["asset"] and (x["at"] >= r["at"] if forward else x["at"] <= r["at"])]
        expected[r["id"]] = (min(able) if forward else max(able))[1] if able else None
    assert dict(whole) == expected


def test_bins_are_cut_again(spark, monkeypatch):
    rng = random.Random(2)
    df = spark.createDataFrame([("g" if k % 10 else "h", float(rng.random() ** 4), 1) for k in range(20_000)], "k string, x double, one int")
    ask = lambda: sorted(map(tuple, series.cumulative_by_value(df, ["k"], "x", {"n": F.col("one").cast("long")}).collect()))
    whole = ask()
    monkeypatch.setattr(series, "BIN_ROWS", 100)
    assert ask() == whole
    ordered = sorted(x for k, x, _ in map(tuple, df.collect()) if k == "h")
    assert [r[1] for r in whole if r[0] == "h"] == ordered and [r[4] for r in whole if r[0] == "h"] == list(range(1, len(ordered) + 1))


def test_one_to_one_join(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string")
    right = spark.createDataFrame([(2, 0.2), (1, 0.1)], "k int, y double")
    assert sorted(map(tuple, joins.strict_one_to_one(left, right, ["k"]).collect())) == [(1, "a", 0.1), (2, "b", 0.2)]
    for broken in (right.filter("k = 1"), right.unionByName(right), right.unionByName(spark.createDataFrame([(3, 0.3)], "k int, y double"))):
        with pytest.raises(Exception, match="not 1:1"):
            joins.strict_one_to_one(left, broken, ["k"]).collect()


def test_rejections_and_gaps(spark):
    rows = spark.createDataFrame(
        [(1, 10.0 * k, k not in (3, 4, 5, 9), ["zero", "zero"] if k == 3 else ["zero"] if k in (4, 5, 9) else [], "A", "ramp" if k < 5 else None, 4) for k in range(12)],
        "run_id int, elapsed double, valid boolean, reason_codes array<string>, class_label string, stage string, asset_id int",
    )
    got = {(r["kind"], r["name"]): r["rows"] for r in metrics.availability_counts(rows).collect()}
    assert got == {("reason", "zero"): 5, ("class", "A"): 4, ("stage", "ramp"): 2, ("stage", "not_in_fault_window"): 2, ("asset", "4"): 4}
    assert tuple(metrics.longest_gap(rows, ["run_id"]).first()) == (3, 30.0)
    assert tuple(metrics.longest_gap(rows.filter("valid"), ["run_id"]).first()) == (0, 0.0)


def test_splits_against_the_manifest_and_a_second_derivation(spark):
    member = spark.createDataFrame([(1, "train"), (2, "test"), (3, "train"), (5, "test")], "run_id int, split string")
    derived = spark.createDataFrame([(1, "train"), (2, "train"), (3, "train"), (4, "test")], "run_id int, split string")
    declared = spark.createDataFrame([("train", 3), ("test", 1), ("validation", 0)], "split string, declared long")
    assert sorted(tuple(r) for r in audit.split_count_mismatches(member, declared).select("split", "declared", "actual").collect()) == [("test", 1, 2), ("train", 3, 2)]
    assert sorted(r["run_id"] for r in audit.derived_split_mismatches(member, derived).collect()) == [2, 4, 5]


def test_no_survivor_keeps_the_policy(spark):
    columns = "cohort string, ba_original double, ba_robust double, rate_robust double, min_recall_robust double, missed_original int, missed_robust int"
    rows = [(c, 0.5, 0.9, 0.0, 0.8, 0, 0) for c in ("pilot", "high_noise", "combined_ood_v1")]
    comparison = spark.createDataFrame(rows, columns)
    search = lambda reasons: spark.createDataFrame([(i, r) for i, r in enumerate(reasons)], "policy_id int, rejection string")
    out = cohorts.policy_promotion(search(["latency", "any_fault_missed"]), comparison).first()
    assert out["decision"] == cohorts.POLICY_DECISIONS["insufficient"] and out["reason"] and out["survivors"] == 0
    assert cohorts.policy_promotion(search([None, "latency"]), comparison).first()["decision"] == cohorts.POLICY_DECISIONS["promote"]


def test_missing_combinations(spark):
    rows = spark.createDataFrame([("a", "x", 1), ("a", "y", 1), ("b", "x", 0)], "l string, r string, n int")
    assert sorted(map(tuple, audit.missing_combinations(rows, "l", "r").collect())) == [("b", "y")]
    assert sorted(map(tuple, audit.missing_combinations(rows, "l", "r", F.col("n") > 0).collect())) == [("b", "x"), ("b", "y")]
