"""Streams against plain folds over the same arrivals: several micro-batches, restarts, replays and resets."""

import os
import random
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.operators import corroboration as co
from sensorloom.streaming import evidence, replay, rollup, session, tables

READINGS = "asset_id string, op string, timestamp timestamp, measurement_type string, value double, unit string, event_id string, arrival long"
CONFIG = session.SessionConfig(required=("a", "b"), max_pending=3)
START = datetime(2026, 1, 1, tzinfo=timezone.utc)


def arrivals(n=400, seed=4):
    """Readings of five assets with repeats, conflicts, late ones and samples that stay half-filled, and commands."""
    rng, rows = random.Random(seed), []
    for k in range(n):
        at = START + timedelta(seconds=10 * (k // 12) - rng.choice([0, 0, 0, 0, 20]))
        rows.append((f"asset-{k % 5}", "reading", at, rng.choice("abbac"), float(rng.choice([1, 1, 1, 2])), "u", f"e{k}", k))
    rows += [("asset-1", "reset", None, None, None, None, None, 150), ("asset-9", "reset", None, None, None, None, None, 10)]
    return rows + [(f"asset-{k}", "flush", None, None, None, None, None, n) for k in range(5)]


def folded(rows, resets=()):
    """The same by the pure functions, row by row."""
    states, out = {}, []
    for r in sorted(rows, key=lambda r: (r[7], r[1] != "reset")):
        state = states.setdefault(r[0], session.new_state())
        epoch = sum(r[7] >= x for x in resets)
        if epoch > state["epoch"]:
            session.reset(state)
            state["epoch"] = epoch
        if r[1] == "reset":
            session.reset(state)
        elif r[1] == "flush":
            out += [(r[0], o) for o in session.flushed(state, CONFIG)]
        else:
            event = {"ts": int(r[2].timestamp()) * 1_000_000, "measurement_type": r[3], "value": r[4], "unit": r[5], "event_id": r[6]}
            out += [(r[0], o) for o in session.ingest(state, event, 0, CONFIG)]
    return sorted((a, o["ts"], o["kind"], o.get("reason"), o.get("detail"), o.get("event_id"), o.get("sample_no")) for a, o in out)


def ordered(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("resets", [(), (90, 260)])
def test_sessions_equal_a_plain_fold_over_batches_and_a_restart(spark, tmp_path, resets):
    rows, seen = arrivals(), []
    table = spark.createDataFrame(rows, READINGS)

    def keep(batch, batch_id):
        seen.append(batch.select("asset_id", F.unix_micros("timestamp").alias("ts"), "kind", "reason", "detail", "event_id", "sample_no").collect())

    for part in ("arrival < 170", "arrival >= 170"):
        replay.write_arrivals(table.filter(part), str(tmp_path / "in"), "asset_id", 2)
        results = session.session_stream(replay.read_arrivals(spark, str(tmp_path / "in"), table.schema), CONFIG, resets=resets)
        session.start_available(results, keep, str(tmp_path / "checkpoint")).awaitTermination()
    assert len(seen) >= 4
    found = [tuple(r) for batch in seen for r in batch]
    expected = folded(rows, resets)
    assert ordered(found) == ordered(expected)
    assert {r[3] for r in expected} == {None, "late", "conflicting_duplicate", "incomplete_timeout"}


def test_half_filled_samples_time_out_while_the_stream_lives(spark, tmp_path):
    rows = [("x", "reading", START, "a", 1.0, "u", "e1", 1), ("y", "reading", START, "a", 1.0, "u", "e2", 1), ("y", "reading", START, "b", 1.0, "u", "e3", 2)]
    table = spark.createDataFrame(rows, READINGS)
    table.write.parquet(str(tmp_path / "in"))
    config = session.SessionConfig(required=("a", "b"), timeout_seconds=1.0)
    results = session.session_stream(replay.read_arrivals(spark, str(tmp_path / "in"), table.schema, 9), config, live=True)
    found = []
    query = results.writeStream.foreachBatch(lambda b, i: found.extend(b.select("asset_id", "kind", "reason", "detail").collect())).option(
        "checkpointLocation", str(tmp_path / "checkpoint")
    ).start()
    until = time.time() + 60
    while time.time() < until and len(found) < 2:
        time.sleep(0.5)
    query.stop()
    assert sorted(map(tuple, found)) == [
        ("x", "quality", "incomplete_timeout", "missing measurement(s) after timeout: ['b']"),
        ("y", "result", None, None),
    ]


def test_assembly_in_batch_folds_each_sample(spark):
    rows = [r for r in arrivals() if r[1] == "reading"]
    by_sample = {}
    for r in rows:
        by_sample.setdefault((r[0], r[2]), []).append(r)
    expected = []
    for (asset, at), mine in by_sample.items():
        state = session.new_state()
        out = []
        for r in mine:
            out += session.ingest(state, {"ts": 1, "measurement_type": r[3], "value": r[4], "unit": r[5]}, 0, CONFIG)
        expected += [(asset, at.replace(tzinfo=None), o.get("reason") or "complete") for o in out + session.flushed(state, CONFIG)]
    got = session.assemble_fold(spark.createDataFrame(rows, READINGS), ("a", "b")).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    assert ordered(tuple(r) for r in got.select("asset_id", "timestamp", "status").collect()) == ordered(expected)


EVENTS = T.StructType([T.StructField("id", T.StringType()), T.StructField("at", T.TimestampType()), T.StructField("n", T.LongType())])


def events(spark, ids):
    return spark.createDataFrame([(f"e{i}", None if i % 11 == 0 else START + timedelta(hours=i), i) for i in ids], EVENTS)


def test_keyed_sink_keeps_one_row_of_each_key(spark, tmp_path):
    path = str(tmp_path / "sink")
    put = tables.keyed_sink(path, "id", "at")
    assert tables.read_keyed(spark, path, EVENTS).count() == 0
    for number, ids in enumerate([range(0, 40), range(30, 60), [5, 5, 77], [], range(0, 60)]):
        put(events(spark, ids), number % 2)  # numbers may start anew
    got = [tuple(r) for r in tables.read_keyed(spark, path, EVENTS).collect()]
    assert ordered(got) == ordered(tuple(r) for r in events(spark, [*range(60), 77]).collect())


def test_broken_off_writes_are_not_seen_and_compaction_leaves_one_version(spark, tmp_path):
    path = str(tmp_path / "sink")
    put = tables.keyed_sink(path, "id", "at")
    put(events(spark, range(20)), 0)
    put(events(spark, range(10, 30)), 1)
    events(spark, range(500, 520)).withColumns({"_day": F.lit(20260101), "_bucket": F.lit(1)}).write.partitionBy("_day", "_bucket").parquet(f"{path}/data/version=2")
    os.remove(f"{path}/data/version=2/_SUCCESS")  # the write did not end
    before = ordered(tuple(r) for r in tables.read_keyed(spark, path, EVENTS).collect())
    assert len(before) == 30
    put(events(spark, range(30, 35)), 2)  # takes the number of the write that broke off
    schema = T.StructType([*EVENTS.fields, T.StructField("_day", T.IntegerType()), T.StructField("_bucket", T.IntegerType())])
    tables.compact(spark, path, ["_day", "_bucket"], schema)
    assert [d for d in os.listdir(f"{path}/data") if d.startswith("version")] == ["version=3"]
    assert tables.read_keyed(spark, path, EVENTS).count() == 35


def test_a_batch_reads_only_the_partitions_it_touches(spark, tmp_path):
    path, read = str(tmp_path / "sink"), []
    rows = lambda ids: events(spark, ids).withColumn("part", (F.col("n") % 4).cast("int"))
    schema = rows([1]).schema

    def merge(old, new):
        read.append(sorted(r["n"] for r in old.select("n").collect()))
        return old.unionByName(new)

    tables.rewrite(rows(range(12)), path, ["part"], schema, merge)
    tables.rewrite(rows([13, 17]), path, ["part"], schema, merge)
    assert read == [[], [1, 5, 9]]
    assert tables.live(spark, path, ["part"], schema).count() == 14


def readings(rows, spark):
    return spark.createDataFrame(rows, "id string, asset_id string, timestamp timestamp, measurement_type string, value double, unit string")


@pytest.mark.parametrize("bucket", ["1h", "1d"])
def test_rollup_counts_every_reading_once(spark, tmp_path, bucket):
    path, rng = str(tmp_path / "rollup"), random.Random(1)
    rows = [(f"r{k}", f"a{k % 2}", START + timedelta(minutes=17 * k - rng.choice([0, 0, 0, 3000])), "m", float(rng.randint(0, 9)), f"u{k % 3}") for k in range(300)]
    handle = rollup.rollup_batches(path, bucket, look_back=86_400)
    newest, kept, late = None, [], []
    for number in range(3):
        batch = rows[100 * number : 100 * (number + 1)]
        for _ in range(2):  # delivered twice
            handle(readings(batch, spark), number)
        old = [r for r in batch if newest is not None and r[2] < newest - timedelta(days=1)]
        late += old
        kept += [r for r in batch if r not in old]
        newest = max([r[2] for r in batch if r not in old] + ([newest] if newest else []))
    assert late and sorted(r["id"] for r in rollup.late_readings(spark, path).collect()) == sorted(r[0] for r in late)
    rollup.compact_rollup(spark, path)
    assert len([d for d in os.listdir(f"{path}/data") if d.startswith("version")]) == 1
    expected = {}
    for r in kept:
        at = r[2].replace(minute=0, second=0) if bucket == "1h" else r[2].replace(hour=0, minute=0, second=0)
        expected.setdefault((at.replace(tzinfo=None), r[1]), []).append(r)
    got = rollup.read_rollup_table(spark, path).withColumn("bucket", F.col("bucket").cast("timestamp_ntz")).collect()
    assert {(r["bucket"], r["asset_id"]): (round(r["avg_value"], 9), r["min_value"], r["max_value"], r["sample_count"], r["unit"]) for r in got} == {
        k: (round(sum(x[4] for x in v) / len(v), 9), min(x[4] for x in v), max(x[4] for x in v), len(v), max(v, key=lambda x: (x[2], x[0]))[5])
        for k, v in expected.items()
    }


ALERTS = "event_id string, asset_id string, observed_at timestamp, transition_type string, from_state string, to_state string, maximum_score double, arrival long"


def alerts(n=60, seed=3):
    rng, rows = random.Random(seed), []
    for k in range(n):
        kind = rng.choice(["confirmed", "class_changed", "cleared"])
        state = "confirmed_" + rng.choice(["cooling_degradation", "sensor_anomaly"])
        states = (state, "healthy") if kind == "cleared" else ("healthy", state)
        rows.append((f"e{k:03d}", f"a{k % 3}", START + timedelta(minutes=k), kind, *states, 0.9, k))
    return rows + [(*rows[7][:7], n - 1), (*rows[40][:7], n), ("bad", "a1", START, "opened", "healthy", "x", 0.9, n)]


def test_investigations_go_on_from_the_evidence_table(spark, tmp_path):
    table = spark.createDataFrame(alerts(), ALERTS)
    obs = spark.createDataFrame(
        [(f"o{a}{k}", f"a{a}", START + timedelta(minutes=k - 5), "stack_temperature", float(k % 17)) for a in range(3) for k in range(60)],
        "id string, asset_id string, timestamp timestamp, measurement_type string, value double",
    )
    path, earlier = str(tmp_path / "evidence"), None
    handle = evidence.evidence_batches(path, obs)
    for name, part in (("one", "arrival < 25"), ("two", "arrival >= 25")):
        replay.write_arrivals(table.filter(part), str(tmp_path / name), "asset_id", 3)
        stream = evidence.investigation_stream(replay.read_arrivals(spark, str(tmp_path / name), table.schema), earlier)
        session.start_available(stream, handle, str(tmp_path / f"{name}-checkpoint")).awaitTermination()
        earlier = evidence.read_evidence(spark, path, obs)
    valid = co.validate_transitions(table.filter("event_id <> 'bad'")).select("event_id", "asset_id", "observed_at", "transition_type", "fault_class")
    columns = ["event_id", "investigation_id", "previous_fault_class", "is_new_investigation", "corroboration_result", "supporting_observation_ids", "recommendation_id"]
    expected = co.fault_evidence(valid, obs).select(*columns).collect()
    got = earlier.select(*columns).collect()
    assert len(got) == 60 and ordered(map(tuple, got)) == ordered(map(tuple, expected))
