"""Readings of a micro-batch taken as columns give the rows of the same readings taken one by one."""

import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sensorloom.functions.hysteresis import Policy
from sensorloom.functions.linear import LinearScorer, rounded
from sensorloom.operators.features import FeatureSpec, Ratio, Residual
from sensorloom.streaming import columns, session

SPEC = FeatureSpec(signals=("a", "b"), ratios=(Ratio("a_per_b", "a", "b", 1.0),), residuals=(Residual("rest", "a", "b", 0.5, 0.2, 10.0), Residual("more", "b", "a", 0.1, 0.2, 5.0)))
SCORER = LinearScorer(("bad", "good", "apart"), ("a__mean_30s", "b__mean_30s"), (0.0, 0.1, 0.0), ((0.3, 0.0), (0.0, 0.3), (0.2, 0.1)))
VERSIONS = (("model", "1"), ("schema", "2"))
SCORED = session.SessionConfig(("a", "b"), max_pending=3, spec=SPEC, scorer=SCORER, policy=Policy(0.4, 2, 0.4, 2), healthy="good", versions=VERSIONS)
CONFIGS = {
    "scored": SCORED, "without policy": session.SessionConfig(("a", "b"), spec=SPEC, scorer=SCORER, healthy="good"),
    "features": session.SessionConfig(("a", "b"), spec=SPEC), "assembled": session.SessionConfig(("a", "b"), max_pending=2), "single": session.SessionConfig(("a",)),
}


def readings(kind, seed, n=400):
    """(op, ts, name, value, unit, id, arrival, epoch): mostly whole samples, with what ``kind`` tells between them."""
    rng, rows, at = random.Random(seed), [], 0
    for k in range(n):
        at += 10
        names = ["a", "b"]
        value = lambda: rng.choice([0.0, 2.0, 2.5, 7.5, float(rng.randint(0, 99)) / 7])
        odd = rng.random() < (0.0 if kind == "plain" else 0.04 if kind != "wild" else 0.5)
        if odd:
            names = rng.choice([["b", "a"], ["a"], ["a", "a", "b"], ["a", "b", "c", "b"], ["c", "a", "b"], ["a", "b", "a"], ["b"]])
        ts = at - rng.choice([10, 30, 200]) if odd and rng.random() < 0.5 else at
        for name in names:
            v = value()
            empty = kind == "empty" and rng.random() < 0.01
            v = float("nan") if kind == "not a number" and rng.random() < 0.01 else v
            rows.append((session.EMPTY if empty else "reading", 1_000_000 * ts + (k % 3 == 0), name, None if empty else v, "u", f"e{len(rows)}", len(rows), int(len(rows) >= 300) + int(len(rows) >= 500)))
        if kind == "commands" and rng.random() < 0.02:
            rows.append((rng.choice(["reset", "flush"]), 0, None, None, None, None, len(rows), rows[-1][-1]))
    return rows


def one_by_one(state, rows, config):
    out, waiting = [], []
    for op, ts, name, value, unit, cause, _, epoch in rows:
        if epoch > state["epoch"] or op == "reset":
            out += session.finish(state, waiting, config)
            waiting = []
            session.reset(state)
            state["epoch"] = max(epoch, state["epoch"])
        if op == "flush":
            waiting += session.flushed(state, config)
        elif op != "reset":
            waiting += session.assemble(state, ts, name, value, unit, cause, 0, config)
    out += session.finish(state, waiting, config)
    return session.result_rows("x", out).to_pylist() if out else []


def table(rows):
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), session.READING)], schema=session.READING)


def by_columns(state, rows, config):
    made = columns.taken([state], columns.Readings(table(rows), ["x"], [0, len(rows)]), 0, config)
    return [r for part in made for r in part.to_pylist()]


def ordered(rows):
    return sorted(map(str, rows))


@pytest.mark.parametrize("config", CONFIGS.values(), ids=CONFIGS)
@pytest.mark.parametrize("kind", ["plain", "some", "wild", "commands", "empty", "not a number"])
def test_columns_equal_steps(config, kind):
    for seed in range(6):
        rows, rng = readings(kind, seed), random.Random(seed)
        cuts = [0, *sorted(rng.sample(range(1, len(rows)), 3)), len(rows)]
        one, many = session.new_state(), session.new_state()
        for a, b in zip(cuts[:-1], cuts[1:]):
            assert ordered(by_columns(many, rows[a:b], config)) == ordered(one_by_one(one, rows[a:b], config))
            many = session.read_state(session.stored_state(many))
            assert str(many) == str(one)


@pytest.mark.parametrize("config", CONFIGS.values(), ids=CONFIGS)
def test_many_sessions_at_once_equal_one_after_the_other(config, monkeypatch):
    """Sessions of all kinds share a bucket; some begin, some go on, and resets meet whole samples."""
    kinds = ["plain", "some", "plain", "commands", "not a number", "plain", "wild", "plain"]
    everything = [readings(kind, 10 + i, 150 + 10 * i) for i, kind in enumerate(kinds)]
    for rows in everything[2:6:3]:
        rows.insert(120, ("reset", 0, None, None, None, None, rows[120][6], rows[119][7]))
    one, many = ([session.new_state() for _ in kinds] for _ in range(2))
    for part in (slice(0, 170), slice(170, 171), slice(171, 600)):
        some = [i for i, rows in enumerate(everything) if rows[part]]
        together = [r for i in some for r in everything[i][part]]
        borders = np.cumsum([0, *[len(everything[i][part]) for i in some]]).tolist()
        states = [many[i] for i in some]
        made = columns.taken(states, columns.Readings(table(together), [f"x{i}" for i in some], borders), 0, config)
        expected = [{**r, "asset_id": f"x{i}"} for i in some for r in one_by_one(one[i], everything[i][part], config)]
        assert ordered(r for m in made for r in m.to_pylist()) == ordered(expected)
        assert str(one) == str(many)


def test_sessions_come_from_a_bucket_in_the_order_of_arrival(monkeypatch):
    rows = [("reading", n, "t", float(n), "u", None, 7 - n // 3, 0, asset) for n in range(20) for asset in ("b", None, "a")]
    flat = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), session.OWNED)], schema=session.OWNED)
    cells = [pd.DataFrame({"readings": [b.serialize().to_pybytes() for b in flat.to_batches(max_chunksize=7)]})]
    for most, calls in ((1_000, 1), (45, 2), (5, 3)):
        monkeypatch.setattr(session, "TOGETHER", most)
        found = list(session.by_session(iter(cells)))
        assert len(found) == calls and [a for assets, _, _ in found for a in assets] in (["b", "a", None], [None, "b", "a"])
        for assets, borders, part in found:
            for asset, a, b in zip(assets, borders[:-1], borders[1:]):
                mine = part.slice(a, b - a).to_pylist()
                assert {r["asset_id"] for r in mine} == {asset} and len(mine) == 20
                assert [r["ts"] for r in mine] == sorted(range(20), key=lambda n: (7 - n // 3, n))


def test_whole_samples_are_not_taken_one_by_one(monkeypatch):
    """A micro-batch without odd readings costs no step for each reading or sample."""
    rows = readings("plain", 1)
    expected = one_by_one(session.new_state(), rows, SCORED)

    def never(*_):
        raise AssertionError("one by one")

    for name in ("assemble", "complete", "result_rows", "evidence"):
        monkeypatch.setattr(session, name, never)
    found = by_columns(session.new_state(), rows, SCORED)
    assert ordered(found) == ordered(expected) and {r["event_type"] for r in found} > {"new_alert"} and {r["status"] for r in found} == {"warming_up", "valid_prediction", "insufficient_data"}


def test_late_readings_are_not_taken_one_by_one(monkeypatch):
    rows = [("reading", 1_000_000 * (50 - k % 50) + k, "a", float(k), "u", f"e{k}", k, 0) for k in range(500)]
    expected = one_by_one(session.new_state(), rows, CONFIGS["single"])
    monkeypatch.setattr(session, "assemble", None)
    found = by_columns(session.new_state(), rows, CONFIGS["single"])
    assert ordered(found) == ordered(expected) and sum(r["reason"] == "late" for r in found) > 400


def test_scores_are_rounded_as_numbers_are():
    rng = random.Random(5)
    shares = [rng.random() for _ in range(20_000)] + [0.0, 1.0, *[(k + 0.5) * 1e-9 for k in range(5_000)], *[(rng.randint(0, 10**9 - 1) + 0.5) / 1e9 for _ in range(20_000)]]
    for digits in (9, 2, 0, 15):
        assert rounded(np.array(shares), digits).tolist() == [round(x, digits) for x in shares]


RESULTS = [("x", 1, "result", "new_alert", None), ("x", 2, "result", None, None), ("y", 1, "quality", None, "late")]


def test_three_sinks_hold_no_batch_in_memory_and_a_replayed_batch_leaves_no_copies(spark, tmp_path):
    def batch(rows):
        given = spark.createDataFrame(rows, "asset_id string, n long, kind string, event_type string, reason string")
        columns = [part.split(" ") for part in session.OUTPUT.split(", ")]
        at = F.timestamp_seconds("n").alias("timestamp")
        return given.select(*[at if c == "timestamp" else F.col(c) if c in given.columns else F.lit(None).cast(kind).alias(c) for c, kind in columns])

    write, path = session.fan_out(str(tmp_path)), str(tmp_path)
    held = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    for number, rows in ((0, RESULTS), (1, RESULTS[2:]), (2, RESULTS[:0]), (0, RESULTS[1:])):
        write(batch(rows), number)
    found = {name: spark.read.parquet(f"{path}/{name}") for name in ("results", "transitions", "quality")}
    assert found["results"].select("asset_id", "kind", "batch_id").collect() == [("x", "result", 0)]
    assert found["transitions"].count() == 0 and found["quality"].select("asset_id", "reason", "batch_id").sort("batch_id").collect() == [("y", "late", 0), ("y", "late", 1)]
    write(batch(RESULTS), 3)
    assert spark.read.parquet(f"{path}/transitions").select("asset_id", "transition_type").collect() == [("x", "confirmed")]
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == held and not list(tmp_path.glob("staged/*"))
