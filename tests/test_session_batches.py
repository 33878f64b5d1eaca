"""Samples worked up together equal samples worked up one by one, and plain statistics of each window."""

import math
import random

import pytest

from sensorloom.functions.hysteresis import Policy
from sensorloom.functions.linear import LinearScorer
from sensorloom.operators.features import FeatureSpec, Ratio, Residual
from sensorloom.streaming import session

SPEC = FeatureSpec(signals=("a", "b"), ratios=(Ratio("a_per_b", "a", "b", 1.0),), residuals=(Residual("rest", "a", "b", 0.5, 0.2, 10.0),))
SCORER = LinearScorer(("bad", "good"), ("a__mean_30s", "b__mean_30s"), (0.0, 0.1), ((0.3, 0.0), (0.0, 0.3)))
SCORED = session.SessionConfig(("a", "b"), spec=SPEC, scorer=SCORER, policy=Policy(0.5, 2, 0.5, 2), healthy="good", versions=(("model", "1"),))
PLAIN = session.SessionConfig(("a", "b"), spec=SPEC)


def samples(n=60):
    rng = random.Random(3)
    return [{"ts": 10_000_000 * k, "values": {"a": float(rng.randint(0, 9)), "b": rng.choice([0.0, 2.0, 7.5])}} for k in range(1, n + 1)]


def plain(values, elapsed):
    n = len(values)
    mean, centre = math.fsum(values) / n, math.fsum(elapsed) / n
    spread = math.fsum((x - centre) ** 2 for x in elapsed)
    slope = math.fsum((x - centre) * (y - mean) for x, y in zip(elapsed, values)) / spread
    std = math.sqrt(math.fsum((y - mean) ** 2 for y in values) / n)
    return {"mean": mean, "std": std, "min": min(values), "max": max(values), "slope": slope, "delta": values[-1] - values[0]}


@pytest.mark.parametrize("config", [SCORED, PLAIN])
def test_samples_together_equal_one_by_one(config):
    one, all_at_once, some = session.new_state(), session.new_state(), session.new_state()
    single = [r for s in samples() for r in session.complete(one, [s], config)]
    assert single == session.complete(all_at_once, samples(), config)
    rows = samples()
    assert single == [r for part in (rows[:5], rows[5:12], rows[12:40], rows[40:]) for r in session.complete(some, part, config)]
    assert one == all_at_once == some and len(one["window"]) == 12
    assert [r["status"] for r in single[:12]][-2:] != ["warming_up"] * 2 and {r["status"] for r in single[11:]} == {"valid_prediction", "insufficient_data"}
    if config is SCORED:
        assert {r.get("event_type") for r in single} > {None, "new_alert"}


def test_features_of_every_window_at_once():
    window = [[10.0 * n, s["values"]] for n, s in enumerate(samples(), 1)]
    found, problems = session.feature_values(window, SPEC)
    assert len(problems) == 49 and all(len(v) == 49 for v in found.values())
    for i in range(49):
        for signal in SPEC.signals:
            for k in SPEC.frames:
                part = window[i + 12 - k : i + 12]
                for name, value in plain([v[signal] for _, v in part], [t for t, _ in part]).items():
                    assert found[f"{signal}__{name}_{10 * k}s"][i] == pytest.approx(value, abs=1e-12)
        last = window[i + 11][1]
        assert (problems[i] == "near_zero_denominator") == (last["b"] < 1.0) == math.isnan(found["a_per_b"][i])
        assert found["rest"][i] == last["a"] - (0.5 + last["b"] / 10.0 * 0.2)


def test_a_replay_is_read_by_as_many_tasks_as_run_at_a_time(spark, tmp_path, monkeypatch):
    from sensorloom.catalogue import load

    load()  # relations of one module build on those of others
    from sensorloom.catalogue import c10_streaming

    seen, write = [], c10_streaming.replay.write_arrivals
    monkeypatch.setattr(c10_streaming.replay, "write_arrivals", lambda rows, path, key, chunks, files=2: (seen.append(files), write(rows, path, key, chunks, files)))
    line = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_discount double, l_tax double"
    rows = [(k, n, 1, 1, float(n), 0.0 if k % 3 == 0 else 0.05, 0.05) for k in range(30) for n in range(1, 4)]
    spark.createDataFrame(rows, line).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = {(r["reason"], r["malformed"]): r["n"] for r in c10_streaming.r08k(spark, str(tmp_path)).groupBy("reason", "malformed").sum("rows").toDF("reason", "malformed", "n").collect()}
    assert found == {("malformed", "unsupported_version"): 30} and seen == [spark.sparkContext.defaultParallelism]
