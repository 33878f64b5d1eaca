import random
import statistics

import pytest
from pyspark.sql import functions as F

from sensorloom.functions.hysteresis import Policy
from sensorloom.operators import alerts, joins, series


@pytest.fixture
def tiny_blocks(monkeypatch):
    monkeypatch.setattr(series, "HOT_ROWS", 20)
    monkeypatch.setattr(series, "BLOCK_ROWS", 7)
    monkeypatch.setattr(alerts, "FOLD_BLOCK_ROWS", 9)


def rows(n=300, seed=1):
    rng = random.Random(seed)
    # one key holds most rows
    return [("hot" if rng.random() < 0.7 else f"k{rng.randrange(5)}", i, float(rng.randrange(10))) for i in range(n)]


def test_position_and_lag_match_plain_python(spark, tiny_blocks):
    data = rows()
    df = spark.createDataFrame(data, "k string, t long, v double").repartition(5)
    numbered = series.with_position(df, ["k"], ["t"], F.floor(F.col("t") / 10))
    out = series.lagged(numbered, ["k"], {"p": lambda w: F.lag("v", 3).over(w)}, halo=3)
    out = series.running_total(out, ["k"], F.col("v"), "s")
    got = {(r.k, r.t): (r.pos, r.p, r.s) for r in out.collect()}
    by_key = {}
    for k, t, v in sorted(data, key=lambda r: r[1]):
        seen = by_key.setdefault(k, [])
        seen.append(v)
        assert got[(k, t)] == (len(seen), seen[-4] if len(seen) > 3 else None, sum(seen))


def test_exact_quantiles(spark):
    data = rows(500)
    df = spark.createDataFrame(data, "k string, t long, v double")
    got = {r.k: r.m for r in series.exact_median(df, ["k"], "v", "m").collect()}
    for k in got:
        assert got[k] == statistics.median([v for kk, _, v in data if kk == k])


def test_islands(spark, tiny_blocks):
    values = [1, 1, 2, 2, 2, 1, 1, 1, 1, 3, 3, 1] * 4
    df = spark.createDataFrame([("a", i + 1, v) for i, v in enumerate(values)], "k string, pos long, v int")
    runs = series.islands(df, ["k"], ["v"]).groupBy("island").count().collect()
    expected, length = [], 0
    for i, v in enumerate(values):
        length += 1
        if i + 1 == len(values) or values[i + 1] != v:
            expected.append(length)
            length = 0
    assert sorted(r["count"] for r in runs) == sorted(expected)


def test_fold_is_the_same_in_blocks(spark, tiny_blocks):
    rng = random.Random(5)
    data = []
    for t in range(1, 120):
        a, n = rng.random(), rng.random()
        data.append((1, t, t * 10.0, round(a / (a + n + 0.5), 9), round(n / (a + n + 0.5), 9), round(0.5 / (a + n + 0.5), 9)))
    df = spark.createDataFrame(data, "run_id long, tick long, elapsed double, p_A double, p_N double, p_R double")
    grid = [Policy(0.4, 2, 0.4, 2), Policy(0.35, 3, 0.3, 1)]
    events = lambda size: sorted(
        (r.policy_id, r.pos, r.event_type, r.fault_class)
        for r in alerts.events_of(alerts.alert_fold(df, ["run_id"], ["A", "N", "R"], "N", grid, block_rows=size)).collect()
    )
    assert events(9) == events(10_000) != []


def test_as_of_join_forward_and_backward(spark):
    left = spark.createDataFrame([("a", 5), ("a", 20), ("b", 1)], "k string, d int")
    right = spark.createDataFrame([("a", 3, "x"), ("a", 6, "y"), ("a", 25, "z")], "k string, d int, v string")
    def stamp(df):
        return df.withColumn("t", F.make_timestamp(F.lit(2024), F.lit(1), "d", F.lit(0), F.lit(0), F.lit(0)))

    back = joins.as_of_join(stamp(left), stamp(right), ["k"], "t", "t", ["v"])
    ahead = joins.as_of_join(stamp(left), stamp(right), ["k"], "t", "t", ["v"], forward=True)
    assert {(r.k, r.d): r.v for r in back.collect()} == {("a", 5): "x", ("a", 20): "y", ("b", 1): None}
    assert {(r.k, r.d): r.v for r in ahead.collect()} == {("a", 5): "y", ("a", 20): "z", ("b", 1): None}
