import random

import pytest
from pyspark.sql import functions as F

from sensorloom.operators import features, series

SPEC = features.FeatureSpec(signals=("a", "b"))


@pytest.mark.parametrize("block", [200_000, 37])
def test_windows_made_as_arrays_are_the_same_bits(spark, monkeypatch, block):
    monkeypatch.setattr(series, "BLOCK_ROWS", block)
    draw = random.Random(5)
    odd = [None, None, 0.0, -0.0, float("nan"), float("inf"), 1e300]
    number = lambda: draw.choice(odd) if draw.random() < 0.04 else draw.gauss(5, 3)
    rows = [(r, t, None if draw.random() < 0.03 else t * 10.0, number(), 7.25 if r == 2 else number(), f"x{t}") for r in (1, 2, None) for t in range(1, 151)]
    rows += [(n, 1, 10.0, 1.5, None, "one") for n in range(50, 60)]
    df = spark.createDataFrame(rows, "r int, tick long, elapsed double, a double, b double, note string").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    try:
        plain = features.with_windows(df, SPEC, ["r"])
        whole = features.with_windows(df, SPEC, ["r"], whole=True)
        assert whole.columns == plain.columns
        bits = lambda d: {(x[0], x[1]): x for x in d.select("r", "tick", "note", *[F.col(c).cast("string").alias(c) for c in d.columns if "__" in c]).collect()}
        expected, found = bits(plain), bits(whole)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found) == whole.count() == len(rows)
    for key, row in expected.items():
        differ = {c: (row[c], found[key][c]) for c in row.asDict() if row[c] != found[key][c]}
        assert not differ, (key, differ)


def test_whole_rows_are_made_without_window_expressions(spark):
    df = spark.createDataFrame([(1, 1, 10.0, 1.0, 2.0)], "r int, tick long, elapsed double, a double, b double")
    plan = features.with_windows(df, SPEC, ["r"], whole=True)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "regr_slope" not in plan and "stddev" not in plan
