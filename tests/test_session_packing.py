"""Readings reach a session as one row of each asset, and results leave it as they are."""

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from sensorloom.streaming import replay, session

ASSETS = ["a", "b", None, "c"]


def batches(rounds=50, size=16):
    rows = [(asset, "reading", 10 * n, "t", float(n), "u", None, 100 - n, 0) for n in range(rounds) for asset in ASSETS]
    schema = pa.schema([("asset_id", pa.string()), *session.READING])
    table = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    return table.to_batches(max_chunksize=size)


def test_readings_of_an_asset_are_one_row_and_come_back_in_order(monkeypatch):
    found = pa.Table.from_batches(session.packed(iter(batches()))).to_pandas()
    assert sorted(found["asset_id"], key=str) == sorted(ASSETS, key=str)
    for cells in found["readings"]:
        got = list(session.in_arrival_order(iter([pd.DataFrame({"readings": [cells]})])))
        assert got == [("reading", 10 * n, "t", float(n), "u", None, 0) for n in range(49, -1, -1)]
    monkeypatch.setattr(session, "PACKED_ROWS", 20)
    assert sum(b.num_rows for b in session.packed(iter(batches()))) == 3 * len(ASSETS)


def test_results_keep_their_fields_through_the_bytes():
    some = {"ts": 5, "kind": "result", "status": "s", "sample_no": 1, "values": {"x": None, "y": 2.0}, "evidence": [("l", 0.5, "d"), ("m", 1.0, "e")]}
    bare = {"ts": 6, "kind": "quality", "reason": "late", "event_id": "e", "invalid_features": ["x"]}
    cell = session.result_rows("k", [some, bare, some]).serialize().to_pybytes()
    batch = pa.RecordBatch.from_arrays([pa.array([cell, cell], pa.binary())], ["results"])
    (got,) = session.unpacked(iter([batch]))
    first, second, *_ = got.to_pylist()
    assert got.num_rows == 6 and got.schema == session.RESULT and first["asset_id"] == "k" and first["versions"] is None
    assert first["values"] == [("x", None), ("y", 2.0)] and [tuple(e.values()) for e in first["evidence"]] == some["evidence"]
    assert second["values"] is second["evidence"] is None and second["invalid_features"] == ["x"] and second["timestamp"].microsecond == 6


def test_a_session_gets_few_rows_however_many_readings_there_are(spark, tmp_path):
    rows = spark.range(3000).select(
        F.concat(F.lit("asset-"), (F.col("id") % 3).cast("string")).alias("asset_id"), F.timestamp_seconds("id").alias("timestamp"),
        F.lit("t").alias("measurement_type"), F.col("id").cast("double").alias("value"), F.lit("u").alias("unit"), F.col("id").alias("arrival"),
    )
    replay.write_arrivals(rows, str(tmp_path / "in"), "asset_id", 1, 1)
    results = session.session_stream(replay.read_arrivals(spark, str(tmp_path / "in"), rows.schema), session.SessionConfig(("t",)))
    query = session.start_available(results, lambda batch, i: batch.write.parquet(str(tmp_path / f"out-{i}")), str(tmp_path / "checkpoint"))
    query.awaitTermination()
    read = sum(o.get("numRowsUpdated", 0) for p in query.recentProgress for o in p["stateOperators"])
    assert spark.read.parquet(str(tmp_path / "out-0")).groupBy("asset_id").agg(F.max("sample_no")).sort("asset_id").collect() == [(f"asset-{i}", 1000) for i in range(3)]
    assert 0 < read <= 3
