from datetime import datetime, timedelta

from sensorloom.streaming import evidence

START = datetime(2024, 5, 1)


def test_a_batch_takes_the_readings_of_its_own_assets(spark, tmp_path, monkeypatch):
    readings = spark.createDataFrame(
        [(f"{a}-{i}", a, START + timedelta(minutes=i), m, float(i)) for a in ("a", "b", "c") for m in ("stack_temperature", "coolant_flow") for i in range(12)],
        "id string, asset_id string, timestamp timestamp, measurement_type string, value double",
    )
    rows = [(f"e-{a}", a, START + timedelta(minutes=12), "confirmed", "cooling_degradation", f"inv-{a}", "OPEN", None, True) for a in ("a", "c")]
    batch = spark.createDataFrame(rows, evidence.INVESTIGATED)
    taken, whole = [], evidence.co.recommended

    def catch(investigated, obs, *rest):
        taken.append({r["asset_id"] for r in obs.select("asset_id").distinct().collect()})
        return whole(investigated, obs, *rest)

    expected = {tuple(map(str, r)) for r in whole(batch, readings).collect()}
    monkeypatch.setattr(evidence.co, "recommended", catch)
    evidence.evidence_batches(str(tmp_path / "evidence"), readings)(batch, 0)
    assert taken == [{"a", "c"}]
    monkeypatch.undo()
    found = evidence.read_evidence(spark, str(tmp_path / "evidence"), readings)
    assert {tuple(map(str, r)) for r in found.collect()} == expected and len(expected) == 2
