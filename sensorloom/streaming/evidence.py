"""Corroboration of a stream of alert transitions.

One operator keyed by asset holds what an asset's next transition needs to know: the last transition, its fault class and
its investigation, and the ids of the events seen. It starts from the evidence table (its initial state), so a micro-batch
reads no evidence at all; evidence of a batch is made from the batch and the readings of its time span, and goes to a sink
that leaves one row of each event.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sensorloom.operators import corroboration as co
from sensorloom.streaming import tables
from sensorloom.streaming.session import ROCKSDB

INVESTIGATED = (
    "event_id string, asset_id string, observed_at timestamp, transition_type string, fault_class string, "
    "investigation_id string, investigation_status string, previous_fault_class string, is_new_investigation boolean"
)


class Investigations(StatefulProcessor):
    """Assigns an asset's transitions to investigations, in the order of time within a micro-batch."""

    def __init__(self, seen_ms: int | None) -> None:
        self.seen_ms = seen_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "transition_type string, fault_class string, investigation_id string")
        self.seen = handle.getMapState("seen", "event_id string", "known boolean", self.seen_ms)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        row = initialState
        self.last.update((row["transition_type"], row["fault_class"], row["investigation_id"]))
        for event_id in row["event_ids"]:
            self.seen.updateValue((event_id,), (True,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        asset = key[0]
        before, fault, current = self.last.get() if self.last.exists() else (None, None, None)
        for r in sorted(rows, key=lambda r: (r["observed_at"], r["event_id"])):
            if self.seen.containsKey((r["event_id"],)):
                continue
            self.seen.updateValue((r["event_id"],), (True,))
            opens = before is None or before == "cleared"
            cleared = r["transition_type"] == "cleared"
            if opens:
                current = "inv-" + hashlib.sha256(f"{asset}|{r['event_id']}".encode()).hexdigest()[:16]
            previous = fault if not opens and (cleared or fault != r["fault_class"]) else None
            before, fault = r["transition_type"], r["fault_class"]
            yield Row(
                event_id=r["event_id"], asset_id=asset, observed_at=r["observed_at"], transition_type=before, fault_class=fault,
                investigation_id=current, investigation_status="CLEARED" if cleared else "OPEN", previous_fault_class=previous,
                is_new_investigation=opens,
            )
        if before is not None:
            self.last.update((before, fault, current))

    def close(self) -> None:
        pass


def known(evidence: DataFrame) -> DataFrame:
    """One row per asset of an evidence table, as the operator's initial state."""
    newest = F.max_by(F.struct("transition_type", "fault_class", "investigation_id"), F.struct("observed_at", "event_id"))
    rows = evidence.groupBy("asset_id").agg(newest.alias("_n"), F.collect_set("event_id").alias("event_ids"))
    return rows.select("asset_id", "_n.*", "event_ids")


def investigation_stream(transitions: DataFrame, evidence: DataFrame | None = None, seen_seconds: float | None = None) -> DataFrame:
    """Valid transitions with their investigations, each event once; ``evidence`` is what earlier streams have left.

    ``seen_seconds`` forgets event ids that long after they came (none: never).
    """
    spark = transitions.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    valid = co.validate_transitions(transitions).filter(F.col("reject_reason").isNull())
    keyed = valid.select("event_id", "asset_id", "observed_at", "transition_type", "fault_class").groupBy("asset_id")
    return keyed.transformWithState(
        statefulProcessor=Investigations(None if seen_seconds is None else int(seen_seconds * 1000)),
        outputStructType=INVESTIGATED,
        outputMode="Append",
        timeMode="None" if seen_seconds is None else "ProcessingTime",
        initialState=None if evidence is None else known(evidence).groupBy("asset_id"),
    )


def evidence_schema(observations: DataFrame) -> T.StructType:
    """Columns of the evidence table."""
    empty = observations.sparkSession.createDataFrame([], INVESTIGATED)
    return co.recommended(empty, observations).schema


def evidence_batches(path: str, observations: DataFrame, seconds: float = co.WINDOW_SECONDS, limit: int = co.SAMPLE_LIMIT) -> Callable[[DataFrame, int], None]:
    """Micro-batch handler: corroborate investigated transitions and keep one row of evidence for each event.

    A batch takes the readings of its own assets and time span, read from ``observations`` once.
    """
    put = tables.keyed_sink(path, "event_id", "observed_at")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # read for the time span and for the evidence
        low, high = batch.agg(F.min("observed_at"), F.max("observed_at")).first()
        if low is not None:
            span = F.col("timestamp").between(F.lit(low - timedelta(seconds=seconds)), F.lit(high))
            near = observations.filter(span).join(batch.select("asset_id").distinct(), "asset_id", "left_semi")
            near = near.select(*observations.columns).persist()  # read for the sizes of its series, to find windows and to fetch rows
            put(co.recommended(batch, near, seconds, limit), batch_id)
            near.unpersist()
        batch.unpersist()

    return write


def read_evidence(spark, path: str, observations: DataFrame) -> DataFrame:
    return tables.read_keyed(spark, path, evidence_schema(observations))
