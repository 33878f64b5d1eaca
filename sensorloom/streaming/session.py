"""Stateful telemetry sessions: sample assembly, rolling features, scoring and alerting per asset.

One ``transformWithStateInPandas`` operator keeps a small bounded state of each asset: at most ``max_pending`` half-filled
samples (with a timer), the last ``warmup`` complete samples, one alert machine and the number of
the last reset of all sessions. Its rows are tagged: results, and quality rows for late readings, conflicting readings and
samples that stay incomplete. The same pure functions serve the unit tests and the comparison with batch.

Readings of one asset are taken in the order of ``arrival`` within a micro-batch; sources bound a micro-batch by
``maxFilesPerTrigger`` (``streaming.replay``), so what is ordered at a time is bounded. The functions here tell the rules
reading by reading; :mod:`sensorloom.streaming.columns` applies them to the readings of a micro-batch as arrays.

The operator's cost lies in its rows and keys more than in its rules, so its keys are buckets of assets, readings come to it as
Arrow bytes, those of a bucket among many thousands as one row, and its results leave it likewise: :func:`packed` and
:func:`unpacked` stand before and behind.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sensorloom.functions import hysteresis as hy
from sensorloom.functions.linear import LinearScorer, trailing_statistics
from sensorloom.functions.scalar import name_uuid
from sensorloom.operators.corroboration import RESULT_NAMESPACE
from sensorloom.operators.features import FeatureSpec

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = (
    "asset_id string, timestamp timestamp, kind string, status string, reason string, detail string, event_id string, sample_no long, "
    "values map<string,double>, scores map<string,double>, diagnosed_class string, maximum_score double, alert_state string, "
    "event_type string, from_state string, to_state string, fault_class string, invalid_features array<string>, "
    "evidence array<struct<label:string,value:double,detail:string>>, versions map<string,string>"
)
EVIDENCE = pa.struct([("label", pa.string()), ("value", pa.float64()), ("detail", pa.string())])
ARROW = {
    "string": pa.string(), "timestamp": pa.timestamp("us", "UTC"), "long": pa.int64(), "double": pa.float64(), "array<string>": pa.list_(pa.string()),
    "map<string,double>": pa.map_(pa.string(), pa.float64()), "map<string,string>": pa.map_(pa.string(), pa.string()),
    "array<struct<label:string,value:double,detail:string>>": pa.list_(EVIDENCE),
}
RESULT = pa.schema([(name, ARROW[kind]) for name, kind in (part.split() for part in OUTPUT.split(", "))])
READING = pa.schema(
    [("op", pa.string()), ("ts", pa.int64()), ("measurement_type", pa.string()), ("value", pa.float64()), ("unit", pa.string()), ("event_id", pa.string())]
    + [("arrival", pa.int64()), ("epoch", pa.int64())]
)
OWNED = READING.append(pa.field("asset_id", pa.string()))  # readings of several assets
PACKED_READINGS = 400_000  # that a task packs at a time
PACKED_ROWS = 10_000  # readings or results in one row at most
BATCH_BYTES = str(64 << 20)  # of rows that Spark and a Python task hand each other at a time
BUCKETS = 1_024  # keys of the operator, each with the sessions of the assets whose hash falls to it
TOGETHER = 50_000  # readings of the sessions that are taken at a time, on average
SESSION = "state string"  # as JSON
ASSET = "asset_id string, known boolean"
TOP_RESIDUALS = 2  # of the evidence of a prediction
MAX_EVIDENCE = 5
EMPTY = "empty"  # op of a reading without a value

# Texts of quality rows and evidence items.
LATE = "timestamp {at} does not follow the asset's last processed sample {last}"
CONFLICT = "measurement {name!r} conflicts with an already-buffered value for this asset/timestamp"
EVICTED = "evicted to stay within max_buffered_timestamps_per_asset; missing measurement(s): {}"
TIMED_OUT = "missing measurement(s) after timeout: {}"
ENDED = "missing measurement(s) at end of input: {}"
RESIDUAL = "observed minus fixed healthy reference curve"
NEAR_ZERO = "near_zero_denominator"
EXIT_PROGRESS = "confirmed_{name}: exit_streak {n}/{of} consecutive healthy-qualifying samples"
ENTRY_PROGRESS = "pending_{name}: {n}/{of} consecutive qualifying samples"


@dataclass(frozen=True)
class SessionConfig:
    """``max_pending`` half-filled samples of an asset are kept; one more puts out the oldest as incomplete."""

    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    timeout_seconds: float = 30.0
    max_pending: int = 8
    spec: FeatureSpec | None = None
    scorer: LinearScorer | None = None
    policy: hy.Policy | None = None
    healthy: str = "healthy"
    cadence: float = 10.0
    versions: tuple[tuple[str, str], ...] = ()  # name and version of what a prediction was made with


def new_state() -> dict:
    return {"pending": {}, "last": None, "count": 0, "epoch": 0, "window": [], "machine": list(hy.START)}


def ingest(state: dict, event: dict, now_ms: int, config: SessionConfig) -> list[dict]:
    """Feed one reading (ts in microseconds) and return what it causes, with details."""
    found = assemble(state, event["ts"], event["measurement_type"], event["value"], event["unit"], event.get("event_id"), now_ms, config)
    return finish(state, found, config)


def assemble(state: dict, ts: int, name: str, value: float, unit: str, cause: str | None, now_ms: int, config: SessionConfig) -> list[dict]:
    """What one reading causes; a sample that it completes has no ``kind`` yet and is worked up by :func:`finish`."""
    if state["last"] is not None and ts <= state["last"]:
        why = LATE.format(at=iso(ts), last=iso(state["last"]))
        return [_reject(ts, "late", why, cause)]
    out = []
    pending = state["pending"].get(ts)
    if pending is None:
        if len(state["pending"]) >= config.max_pending:
            oldest = next(iter(state["pending"]))
            out.append(_incomplete(state, oldest, EVICTED, config))
        pending = state["pending"][ts] = {"seen": now_ms, "values": {}, "units": {}}
    values = pending["values"]
    if name in values:
        if values[name] == value and pending["units"][name] == unit:
            return out
        del state["pending"][ts]
        why = CONFLICT.format(name=name)
        return [*out, _reject(ts, "conflicting_duplicate", why, cause)]
    values[name], pending["units"][name] = value, unit
    if len(values) >= len(config.required) and all(m in values for m in config.required):
        del state["pending"][ts]
        state["last"] = ts
        out.append({"ts": ts, "values": values})
    return out


def finish(state: dict, outcomes: list[dict], config: SessionConfig) -> list[dict]:
    """Outcomes in their order, the completed samples among them worked up together."""
    results = iter(complete(state, [o for o in outcomes if "kind" not in o], config))
    return [o if "kind" in o else next(results) for o in outcomes]


def timed_out(state: dict, now_ms: int, config: SessionConfig) -> list[dict]:
    """Put out the half-filled samples whose time is over."""
    gone = [ts for ts, p in state["pending"].items() if now_ms - p["seen"] >= config.timeout_seconds * 1000]
    return [_incomplete(state, ts, TIMED_OUT, config) for ts in gone]


def flushed(state: dict, config: SessionConfig) -> list[dict]:
    """Put out all half-filled samples: no more input will come."""
    return [_incomplete(state, ts, ENDED, config) for ts in list(state["pending"])]


def reset(state: dict) -> None:
    """Back to a cold start of warm-up and alert; half-filled samples and the last timestamp belong to the assembly and stay."""
    state["count"], state["window"], state["machine"] = 0, [], list(hy.START)


def offer(state: dict, event: dict, now_ms: int, config: SessionConfig) -> list[dict]:
    """:func:`ingest` without causes and details."""
    return [_plain(o) for o in ingest(state, event, now_ms, config)]


def expire(state: dict, now_ms: int, config: SessionConfig) -> list[dict]:
    """:func:`timed_out` without details."""
    return [_plain(o) for o in timed_out(state, now_ms, config)]


def _plain(outcome: dict) -> dict:
    return {k: v for k, v in outcome.items() if k not in ("detail", "event_id")}


def iso(ts: int) -> str:
    """ISO text of microseconds since 1970, in UTC."""
    return _stamp(ts).isoformat()


def _stamp(ts: int):
    from datetime import datetime, timezone

    return datetime.fromtimestamp(ts // 1_000_000, timezone.utc).replace(microsecond=ts % 1_000_000)


def _reject(ts: int, reason: str, detail: str, event_id: str | None = None) -> dict:
    return {"ts": ts, "kind": "quality", "status": "rejected", "reason": reason, "detail": detail, "event_id": event_id}


def _incomplete(state: dict, ts: int, text: str, config: SessionConfig) -> dict:
    held = state["pending"].pop(ts)["values"]
    return _reject(ts, "incomplete_timeout", text.format(sorted(m for m in config.required if m not in held)))


def complete(state: dict, samples: Sequence[dict], config: SessionConfig) -> list[dict]:
    """Finished samples of one session, in order: count them, score them once the window is full, advance the alert machine."""
    first = state["count"] + 1
    results = [{"ts": s["ts"], "kind": "result", "status": "assembled", "sample_no": n, "values": s["values"]} for n, s in enumerate(samples, first)]
    state["count"] += len(results)
    if config.spec is None or not results:
        return results
    keep = max(config.spec.frames)
    window = [*state["window"], *([r["sample_no"] * config.cadence, r["values"]] for r in results)]
    early = min(len(results), max(0, keep - 1 - len(state["window"])))
    state["window"] = window[-keep:]
    for result in results[:early]:
        result["status"] = "warming_up"
    ready = results[early:]
    if not ready:
        return results
    features, problems = feature_values(window[-(len(ready) + keep - 1) :], config.spec)
    for i, (result, problem) in enumerate(zip(ready, problems)):
        result["status"], result["reason"] = "valid_prediction" if problem is None else "insufficient_data", problem
        if problem is not None:
            result["invalid_features"] = invalid_features({n: float(v[i]) for n, v in features.items()}, result["values"], config.spec)
    if config.scorer is not None:
        predict(state, ready, features, config)
        return results
    columns = [v.tolist() for v in features.values()]
    missing = [without_value(r["values"], config.spec) if problem is not None else () for r, problem in zip(ready, problems)]
    for result, row, gone in zip(ready, zip(*columns), missing):
        result["values"] = dict(zip(features, row))
        for name in gone:
            del result["values"][name]
    return results


def predict(state: dict, ready: Sequence[dict], features: dict[str, np.ndarray], config: SessionConfig) -> None:
    """Add scores, versions, alert state and evidence to samples whose window is full."""
    names = config.scorer.classes
    calm = names.index(config.healthy)
    residuals = [features[r.name].tolist() for r in config.spec.residuals]
    label = lambda c: names[calm] if c == hy.NONE else f"confirmed_{names[c]}"
    for i, (result, scores) in enumerate(zip(ready, config.scorer.score(features))):
        usable = result["reason"] is None
        scores = scores if usable else [0.0] * len(names)
        best = max(range(len(names)), key=lambda c: (scores[c], -c))
        if usable:
            result["scores"] = dict(zip(names, scores, strict=True))
            result["diagnosed_class"], result["maximum_score"] = names[best], scores[best]
            result["versions"] = dict(config.versions)
        if config.policy is not None:
            qualifies = best != calm and scores[best] >= config.policy.entry_probability
            machine, event = hy.advance(
                tuple(state["machine"]), best, qualifies, scores[calm] >= config.policy.exit_probability, usable, config.policy
            )
            state["machine"] = list(machine)
            result["alert_state"] = label(machine[0])  # the machine's state: what is pending shows in the evidence
            if event is not None:
                kind, before, after = event
                result.update(
                    event_type=kind, from_state=label(before), to_state=label(after), fault_class=names[after if after != hy.NONE else before]
                )
        if usable:
            mine = {r.name: values[i] for r, values in zip(config.spec.residuals, residuals)}
            result["evidence"] = evidence(mine, result, state["machine"], config)


def evidence(features: dict, result: dict, machine: Sequence[int], config: SessionConfig) -> list[tuple]:
    """(label, value, detail) of the two leading classes, the largest residuals and the alert's progress."""
    ranked = sorted(result["scores"].items(), key=lambda p: (-p[1], p[0]))
    items = [("top_class_probability", ranked[0][1], f"{ranked[0][0]} (diagnosed: {result['diagnosed_class']})")]
    items += [("runner_up_class_probability", ranked[1][1], ranked[1][0])] if len(ranked) > 1 else []
    residuals = sorted(((r.name, features[r.name]) for r in config.spec.residuals), key=lambda p: (-abs(p[1]), p[0]))
    items += [(f"residual:{name}", value, RESIDUAL) for name, value in residuals[:TOP_RESIDUALS]]
    if config.policy is not None:
        confirmed, candidate, streak, exits = machine
        names, policy = config.scorer.classes, config.policy
        if confirmed != hy.NONE:
            text = EXIT_PROGRESS.format(name=names[confirmed], n=exits, of=policy.exit_persistence)
            items.append(("alert_exit_progress", exits / policy.exit_persistence, text))
        elif candidate != hy.NONE:
            text = ENTRY_PROGRESS.format(name=names[candidate], n=streak, of=policy.entry_persistence)
            items.append(("alert_entry_progress", streak / policy.entry_persistence, text))
    return items[:MAX_EVIDENCE]


def without_value(sample: dict, spec: FeatureSpec) -> list[str]:
    """Ratios of a sample whose denominator is too near to zero."""
    return [r.name for r in spec.ratios if abs(sample[r.denominator]) < r.floor]


def invalid_features(features: dict, sample: dict, spec: FeatureSpec) -> list[str]:
    """Names of the features of a full window that have no finite value, sorted."""
    return sorted({*without_value(sample, spec), *(n for n, v in features.items() if not math.isfinite(v))})


def feature_values(window: Sequence, spec: FeatureSpec) -> tuple[dict[str, np.ndarray], list[str | None]]:
    """The batch feature rows of all samples that end a full window, a feature an array, and their rejection reasons.

    A ratio that has no value is not a number.
    """
    times = np.fromiter((t for t, _ in window), dtype=float, count=len(window))
    values = np.array([np.fromiter((v[s] for _, v in window), dtype=float, count=len(window)) for s in spec.signals])
    out, failed = feature_arrays(times, values, spec)
    return out, [NEAR_ZERO if f else None for f in failed.tolist()]


def feature_arrays(times: np.ndarray, values: np.ndarray, spec: FeatureSpec) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """:func:`feature_values` of times and one line of values per signal; which samples have a ratio without a value."""
    keep = max(spec.frames)
    count = len(times) - keep + 1
    now, before = values[:, keep - 1 :], values[:, keep - 2 : -1]
    frames = [(k, trailing_statistics(times[keep - k :], values[:, keep - k :], k)) for k in spec.frames]
    out: dict[str, np.ndarray] = {}
    for i, signal in enumerate(spec.signals):
        diff, rate = spec.steps(signal)
        out[signal] = now[i]
        out[diff] = now[i] - before[i]
        out[rate] = out[diff] / spec.cadence
        for k, stats in frames:
            out.update({f"{signal}__{s}_{int(k * spec.cadence)}s": x[i] for s, x in stats.items()})
    column = lambda name: now[spec.signals.index(name)]
    failed = np.zeros(count, dtype=bool)
    for ratio in spec.ratios:
        none = np.abs(column(ratio.denominator)) < ratio.floor
        out[ratio.name] = column(ratio.numerator) / np.where(none, np.nan, column(ratio.denominator))
        failed |= none
    for r in spec.residuals:
        out[r.name] = column(r.observed) - (r.intercept + column(r.driver) / r.rated * r.coefficient)
    return out, failed


def packed(batches: Iterator[pa.RecordBatch], by: str = "asset_id", schema: pa.Schema = READING) -> Iterator[pa.RecordBatch]:
    """Rows (``by``, readings of it among some :data:`PACKED_READINGS` as Arrow bytes), at most :data:`PACKED_ROWS` in one."""

    def grouped(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        key = rows.column(by).chunk(0)
        code = pc.fill_null(key.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        place = np.argsort(code, kind="stable")
        starts = np.flatnonzero(np.diff(code[place], prepend=-2))
        cuts = [(i, min(i + PACKED_ROWS, b)) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(place)]) for i in range(a, b, PACKED_ROWS)]
        body = rows.select(schema.names).take(pa.array(place)).combine_chunks().cast(schema).to_batches()[0]
        cells = pa.array([body.slice(a, b - a).serialize().to_pybytes() for a, b in cuts], pa.binary())
        return pa.RecordBatch.from_arrays([key.take(pa.array(place[[a for a, _ in cuts]])), cells], [by, "readings"])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= PACKED_READINGS:
            yield grouped(held)
            held, n = [], 0
    if n:
        yield grouped(held)


def packed_by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return packed(batches, "bucket", OWNED)


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The results of many sessions from their Arrow bytes, some :data:`PACKED_ROWS` at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for cell in batch.column("results"):
            held.append(pa.ipc.read_record_batch(cell.as_buffer(), RESULT))
            if sum(h.num_rows for h in held) >= PACKED_ROWS:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def arrival_order(rows: pa.Table, session: np.ndarray) -> np.ndarray:
    """Places of readings by session and arrival; what arrives at once goes by command, name, value and id."""
    arrival = rows.column("arrival").to_numpy()
    place = np.lexsort((arrival, session))
    same = (np.diff(arrival[place]) == 0) & (np.diff(session[place]) == 0)
    if same.any():
        edges = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(int)))
        for start, stop in zip(edges[::2].tolist(), (edges[1::2] + 1).tolist()):
            tied = rows.take(pa.array(place[start:stop]))
            op, name, value, cause = (listed(tied.column(c)) for c in ("op", "measurement_type", "value", "event_id"))
            number = lambda i: value[i] if op[i] == "reading" else 0.0
            order = sorted(range(stop - start), key=lambda i: (op[i] != "reset", name[i] or "", number(i) or 0.0, cause[i] or ""))
            place[start:stop] = place[start:stop][order]
    return place


def listed(column: pa.ChunkedArray) -> list:
    return [None] * len(column) if column.null_count == len(column) else column.to_numpy().tolist()


def in_arrival_order(parts: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """The readings of one session, reading by reading."""
    rows = pa.Table.from_batches([pa.ipc.read_record_batch(cell, READING) for part in parts for cell in part["readings"]]).combine_chunks()
    rows = rows.take(pa.array(arrival_order(rows, np.zeros(rows.num_rows, dtype=np.int64))))
    return zip(*(listed(rows.column(c)) for c in ("op", "ts", "measurement_type", "value", "unit", "event_id", "epoch")))


def by_session(parts: Iterator[pd.DataFrame]) -> Iterator[tuple[list[str | None], list[int], pa.Table]]:
    """Readings of some sessions after one another, each in the order of arrival: assets, borders of their rows, rows.

    Some :data:`TOGETHER` readings at a time, or those of one session.
    """
    rows = pa.Table.from_batches([pa.ipc.read_record_batch(cell, OWNED) for part in parts for cell in part["readings"]]).combine_chunks()
    asset = rows.column("asset_id").chunk(0).dictionary_encode()
    session = pc.fill_null(asset.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    place = arrival_order(rows, session)
    borders = np.append(np.flatnonzero(np.diff(session[place], prepend=-2)), len(place))
    names = asset.dictionary.to_pylist()
    first = 0
    while first < len(borders) - 1:
        last = max(first + 1, int(np.searchsorted(borders, borders[first] + TOGETHER, side="right")) - 1)
        low, high = int(borders[first]), int(borders[last])
        assets = [names[c] if c >= 0 else None for c in session[place[borders[first:last]]].tolist()]
        yield assets, (borders[first : last + 1] - low).tolist(), rows.take(pa.array(place[low:high])).combine_chunks()
        first = last


def result_rows(asset_id: str, outcomes: list[dict]) -> pa.RecordBatch:
    """Outcomes of one session as rows of the output."""

    def column(field: pa.Field) -> pa.Array:
        given = [o.get(field.name) for o in outcomes]
        if pa.types.is_map(field.type):
            given = [None if g is None else list(g.items()) for g in given]
        if field.type != RESULT.field("evidence").type:
            return pa.array(given, field.type, from_pandas=True)
        ends = np.cumsum([0, *(len(g or ()) for g in given)])
        parts = [pa.array([item[i] for g in given for item in g or ()], part.type, from_pandas=True) for i, part in enumerate(EVIDENCE)]
        items = pa.StructArray.from_arrays(parts, fields=list(EVIDENCE))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items, mask=pa.array([g is None for g in given]))

    first = [pa.array([asset_id] * len(outcomes), pa.string()), pa.array([o["ts"] for o in outcomes], pa.int64()).cast(ARROW["timestamp"])]
    return pa.RecordBatch.from_arrays([*first, *map(column, list(RESULT)[2:])], schema=RESULT)


def stored_state(state: dict) -> str:
    """JSON of a state; what maps by name is written as lists, the names of samples that follow one another once."""
    window = [[list(names), [[t, *v.values()] for t, v in some]] for names, some in groupby(state["window"], key=lambda s: tuple(s[1]))]
    pending = [[ts, p["seen"], list(p["values"]), list(p["values"].values()), list(p["units"].values())] for ts, p in state["pending"].items()]
    return json.dumps([*(state[k] for k in ("last", "count", "epoch", "machine")), window, pending])


def read_state(text: str) -> dict:
    last, count, epoch, machine, window, pending = json.loads(text)
    window = [[t, dict(zip(names, values))] for names, some in window for t, *values in some]
    pending = {ts: {"seen": seen, "values": dict(zip(names, values)), "units": dict(zip(names, units))} for ts, seen, names, values, units in pending}
    return {"pending": pending, "last": last, "count": count, "epoch": epoch, "window": window, "machine": machine}


class TelemetrySession(StatefulProcessor):
    """The sessions of a bucket of assets, each with its half-filled samples; timers put out what stays incomplete.

    A call costs as much as the work of many readings, so that sessions share one. Each is a value of its own, read and
    written where its asset has readings. ``due`` lists the assets whose half-filled samples may be over at a time.
    """

    def __init__(self, config: SessionConfig, live: bool) -> None:
        self.config = config
        self.live = live

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sessions = handle.getMapState("sessions", ASSET, SESSION)
        self.due = handle.getMapState("due", "at long", "assets array<string>") if self.live else None

    def _load(self, asset_id: str | None) -> dict:
        stored = self.sessions.getValue((asset_id or "", asset_id is not None))
        return new_state() if stored is None else read_state(stored[0])

    def _store(self, asset_id: str | None, state: dict) -> None:
        self.sessions.updateValue((asset_id or "", asset_id is not None), (stored_state(state),))

    def _rows(self, rows: pa.RecordBatch) -> Iterator[pd.DataFrame]:
        for start in range(0, rows.num_rows, PACKED_ROWS):
            yield pd.DataFrame({"results": [rows.slice(start, PACKED_ROWS).serialize().to_pybytes()]})

    def _wake(self, at: int, assets: Sequence[str | None]) -> None:
        known = self.due.getValue((at,))
        self.due.updateValue((at,), ([*([] if known is None else known[0]), *assets],))
        self.handle.registerTimer(at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        from sensorloom.streaming import columns

        now = timerValues.getCurrentProcessingTimeInMs() if self.live else 0
        begun: list[str | None] = []
        for assets, borders, table in by_session(rows):
            states = [self._load(asset_id) for asset_id in assets]
            before = [set(state["pending"]) for state in states]
            made = columns.taken(states, columns.Readings(table, assets, borders), now, self.config)
            for asset_id, state, held in zip(assets, states, before):
                self._store(asset_id, state)
                if self.live and state["pending"].keys() - held:
                    begun.append(asset_id)
            for part in made:
                yield from self._rows(part)
        if begun:
            self._wake(int(now + self.config.timeout_seconds * 1000), begun)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        assets = self.due.getValue((at,))
        for asset_id in dict.fromkeys(() if assets is None else assets[0]):
            state = self._load(asset_id)
            outcomes = timed_out(state, timerValues.getCurrentProcessingTimeInMs(), self.config)
            self._store(asset_id, state)
            if outcomes:
                yield from self._rows(result_rows(asset_id, outcomes))
        self.due.removeKey((at,))

    def close(self) -> None:
        pass


def session_stream(readings: DataFrame, config: SessionConfig, live: bool = False, resets: Sequence[int] = ()) -> DataFrame:
    """Results, warm-up notices and quality rejections for a stream of valid readings.

    ``readings`` need asset_id, timestamp, measurement_type, value, unit and ``arrival`` (for example the source offset),
    which orders the readings of one micro-batch, and may have ``event_id``. ``live`` adds the processing-time timeout of
    half-filled samples; it keeps the query asking for batches, so replays that should end leave it off and send ``flush``.

    Where ``readings`` have ``op``, rows with ``reset`` start the session of their asset anew, and ``flush`` tells that its
    input has ended. ``resets`` are the arrivals at which all sessions start anew (a short list): each row carries the
    number of those before it, and a session that sees a higher number than its own resets itself first.
    """
    readings.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    readings.sparkSession.conf.set("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")  # else each partition has buffers of its own
    readings.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    given = lambda name, other: F.col(name) if name in readings.columns else other
    past = [F.when(F.col("arrival") >= int(r), 1).otherwise(0) for r in resets]
    keyed = readings.select(
        F.col("asset_id").cast("string").alias("asset_id"), given("op", F.lit("reading")).alias("op"), F.unix_micros("timestamp").alias("ts"), "measurement_type",
        F.col("value").cast("double").alias("value"), "unit",
        given("event_id", F.lit(None)).cast("string").alias("event_id"), F.col("arrival").cast("long").alias("arrival"),
        (sum(past[1:], past[0]) if past else F.lit(0)).cast("long").alias("epoch"),
    )
    # commands need no time, and a reading without a value is marked, as a missing number and one that is no number look alike in pandas
    keyed = keyed.withColumns(
        {
            "op": F.when((F.col("op") == "reading") & F.col("value").isNull(), EMPTY).otherwise(F.col("op")),
            "ts": F.when(F.col("op") == "reading", F.col("ts")).otherwise(F.lit(0).cast("long")),
        }
    )
    keyed = keyed.withColumn("bucket", F.pmod(F.xxhash64("asset_id"), F.lit(BUCKETS)).cast("int"))
    sessions = keyed.mapInArrow(packed_by_bucket, "bucket int, readings binary").groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=TelemetrySession(config, live),
        outputStructType="results binary",
        outputMode="Append",
        timeMode="ProcessingTime" if live else "None",
    )
    return sessions.mapInArrow(unpacked, OUTPUT)


def assemble_batch(readings: DataFrame, required: Sequence[str]) -> DataFrame:
    """Batch twin of the assembly for data that arrives in time order: one row per (asset, timestamp)."""
    per_type = readings.groupBy("asset_id", "timestamp", "measurement_type").agg(
        F.min("value").alias("_lo"), F.max("value").alias("_hi"), F.min("unit").alias("_u0"), F.max("unit").alias("_u1")
    )
    clash = (F.col("_lo") != F.col("_hi")) | (F.col("_u0") != F.col("_u1"))
    grouped = per_type.groupBy("asset_id", "timestamp").agg(
        F.bool_or(clash).alias("_clash"),
        F.count_if(F.col("measurement_type").isin(*required)).alias("_present"),
        F.map_from_entries(F.collect_list(F.struct("measurement_type", "_lo"))).alias("values"),
    )
    status = (
        F.when(F.col("_clash"), "conflicting_duplicate").when(F.col("_present") < len(required), "incomplete_timeout").otherwise("complete")
    )
    return grouped.select("asset_id", "timestamp", status.alias("status"), "values")


def assemble_fold(readings: DataFrame, required: Sequence[str]) -> DataFrame:
    """Batch twin of the assembly, outcome by outcome, for samples whose readings arrive sample by sample.

    One row per outcome: asset_id, timestamp, status (``complete``, ``late``, ``conflicting_duplicate`` or
    ``incomplete_timeout``), and the sample's place among its outcomes. The readings of one sample are folded in the order
    of arrival with their names in a map; a sample's readings are few (its measurements and their repeats).
    """
    reading = F.struct("arrival", "measurement_type", "value", "unit")
    grouped = readings.groupBy("asset_id", "timestamp").agg(F.array_sort(F.collect_list(reading)).alias("_readings"))
    empty = F.from_json(F.lit("{}"), "map<string,struct<value:double,unit:string>>")
    start = F.struct(F.lit(False).alias("done"), empty.alias("held"), F.array().cast("array<string>").alias("out"))

    def step(state, r):
        done, held = state["done"], state["held"]
        known = F.map_contains_key(held, r["measurement_type"])
        before = F.element_at(held, r["measurement_type"])
        same = (before["value"] == r["value"]) & before["unit"].eqNullSafe(r["unit"])
        fresh = F.struct(r["value"].alias("value"), r["unit"].alias("unit"))
        added = F.map_concat(held, F.map_from_arrays(F.array(r["measurement_type"]), F.array(fresh)))
        full = F.size(F.array_intersect(F.map_keys(added), F.array(*[F.lit(m) for m in required]))) == len(required)
        event = F.when(done, "late").when(known & ~same, "conflicting_duplicate").when(~known & full, "complete")
        after = F.when(done, held).when(known & same, held).when(known, empty).otherwise(added)
        out = F.when(event.isNull(), state["out"]).otherwise(F.concat(state["out"], F.array(event)))
        return F.struct((done | F.coalesce(event == "complete", F.lit(False))).alias("done"), after.alias("held"), out.alias("out"))

    folded = grouped.select("asset_id", "timestamp", F.aggregate("_readings", start, step).alias("_s"))
    rest = F.when(~F.col("_s.done") & (F.size("_s.held") > 0), F.array(F.lit("incomplete_timeout"))).otherwise(F.array().cast("array<string>"))
    return folded.select("asset_id", "timestamp", F.posexplode(F.concat("_s.out", rest)).alias("place", "status"))


def transitions_of(results: DataFrame) -> DataFrame:
    """Alert transitions of a result stream with ids that survive replays."""
    from sensorloom.functions.fault_rules import TRANSITIONS

    kind = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in TRANSITIONS.items()])
    identity = F.concat_ws(
        "|", F.lit("fault_alert_transition.v1"), "asset_id", F.unix_micros("timestamp").cast("string"), kind, "fault_class"
    )
    return results.filter(F.col("event_type").isNotNull()).select(
        name_uuid(RESULT_NAMESPACE, identity).alias("event_id"), "asset_id", F.col("timestamp").alias("observed_at"),
        kind.alias("transition_type"), "from_state", "to_state", "fault_class", "maximum_score",
    )


def quality_events(decoded: DataFrame | None, results: DataFrame) -> DataFrame:
    """Malformed input and rejected samples as data-quality rows of four kinds, with ids that survive replays.

    ``decoded`` are decoded events with their ``reject_reason``; late, conflicting and incomplete come from the session.
    """
    rows = results.filter(F.col("kind") == "quality").select("asset_id", "timestamp", "reason", "detail", "event_id")
    if decoded is not None:
        bad = decoded.filter(F.col("reject_reason").isNotNull())
        rows = rows.unionByName(
            bad.select(
                "asset_id", F.lit(None).cast("timestamp").alias("timestamp"), F.lit("malformed").alias("reason"),
                F.col("reject_reason").alias("detail"), "event_id",
            )
        )
    text = lambda c: F.coalesce(c, F.lit(""))
    identity = F.concat_ws(
        "|", F.lit("telemetry_data_quality.v1"), text(F.col("asset_id")), text(F.unix_micros("timestamp").cast("string")), "reason", text(F.col("detail")),
        text(F.col("event_id")),
    )
    return rows.select(name_uuid(RESULT_NAMESPACE, identity).alias("quality_id"), "asset_id", "timestamp", "reason", "detail", F.col("event_id").alias("source_event_id"))


def start_available(df: DataFrame, handle, checkpoint: str):
    """Run a stream over everything available; ``handle(batch, batch_id)`` gets each micro-batch."""
    return df.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(handle).start()


def fan_out(path: str):
    """Micro-batch handler writing results, transitions and quality rows to three tables.

    Each batch overwrites its own ``batch_id`` partition, so a replayed batch leaves no
    duplicates behind. The rows are written once, apart by kind, and not held in memory: transitions and quality rows are
    made from what was written, and the result rows become a part of their table by moving their folder.
    """
    from sensorloom.streaming import tables

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, staged = batch.sparkSession, f"{path}/staged/batch_id={batch_id}"
        spark.conf.set("spark.sql.maxConcurrentOutputFileWriters", "2")  # a file of each kind is open at a time, so that rows need not be sorted
        batch.withColumn("sink", F.col("kind")).write.mode("overwrite").partitionBy("sink").parquet(staged)
        rows = spark.read.schema(f"{OUTPUT}, sink string").parquet(staged)
        of = lambda kind: rows.filter(F.col("sink") == kind).drop("sink")
        put = lambda df, name: df.write.mode("overwrite").parquet(f"{path}/{name}/batch_id={batch_id}")
        put(transitions_of(of("result")), "transitions")
        put(quality_events(None, of("quality")), "quality")
        if not tables.moved(spark, f"{staged}/sink=result", f"{path}/results/batch_id={batch_id}"):
            put(of("result"), "results")
        tables.removed(spark, staged)

    return write


def late_rows(rows: DataFrame, keys: Sequence[str], arrival: Sequence[str], chunk, time: str) -> DataFrame:
    """Batch form of the strictly-increasing-time rule: ``late`` when time does not exceed all earlier arrivals."""
    from sensorloom.operators import series

    numbered = series.with_position(rows, keys, list(arrival), chunk, name="_arrival")
    seen = series.running_max(numbered, keys, F.col(time), "_seen", pos="_arrival")
    return seen.withColumn("late", F.coalesce(F.col(time) <= F.col("_seen"), F.lit(False))).drop("_arrival", "_seen")
