"""Hysteresis alerting over scored series, and the metrics built on its events."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.functions import hysteresis as hy
from sensorloom.lineage import cut_lineage
from sensorloom.operators import series

FOLD_BLOCK_ROWS = 1_000_000
FOLDED = (
    ("policy_id", pa.int32()), ("pos", pa.int64()), ("elapsed", pa.float64()), ("kind", pa.string()), ("from_state", pa.string()),
    ("to_state", pa.string()), ("fault_class", pa.string()), ("rows", pa.int64()), ("valid_rows", pa.int64()), ("alarmed_rows", pa.int64()),
)

# Search grid and acceptance limits.
ENTRY_PROBABILITIES = (0.40, 0.50, 0.60, 0.70)
ENTRY_PERSISTENCE = (2, 3, 4)
EXIT_PROBABILITIES = (0.50, 0.60, 0.70)
EXIT_PERSISTENCE = (2, 3)
ROBUST_ENTRY_PROBABILITIES = (0.50, 0.55, 0.60, 0.65, 0.70)
ROBUST_ENTRY_PERSISTENCE = (3, 4, 5)
ROBUST_EXIT_PROBABILITIES = (0.45, 0.50, 0.55, 0.60)
ROBUST_EXIT_PERSISTENCE = (2, 3)
MAX_MISSED_CORRECT = 1
MAX_MISSED_ANY = 0
LATENCY_TOLERANCE_SECONDS = 30.0
ROW_SEQUENCE_PERSISTENCE = 3
LATENCY_LIMITS = (30, 60, 120, 240)


def robust_grid() -> list[hy.Policy]:
    """Candidates of the robust search."""
    return policy_grid(ROBUST_ENTRY_PROBABILITIES, ROBUST_ENTRY_PERSISTENCE, ROBUST_EXIT_PROBABILITIES, ROBUST_EXIT_PERSISTENCE)


def policy_grid(
    entry_p=ENTRY_PROBABILITIES, entry_n=ENTRY_PERSISTENCE, exit_p=EXIT_PROBABILITIES, exit_n=EXIT_PERSISTENCE
) -> list[hy.Policy]:
    return [hy.Policy(a, b, c, d) for a in entry_p for b in entry_n for c in exit_p for d in exit_n]


def argmax_class(classes: Sequence[str], prefix: str = "p_") -> Column:
    """Class of the first maximum probability in class order."""
    scores = F.array(*[F.col(prefix + c) for c in classes])
    return F.element_at(F.array(*[F.lit(c) for c in classes]), F.array_position(scores, F.array_max(scores)).cast("int"))


def _inputs(scores: np.ndarray, valid: np.ndarray, healthy: int, policies):
    """Inputs of the machine, one number per row, for each policy."""
    diagnosis = scores.argmax(axis=1)
    top, calm = scores.max(axis=1), scores[:, healthy]
    fault = diagnosis != healthy
    for policy in policies:
        yield hy.packed(diagnosis, fault & (top >= policy.entry_probability), calm >= policy.exit_probability, valid)


def _flags(column: pa.ChunkedArray) -> np.ndarray:
    """Booleans of a column; null is false."""
    return column.fill_null(False).to_numpy()


def _in_order(table: pa.Table) -> pa.Table:
    return table.take(np.argsort(table["_pos"].to_numpy(), kind="quicksort"))


def _scores(table: pa.Table, names: Sequence[str]) -> np.ndarray:
    """One row of probabilities per row; null is NaN."""
    return np.column_stack([table[n].cast(pa.float64()).to_numpy() for n in names])


@lru_cache(maxsize=1_024)
def _marks(classes: int, healthy: int, policy: hy.Policy) -> tuple[np.ndarray, np.ndarray]:
    """Which states of the machine are not calm, and which (state, input) cause an event."""
    table = hy.table_of(classes, healthy, policy)
    eventful = np.zeros((len(table.states), 8 * classes), dtype=bool)
    for state, symbol in table.events:
        eventful[state, symbol] = True
    return np.array([m[0] != hy.NONE or m[1] != hy.NONE for m in table.states]), eventful


def _state_names(classes, healthy: int):
    name = lambda c: classes[healthy] if c == hy.NONE else f"confirmed_{classes[c]}"
    return name


def alert_fold(
    scored: DataFrame,
    keys: Sequence[str],
    classes: Sequence[str],
    healthy: str,
    policies: Sequence[hy.Policy],
    pos: str = "tick",
    elapsed: str = "elapsed",
    valid: Column | None = None,
    healthy_part: Column | None = None,
    row_states: bool = False,
    prefix: str = "p_",
    block_rows: int | None = None,
) -> DataFrame:
    """Run every policy over every series in one shuffle.

    Output rows are events (``kind`` new_alert / class_change / cleared) and, per block and
    policy, one ``segment`` row with the number of rows, valid rows and non-healthy valid
    rows in the part flagged by ``healthy_part`` plus its last ``elapsed``. With
    ``row_states`` one ``state`` row per input row is added instead of segments.

    Series are cut into blocks. Only series longer than one block need their start
    machines: each of their blocks is summarised as a start→end table of the few
    possible machines, and the tables are chained per series.
    """
    keys, classes, policies = list(keys), list(classes), list(policies)
    block_rows = block_rows or FOLD_BLOCK_ROWS
    calm = classes.index(healthy)
    columns = [
        *keys,
        F.col(pos).cast("long").alias("_pos"),
        F.col(elapsed).cast("double").alias("_elapsed"),
        *[F.col(prefix + c) for c in classes],
        (valid if valid is not None else F.lit(True)).alias("_valid"),
        (healthy_part if healthy_part is not None else F.lit(True)).alias("_part"),
    ]
    blocked = series.in_blocks(scored.select(*columns), "_pos", rows=block_rows).drop("_halo")
    key_schema = ", ".join(f"{k} {blocked.schema[k].dataType.simpleString()}" for k in keys)

    def transfer(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pos")
        out = []
        scores = pdf[[prefix + c for c in classes]].to_numpy(dtype=float)
        for index, symbols in enumerate(_inputs(scores, pdf["_valid"].to_numpy(dtype=bool), calm, policies)):
            table = hy.transfer(symbols.tolist(), hy.table_of(len(classes), calm, policies[index]))
            out.append((index, json.dumps({hy.encode(a): hy.encode(b) for a, b in table.items()})))
        head = pdf.iloc[0]
        frame = pd.DataFrame(out, columns=["policy_id", "table"])
        for k in [*keys, "_block"]:
            frame[k] = head[k]
        return frame[[*keys, "_block", "policy_id", "table"]]

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        starts: dict[int, dict] = {}
        for index, part in pdf.groupby("policy_id"):
            machine = hy.encode(hy.START)
            for block, table in part.sort_values("_block")[["_block", "table"]].itertuples(index=False):
                machine = json.loads(table)[machine]
                starts.setdefault(int(block) + 1, {})[str(index)] = machine
        head = pdf.iloc[0]
        frame = pd.DataFrame({"_block": list(starts), "_starts": [json.dumps(s) for s in starts.values()]})
        for k in keys:
            frame[k] = head[k]
        return frame[[*keys, "_block", "_starts"]]

    def fold(rows: pa.Table) -> pa.Table:
        rows = _in_order(rows)
        given = json.loads(rows["_starts"][0].as_py() or "{}")
        positions, times = rows["_pos"].to_numpy(), rows["_elapsed"].to_numpy()
        part, usable = _flags(rows["_part"]), _flags(rows["_valid"])
        name = _state_names(classes, calm)
        out = []
        for index, symbols in enumerate(_inputs(_scores(rows, [prefix + c for c in classes]), usable, calm, policies)):
            table = hy.table_of(len(classes), calm, policies[index])
            busy, eventful = _marks(len(classes), calm, policies[index])
            visited = np.array(table.run(symbols.tolist(), hy.decode(given.get(str(index)))))
            before, after = visited[:-1], visited[1:]
            alarmed = usable & busy[after]
            for i in np.flatnonzero(eventful[before, symbols]).tolist():
                kind, left, entered = table.events[before[i], symbols[i]]
                fault = classes[entered if entered != hy.NONE else left]
                out.append((index, int(positions[i]), float(times[i]), kind, name(left), name(entered), fault, 0, 0, 0))
            if row_states:
                label = lambda m: name(m[0]) if m[0] != hy.NONE or m[1] == hy.NONE else f"pending_{classes[m[1]]}"
                labels = [label(m) for m in table.states]
                for i, state in enumerate(after.tolist()):
                    text = labels[state] if usable[i] else "insufficient_data"
                    out.append((index, int(positions[i]), float(times[i]), "state", None, text, None, 0, 0, 0))
            if not row_states and part.any():
                last = float(times[part].max())
                counts = (int(part.sum()), int((part & usable).sum()), int((part & alarmed).sum()))
                out.append((index, int(positions[0]), last, "segment", None, None, None, *counts))
        heads = [rows[k].slice(0, 1).combine_chunks().take(np.zeros(len(out), np.int64)) for k in [*keys, "_block"]]
        made = [pa.array(column, kind, from_pandas=True) for column, (_, kind) in zip(zip(*out) if out else [()] * len(FOLDED), FOLDED)]
        return pa.Table.from_arrays([*heads, *made], names=[*keys, "_block", *[n for n, _ in FOLDED]])

    long = scored.filter(F.col(pos) > block_rows).select(*keys).distinct()
    several = blocked.join(long, keys, "left_semi")
    tables = several.groupBy(*keys, "_block").applyInPandas(
        transfer, f"{key_schema}, _block long, policy_id int, table string"
    )
    starts = tables.groupBy(*keys).applyInPandas(chain, f"{key_schema}, _block long, _starts string")
    ready = blocked.join(starts, [*keys, "_block"], "left")
    schema = (
        f"{key_schema}, _block long, policy_id int, pos long, elapsed double, kind string, from_state string, to_state string, "
        "fault_class string, rows long, valid_rows long, alarmed_rows long"
    )
    return ready.groupBy(*keys, "_block").applyInArrow(fold, schema)


def events_of(folded: DataFrame) -> DataFrame:
    return folded.filter(F.col("kind").isin("new_alert", "class_change", "cleared")).select(
        *[c for c in folded.columns if c not in ("rows", "valid_rows", "alarmed_rows")]
    ).withColumnRenamed("kind", "event_type")


def segments_of(folded: DataFrame, keys: Sequence[str], cadence: float = 10.0) -> DataFrame:
    """Healthy-part totals and end time per (series, policy)."""
    return folded.filter(F.col("kind") == "segment").groupBy(*keys, "policy_id").agg(
        F.sum("rows").alias("rows"),
        F.sum("valid_rows").alias("valid_rows"),
        F.sum("alarmed_rows").alias("alarmed_rows"),
        (F.max("elapsed") + F.lit(cadence)).alias("segment_end"),
    )


def episodes(events: DataFrame, segments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Open-alert intervals: an alert opens, a class change closes and reopens, the tail is censored.

    ``events`` must already be limited to the evaluated part of each series.
    """
    keys = [*keys, "policy_id"]
    numbered = series.with_position(events, keys, ["pos"], F.col("_block"), name="_n").drop("_block")
    cut = series.in_blocks(numbered, "_n", ahead=1)
    window = series.block_window(keys, "_n")
    following = series.drop_halo(
        cut.withColumns({"_next": F.lead("elapsed").over(window), "_next_type": F.lead("event_type").over(window)})
    )
    opened = following.filter(F.col("event_type") != "cleared")
    return opened.join(segments.select(*keys, "segment_end"), keys, "inner").select(
        *keys,
        "fault_class",
        F.col("elapsed").alias("start"),
        F.coalesce("_next", "segment_end").alias("end"),
        F.col("_next").isNull().alias("censored"),
    )


def false_alert_summary(
    episodes_: DataFrame, segments: DataFrame, gap_aware: bool = False, cadence: float = 10.0, by: Sequence[str] = ("policy_id",)
) -> DataFrame:
    """Episodes, alarmed rows, healthy hours, rate per hour, durations and affected runs per policy."""
    hours = F.sum("valid_rows" if gap_aware else "rows") * F.lit(cadence) / F.lit(3600.0)
    base = segments.groupBy(*by).agg(
        F.sum("alarmed_rows").alias("false_anomalous_row_count"),
        hours.alias("healthy_hours"),
        F.count(F.lit(1)).alias("segments"),
    )
    duration = F.col("end") - F.col("start")
    found = episodes_.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_episodes"),
        F.avg(duration).alias("_mean"),
        F.max(duration).alias("_max"),
        F.count_distinct("run_id").alias("_runs"),
    )
    zero = lambda c, v=0: F.coalesce(F.col(c), F.lit(v))
    out = base.join(found, list(by), "left")
    return out.select(
        *by,
        zero("_episodes").alias("false_confirmed_event_count"),
        "false_anomalous_row_count",
        "healthy_hours",
        F.when(F.col("healthy_hours") > 0, zero("_episodes") / F.col("healthy_hours")).otherwise(0.0).alias("events_per_healthy_hour"),
        zero("_mean", 0.0).alias("mean_duration"),
        zero("_max", 0.0).alias("max_duration"),
        zero("_runs").alias("healthy_runs_with_alert"),
        "segments",
    )


def run_detection(events: DataFrame, runs: DataFrame, policies: int = 1) -> DataFrame:
    """Detection of each fault run per policy: any/correct latency, wrong class first, state at onset.

    ``runs`` holds the evaluated fault runs (run_id, fault_class, fault_start).
    """
    wanted = runs.select("run_id", F.col("fault_class").alias("true_class"), "fault_start").withColumn(
        "policy_id", F.explode(F.array(*[F.lit(i) for i in range(policies)]))
    )
    joined = wanted.join(
        events.select("run_id", "policy_id", "pos", "elapsed", "event_type", "fault_class"), ["run_id", "policy_id"], "left"
    )
    after = (F.col("elapsed") >= F.col("fault_start")) & F.col("event_type").isin("new_alert", "class_change")
    before = F.col("elapsed") < F.col("fault_start")
    right = after & (F.col("fault_class") == F.col("true_class"))
    alarm = F.when(F.col("event_type") != "cleared", F.col("fault_class"))
    grouped = joined.groupBy("run_id", "policy_id", "true_class", "fault_start").agg(
        F.min(F.when(after, F.col("elapsed"))).alias("_any"),
        F.min_by("fault_class", F.when(after, F.col("pos"))).alias("first_class"),
        F.min(F.when(right, F.col("elapsed"))).alias("_right"),
        F.max_by(F.struct(alarm.alias("c")), F.when(before, F.col("pos"))).alias("_onset"),
    )
    wrong_first = F.col("_any").isNotNull() & (F.col("first_class") != F.col("true_class")) & (
        F.col("_right").isNull() | (F.col("_any") < F.col("_right"))
    )
    return grouped.select(
        "run_id",
        "policy_id",
        F.col("true_class").alias("fault_class"),
        F.col("_right").isNotNull().alias("correct_class_detected"),
        (F.col("_right") - F.col("fault_start")).alias("correct_class_latency"),
        F.col("_any").isNotNull().alias("any_fault_detected"),
        (F.col("_any") - F.col("fault_start")).alias("any_fault_latency"),
        "first_class",
        F.coalesce(wrong_first, F.lit(False)).alias("wrong_class_first"),
        F.col("_onset.c").isNotNull().alias("confirmed_at_onset"),
        F.col("_onset.c").alias("class_at_onset"),
    )


def detection_summary(detected: DataFrame, by: Sequence[str] = ("policy_id",), limits: Sequence[int] = LATENCY_LIMITS) -> DataFrame:
    """Missed runs, median latency and the share of all fault runs detected within each limit."""
    latency = F.col("correct_class_latency")
    within = [
        F.avg(F.coalesce(latency <= t, F.lit(False)).cast("double")).alias(f"within_{t}s") for t in limits
    ]
    base = detected.groupBy(*by).agg(
        F.count(F.lit(1)).alias("fault_runs"),
        F.count_if(~F.col("correct_class_detected")).alias("correct_class_missed"),
        F.count_if(~F.col("any_fault_detected")).alias("any_fault_missed"),
        F.count_if(F.col("wrong_class_first")).alias("wrong_class_runs"),
        *within,
    )
    return base.join(series.exact_median(detected, list(by), "correct_class_latency", "median_latency"), list(by), "left")


def missed_fraction_by_class(detected: DataFrame, by: Sequence[str] = ("fault_class",)) -> DataFrame:
    return detected.groupBy(*by).agg(
        F.count(F.lit(1)).alias("runs"),
        F.avg((~F.col("any_fault_detected")).cast("double")).alias("any_missed_fraction"),
        F.avg((~F.col("correct_class_detected")).cast("double")).alias("correct_missed_fraction"),
    )


def repeated_label(label: str, n: int):
    """Window column: the last ``n`` rows (this one included) carry the same label."""

    def make(w):
        frame = w.rowsBetween(-(n - 1), 0)
        same = (F.min(label).over(frame) == F.max(label).over(frame)) & (F.count(label).over(frame) == n)
        return F.coalesce(same, F.lit(False))

    return make


def first_qualifying_detection(rows: DataFrame, n: int, label: str = "predicted", pos: str = "tick") -> DataFrame:
    """First time the run's own class is predicted ``n`` times in a row at or after fault start.

    ``rows`` carry run_id, fault_class, fault_start, ``label`` and elapsed.
    """
    windows = {
        "_same": repeated_label(label, n),
        "_oldest": lambda w: F.lag("elapsed", n - 1).over(w) if n > 1 else F.col("elapsed"),
    }
    checked = series.lagged(rows, ["run_id"], windows, pos, halo=max(1, n - 1))
    hit = F.col("_same") & (F.col(label) == F.col("fault_class")) & (F.col("_oldest") >= F.col("fault_start"))
    return checked.groupBy("run_id", "fault_class", "fault_start").agg(F.min(F.when(hit, F.col("elapsed"))).alias("_t")).select(
        "run_id",
        "fault_class",
        F.col("_t").isNotNull().alias("detected"),
        (F.col("_t") - F.col("fault_start")).alias("latency"),
    )


def false_alarm_events(rows: DataFrame, n: int, healthy: str, label: str = "predicted", pos: str = "tick") -> DataFrame:
    """Stretches of one non-healthy label that reach ``n`` rows, counted once each, per run."""
    windows = {"_same": repeated_label(label, n), "_older": lambda w: F.lag(label, n).over(w)}
    checked = series.lagged(rows, ["run_id"], windows, pos, halo=n)
    reached = F.col("_same") & ~F.col("_older").eqNullSafe(F.col(label)) & ~F.col(label).isin(healthy, "uncertain")
    return checked.groupBy("run_id").agg(F.count_if(reached).alias("false_alarm_events"), F.count(F.lit(1)).alias("rows"))


def row_sequence_episodes(
    rows: DataFrame, n: int, healthy: str, label: str = "predicted", pos: str = "tick", cadence: float = 10.0
) -> DataFrame:
    """Stretches of one non-healthy predicted label; ``qualifies`` from ``n`` rows on."""
    marked = series.islands(rows, ["run_id"], [label], pos)
    return (
        marked.filter(F.col(label) != healthy)
        .groupBy("run_id", "island", label)
        .agg(
            F.min("elapsed").alias("start"),
            (F.max("elapsed") + F.lit(cadence)).alias("end"),
            F.count(F.lit(1)).alias("rows"),
        )
        .withColumn("qualifies", F.col("rows") >= n)
    )


def row_sequence_false_alerts(rows: DataFrame, n: int, healthy: str, label: str = "predicted", cadence: float = 10.0) -> DataFrame:
    """Baseline false-alert figures of raw predictions over the healthy parts."""
    found = row_sequence_episodes(rows, n, healthy, label, cadence=cadence)
    duration = F.when(F.col("qualifies"), F.col("end") - F.col("start"))
    figures = found.agg(
        F.count(F.lit(1)).alias("episodes"),
        F.count_if("qualifies").alias("false_confirmed_event_count"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("false_anomalous_row_count"),
        F.coalesce(F.avg(duration), F.lit(0.0)).alias("mean_duration"),
        F.coalesce(F.max(duration), F.lit(0.0)).alias("max_duration"),
        F.count_distinct(F.when(F.col("qualifies"), F.col("run_id"))).alias("healthy_runs_with_alert"),
    )
    hours = rows.agg((F.count(F.lit(1)) * F.lit(cadence) / F.lit(3600.0)).alias("healthy_hours"))
    both = figures.crossJoin(hours)  # one row each
    return both.withColumn(
        "events_per_healthy_hour",
        F.when(F.col("healthy_hours") > 0, F.col("false_confirmed_event_count") / F.col("healthy_hours")).otherwise(0.0),
    )


def longest_streak(rejected: DataFrame, keys: Sequence[str], elapsed: str = "elapsed", cadence: float = 10.0, pos_chunk: Column | None = None) -> DataFrame:
    """Longest run of rejected rows exactly ``cadence`` apart, per series.

    Consecutive rows share ``elapsed / cadence - position``, so counting per that value
    needs no ordered scan of a series.
    """
    chunk = pos_chunk if pos_chunk is not None else F.floor(F.col(elapsed) / F.lit(cadence * 1_000_000))
    numbered = series.with_position(rejected, keys, [elapsed], chunk, name="_n")
    anchor = F.round(F.col(elapsed) / F.lit(cadence) - F.col("_n"), 6)
    return (
        numbered.groupBy(*keys, anchor.alias("_anchor"))
        .agg(F.count(F.lit(1)).alias("_rows"))
        .groupBy(*keys)
        .agg(F.max("_rows").alias("longest_streak"))
    )


def policy_table(spark, policies: Sequence[hy.Policy]) -> DataFrame:
    rows = [(i, p.entry_probability, p.entry_persistence, p.exit_probability, p.exit_persistence) for i, p in enumerate(policies)]
    schema = "policy_id int, entry_probability double, entry_persistence int, exit_probability double, exit_persistence int"
    return spark.createDataFrame(rows, schema)


def search_policies(
    folded: DataFrame, runs: DataFrame, policies: Sequence[hy.Policy], baseline_latency: DataFrame | None = None,
    gap_aware: bool = False, check_any_fault: bool = False,
) -> DataFrame:
    """One row per candidate with its figures and rejection; ``chosen`` marks the selected one.

    Rejection: too many missed runs, or a median latency more than the tolerance above the
    baseline. Survivors are ordered by false-alert rate, affected runs, mean duration,
    median latency and total persistence; grid order breaks ties.
    """
    keys = ["run_id"]
    folded = cut_lineage(folded)  # only events and totals, read by several aggregations
    events, segments = events_of(folded), segments_of(folded, keys)
    fault_runs = runs.filter(F.col("fault_start").isNotNull())
    seen = folded.select("run_id").distinct()
    detected = run_detection(events, fault_runs.join(seen, "run_id", "left_semi"), len(policies))
    healthy_events = events.join(runs.select("run_id", "fault_start"), "run_id").filter(
        F.col("fault_start").isNull() | (F.col("elapsed") < F.col("fault_start"))
    ).drop("fault_start")
    figures = false_alert_summary(episodes(healthy_events, segments, keys), segments, gap_aware)
    out = detection_summary(detected).join(figures, "policy_id").join(F.broadcast(policy_table(folded.sparkSession, policies)), "policy_id")
    if baseline_latency is not None:
        out = out.crossJoin(baseline_latency.select(F.col("median_latency").alias("baseline_latency")))  # one row
    else:
        out = out.withColumn("baseline_latency", F.lit(None).cast("double"))
    reason = (
        F.when(F.lit(check_any_fault) & (F.col("any_fault_missed") > MAX_MISSED_ANY), "any_fault_missed")
        .when(F.col("correct_class_missed") > MAX_MISSED_CORRECT, "correct_class_missed")
        .when(F.col("median_latency") > F.col("baseline_latency") + LATENCY_TOLERANCE_SECONDS, "latency")
    )
    out = out.withColumn("rejection", reason)
    # the grid is a fixed, small table, so one ordering of it is one row per candidate
    order = Window.orderBy(
        F.col("rejection").isNotNull(),
        F.round("events_per_healthy_hour", 9),
        "healthy_runs_with_alert",
        F.round("mean_duration", 9),
        F.asc_nulls_last("median_latency"),
        F.col("entry_persistence") + F.col("exit_persistence"),
        "policy_id",
    )
    return out.withColumn("_rank", F.row_number().over(order)).withColumn(
        "chosen", (F.col("_rank") == 1) & F.col("rejection").isNull()
    ).drop("_rank")
