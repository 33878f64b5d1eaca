"""Windowed features with explicit rejection, labels and ground truth for wide samples."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.functions.linear import frame_aggregates
from sensorloom.functions.scalar import derive_label, safe_divide
from sensorloom.operators import series

# Cadence, frames and statistics of the feature set.
CADENCE_SECONDS = 10.0
FRAMES = (3, 6, 12)
STATS = ("mean", "std", "min", "max", "slope", "delta")
WARMUP = max(FRAMES)

# Columns that must never reach a model.
FORBIDDEN = frozenset(
    (
        "dataset_id", "simulation_run_id", "observation_id", "class_label", "scenario_name", "seed",
        "run_start_time", "fault_start_sim_seconds", "fault_duration_sim_seconds", "fault_severity",
        "sensor_corruption_type", "fault_type", "fault_active", "seconds_since_fault_start",
        "target_asset_id", "split", "status", "error_message", "sensor_noise_json", "observation_count",
        "ground_truth_row_count", "sample_count", "timestamp", "elapsed_sim_seconds", "asset_id",
    )
)


@dataclass(frozen=True)
class Ratio:
    """``numerator / denominator``; rows with |denominator| below ``floor`` are rejected."""

    name: str
    numerator: str
    denominator: str
    floor: float


@dataclass(frozen=True)
class Residual:
    """``observed - (intercept + coefficient * driver / rated)``."""

    name: str
    observed: str
    driver: str
    intercept: float
    coefficient: float
    rated: float


@dataclass(frozen=True)
class FeatureSpec:
    signals: tuple[str, ...]
    ratios: tuple[Ratio, ...] = ()
    residuals: tuple[Residual, ...] = ()
    frames: tuple[int, ...] = field(default=FRAMES)
    cadence: float = CADENCE_SECONDS

    def windowed(self, signal: str) -> list[str]:
        return [f"{signal}__{s}_{int(k * self.cadence)}s" for k in self.frames for s in STATS]

    def steps(self, signal: str) -> list[str]:
        return [f"{signal}__diff_{int(self.cadence)}s", f"{signal}__roc_per_s"]


# Fuel-cell signals, ratio floors and healthy reference lines over current / 200 A.
FUEL_CELL = FeatureSpec(
    signals=("stack_temperature", "stack_pressure", "current", "voltage", "fuel_flow", "power_output", "coolant_flow"),
    ratios=(
        Ratio("voltage_per_current", "voltage", "current", 1.0),
        Ratio("power_per_fuel_flow", "power_output", "fuel_flow", 0.1),
    ),
    residuals=(
        Residual("voltage__healthy_residual", "voltage", "current", 0.78, -0.06, 200.0),
        Residual("fuel_flow__healthy_residual", "fuel_flow", "current", 1.5, 1.0, 200.0),
        Residual("stack_temperature__healthy_residual", "stack_temperature", "current", 54.5, 20.0, 200.0),
        Residual("coolant_flow__healthy_residual", "coolant_flow", "current", 8.0, 18.0, 200.0),
    ),
)


def feature_columns(spec: FeatureSpec, group: str = "D") -> list[str]:
    """Groups: A raw, B + steps and windows, C + ratios, D + residuals, in a fixed order."""
    raw = list(spec.signals)
    if group == "A":
        return raw
    out = []
    for signal in spec.signals:
        out += [signal, *spec.steps(signal), *spec.windowed(signal)]
    if group in ("C", "D"):
        out += [r.name for r in spec.ratios]
    if group == "D":
        out += [r.name for r in spec.residuals]
    return out


def feature_group(spec: FeatureSpec, name: Column) -> Column:
    return (
        F.when(name.isin([r.name for r in spec.residuals] or [""]), "residual")
        .when(name.isin([r.name for r in spec.ratios] or [""]), "cross_signal")
        .when(name.isin(list(spec.signals)), "raw")
        .otherwise("temporal")
    )


def assert_no_forbidden(columns: Sequence[str]) -> None:
    found = sorted(FORBIDDEN & set(columns))
    if found:
        raise ValueError(f"forbidden feature columns: {found}")


def step_columns(spec: FeatureSpec):
    """Difference to the previous sample and rate per second."""
    make = {}
    for signal in spec.signals:
        diff, rate = spec.steps(signal)
        make[diff] = lambda w, s=signal: F.col(s) - F.lag(s).over(w)
        make[rate] = lambda w, s=signal: (F.col(s) - F.lag(s).over(w)) / F.lit(spec.cadence)
    return make


def window_columns(spec: FeatureSpec, elapsed: str = "elapsed"):
    """Trailing statistics over frames that end at the current row."""
    make = {}
    for signal in spec.signals:
        for k in spec.frames:
            mean, std, low, high, slope, delta = (f"{signal}__{s}_{int(k * spec.cadence)}s" for s in STATS)
            frame = lambda w, k=k: w.rowsBetween(-(k - 1), 0)
            make[mean] = lambda w, s=signal, f=frame: F.avg(s).over(f(w))
            make[std] = lambda w, s=signal, f=frame: F.stddev_pop(s).over(f(w))
            make[low] = lambda w, s=signal, f=frame: F.min(s).over(f(w))
            make[high] = lambda w, s=signal, f=frame: F.max(s).over(f(w))
            make[slope] = lambda w, s=signal, f=frame: F.regr_slope(F.col(s), F.col(elapsed)).over(f(w))
            make[delta] = lambda w, s=signal, f=frame: F.col(s) - F.first(s).over(f(w))
    return make


class TrailingColumns:
    """Step and window columns of Arrow batches whose rows come block by block in their order; ``_nth`` numbers a block's rows."""

    def __init__(self, spec: FeatureSpec, elapsed: str) -> None:
        self.spec, self.elapsed = spec, elapsed
        self.names = [*(n for s in spec.signals for n in spec.steps(s)), *(n for s in spec.signals for n in spec.windowed(s))]

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [*self.spec.signals, self.elapsed]
        before = max(self.spec.frames) - 1
        held, gone = np.zeros((len(columns), before)), np.ones((len(columns), before), dtype=bool)
        for batch in batches:
            if not batch.num_rows:
                continue
            given = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            held = np.concatenate([held, np.array([g.to_numpy(zero_copy_only=False) for g in given])], axis=1)
            gone = np.concatenate([gone, np.array([g.is_null().to_numpy(zero_copy_only=False) for g in given])], axis=1)
            made = self._made(batch.column(batch.schema.get_field_index("_nth")).to_numpy(), held, gone)
            held, gone = held[:, held.shape[1] - before :], gone[:, gone.shape[1] - before :]
            keep = [i for i, name in enumerate(batch.schema.names) if name not in ("_nth", "_block", "_halo")]
            arrays = [batch.column(i) for i in keep] + [pa.array(v, pa.float64(), mask=none) for v, none in made]
            out = pa.RecordBatch.from_arrays(arrays, [*(batch.schema.names[i] for i in keep), *self.names])
            halo = batch.column(batch.schema.get_field_index("_halo"))
            yield out.filter(pc.invert(halo)) if pc.any(halo).as_py() else out

    def _made(self, nth: np.ndarray, held: np.ndarray, gone: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(values, is null) of every new column."""
        spec, n, end = self.spec, len(nth), held.shape[1]
        lag = lambda a, j: a[..., end - n - j : end - j]
        absent = lambda j: lag(gone, j) | (nth <= j)
        now, none = lag(held, 0)[:-1], lag(gone, 0)[:-1]
        diff, no_diff = now - lag(held, 1)[:-1], none | absent(1)[:-1]
        stats: dict = {"diff": (diff, no_diff), "rate": (diff / spec.cadence, no_diff)}
        for k in spec.frames:
            rows, lost = [lag(held, j) for j in range(k - 1, -1, -1)], [absent(j) for j in range(k - 1, -1, -1)]
            some = np.any(lost, axis=(0, 1))  # rows whose frame is cut off or holds a null
            found = frame_aggregates([r[:-1] for r in rows], [r[-1] for r in rows])
            nulls = {s: np.zeros(now.shape, dtype=bool) for s in found} | {"slope": found["slope_none"]}
            if some.any():
                part = frame_aggregates([r[:-1, some] for r in rows], [r[-1, some] for r in rows], [~x[:-1, some] for x in lost], [~(x[:-1, some] | x[-1, some]) for x in lost])
                for s in STATS[:-1]:
                    found[s][:, some] = part[s]
                    nulls[s][:, some] = part["slope_none" if s == "slope" else "none"]
            start = np.minimum(nth, k) - 1  # how far back the frame's first row lies
            place = np.arange(end - n, end) - start
            found["delta"], nulls["delta"] = now - held[:-1, place], none | gone[:-1, place]
            stats.update({(k, s): (found[s], nulls[s]) for s in STATS})
        orders = [["diff", "rate"], [(k, s) for k in spec.frames for s in STATS]]
        return [(stats[o][0][i], stats[o][1][i]) for order in orders for i in range(len(spec.signals)) for o in order]


def with_windows(
    df: DataFrame, spec: FeatureSpec, keys: Sequence[str], pos: str = "tick", elapsed: str = "elapsed", whole: bool = False
) -> DataFrame:
    """All step and window columns from one sort per (series, block).

    Each column is an expression of its own, so that a reader makes those it takes only. ``whole`` is for readers that take
    all: the columns are made together, as arrays of many rows, by the same updates in the same order (the same bits); the
    signals and ``elapsed`` are doubles then.
    """
    if whole:
        rows = series.in_blocks(df, pos, halo=max(spec.frames) - 1)
        numbered = rows.withColumn("_nth", F.row_number().over(series.block_window(keys, pos)))
        make = TrailingColumns(spec, elapsed)
        return numbered.mapInArrow(make, T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in make.names]]))
    make = {**step_columns(spec), **window_columns(spec, elapsed)}
    return series.lagged(df, keys, make, pos=pos, halo=max(spec.frames) - 1)


def ratio_struct(ratio: Ratio) -> Column:
    return safe_divide(F.col(ratio.numerator), F.col(ratio.denominator), ratio.floor)


def residual_value(residual: Residual) -> Column:
    load = F.col(residual.driver) / F.lit(residual.rated)
    return F.col(residual.observed) - (F.lit(residual.intercept) + load * F.lit(residual.coefficient))


def with_point_features(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Ratios, residuals and the rejection columns of each sample."""
    out = df.withColumns({f"_{r.name}": ratio_struct(r) for r in spec.ratios})
    invalid = [F.when(~F.col(f"_{r.name}.valid"), F.lit(r.name)) for r in spec.ratios]
    reasons = [F.when(~F.col(f"_{r.name}.valid"), F.col(f"_{r.name}.reason")) for r in spec.ratios]
    denominators = sorted({r.denominator for r in spec.ratios})
    diagnostics = F.to_json(
        F.struct(
            *[
                F.when(
                    sum((F.when(~F.col(f"_{r.name}.valid"), 1).otherwise(0) for r in spec.ratios if r.denominator == d), F.lit(0)) > 0,
                    F.col(d),
                ).alias(d)
                for d in denominators
            ]
        )
    )
    empty = F.array().cast("array<string>")
    out = out.withColumns(
        {
            "reason_codes": F.array_compact(F.array(*reasons)) if reasons else empty,
            "invalid_feature_names": F.array_compact(F.array(*invalid)) if invalid else empty,
            "diagnostic_values_json": diagnostics if denominators else F.lit("{}"),
            **{r.name: F.col(f"_{r.name}.value") for r in spec.ratios},
            **{r.name: residual_value(r) for r in spec.residuals},
        }
    )
    return out.withColumn("is_valid", F.size("invalid_feature_names") == 0).drop(*[f"_{r.name}" for r in spec.ratios])


def drop_warmup(df: DataFrame, pos: str = "tick", warmup: int = WARMUP) -> DataFrame:
    return df.filter(F.col(pos) >= warmup)


def build_features(
    df: DataFrame, spec: FeatureSpec, keys: Sequence[str], pos: str = "tick", elapsed: str = "elapsed", keep_warmup: bool = False,
    whole: bool = False,
) -> DataFrame:
    """Every eligible sample with all features; ``is_valid`` splits features from rejections.

    ``keep_warmup`` keeps the samples before the first full window too, without features and with a null ``is_valid``, so that
    features need no join with the samples they come from. ``whole``: see :func:`with_windows`.
    """
    assert_no_forbidden(feature_columns(spec))
    rows = with_point_features(with_windows(df, spec, keys, pos, elapsed, whole), spec)
    if not keep_warmup:
        return drop_warmup(rows, pos, max(spec.frames))
    full = F.col(pos) >= max(spec.frames)
    return rows.withColumns({c: F.when(full, F.col(c)) for c in rows.columns if c not in df.columns})


def ground_truth(samples: DataFrame, runs: DataFrame, key: str = "run_id", elapsed: str = "elapsed") -> DataFrame:
    """Active from fault start to the end of the run; severity ramps over the fault duration.

    ``runs`` needs class_label, fault_start, fault_duration, severity, fault_type and
    corruption; an optional ``target_asset_id`` limits the fault to that asset.
    """
    joined = samples.join(runs, key, "inner")
    target = (
        F.col("asset_id").eqNullSafe(F.col("target_asset_id"))
        if {"asset_id", "target_asset_id"} <= set(joined.columns)
        else F.lit(True)
    )
    active = target & F.coalesce(F.col("fault_duration").isNotNull() & (F.col(elapsed) >= F.col("fault_start")), F.lit(False))
    since = F.when(active, F.col(elapsed) - F.col("fault_start"))
    return joined.withColumns(
        {
            "fault_active": active,
            "seconds_since_fault_start": since,
            "fault_severity": F.when(active, F.col("severity") * F.least(F.lit(1.0), since / F.col("fault_duration"))).otherwise(0.0),
            "fault_type": F.when(target, F.col("fault_type")).otherwise("none"),
            "corruption": F.when(target, F.col("corruption")).otherwise("none"),
        }
    )


def label_rows(truth: DataFrame) -> DataFrame:
    label = derive_label(F.col("fault_active"), F.col("fault_type"), F.col("corruption"))
    return truth.withColumns(
        {
            "class_label": label,
            "is_anomalous": label != "healthy",
            "fault_severity": F.when(F.col("fault_active"), F.col("fault_severity")),
        }
    )


def derived_telemetry(voltage: Column, current: Column, fuel_flow: Column) -> Column:
    """struct(power_kw, efficiency_percent) rounded half to even at four decimals."""
    power = voltage * current / F.lit(1000.0)
    efficiency = F.least(F.lit(100.0), power / F.greatest(fuel_flow * F.lit(0.033), F.lit(1e-6)) * F.lit(100.0))
    return F.struct(F.bround(power, 4).alias("power"), F.bround(efficiency, 4).alias("efficiency"))
