"""Filtered reads, validation and rollups of long telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.functions.scalar import bucket_start, is_finite

# Canonical units; the first seven names are required, efficiency is optional.
CANONICAL_UNITS = {
    "stack_temperature": "celsius",
    "stack_pressure": "kPa",
    "current": "A",
    "voltage": "V",
    "fuel_flow": "SLPM",
    "power_output": "kW",
    "coolant_flow": "L/min",
    "efficiency": "percent",
}
REQUIRED = [name for name in CANONICAL_UNITS if name != "efficiency"]

# Preset -> (seconds, default bucket, raw row limit)
PRESETS = {
    "1h": (3_600, None, 500),
    "24h": (86_400, "1h", 2_000),
    "7d": (604_800, "1h", 5_000),
    "30d": (2_592_000, "1d", 10_000),
}
DEFAULT_HISTORY_LIMIT = 1_000


def in_range(
    obs: DataFrame,
    asset_id: str | None = None,
    start=None,
    end=None,
    measurement_type: str | None = None,
    limit: int | None = None,
    newest_first: bool = False,
) -> DataFrame:
    """Inclusive time range in (timestamp, id) order; ``limit`` applies after ordering."""
    out = obs
    if asset_id is not None:
        out = out.filter(F.col("asset_id") == asset_id)
    if start is not None:
        out = out.filter(F.col("timestamp") >= F.lit(start).cast("timestamp"))
    if end is not None:
        out = out.filter(F.col("timestamp") <= F.lit(end).cast("timestamp"))
    if measurement_type is not None:
        out = out.filter(F.col("measurement_type") == measurement_type)
    order = [F.desc("timestamp"), F.desc("id")] if newest_first else [F.asc("timestamp"), F.asc("id")]
    out = out.orderBy(*order)
    return out.limit(limit) if limit is not None else out


def history_per_asset(obs: DataFrame, limit: int | None = None) -> DataFrame:
    """All rows, or the oldest ``limit`` rows of every asset, across its measurement types."""
    if limit is None:
        return obs
    oldest = Window.partitionBy("asset_id").orderBy("timestamp", "id")
    return obs.withColumn("_rk", F.row_number().over(oldest)).filter(F.col("_rk") <= limit).drop("_rk")


def latest_per_type(obs: DataFrame, k: int) -> DataFrame:
    newest = Window.partitionBy("asset_id", "measurement_type").orderBy(F.desc("timestamp"), F.desc("id"))
    return obs.withColumn("age", F.row_number().over(newest)).filter(F.col("age") <= k)


def bounded_history(obs: DataFrame, limit: int) -> DataFrame:
    """Newest ``limit`` rows per asset, returned oldest first through ``position``."""
    newest = Window.partitionBy("asset_id").orderBy(F.desc("timestamp"), F.desc("id"))
    kept = obs.withColumn("_age", F.row_number().over(newest)).filter(F.col("_age") <= limit)
    return kept.withColumn(
        "position", F.row_number().over(Window.partitionBy("asset_id").orderBy(F.desc("_age")))
    ).drop("_age")


def primary_type(obs: DataFrame) -> DataFrame:
    """Measurement type of each asset's first row by (timestamp, id)."""
    return obs.groupBy("asset_id").agg(F.min_by("measurement_type", F.struct("timestamp", "id")).alias("measurement_type"))


def primary_rows(obs: DataFrame) -> DataFrame:
    return obs.join(primary_type(obs), ["asset_id", "measurement_type"], "left_semi")


def can_reason(obs: DataFrame) -> DataFrame:
    counts = obs.groupBy("asset_id", "measurement_type").agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.struct("timestamp", "id")).alias("_first")
    )
    return counts.groupBy("asset_id").agg(
        ((F.sum("_n") >= 2) & (F.min_by("_n", "_first") >= 2)).alias("can_reason")
    )


def observation_problem() -> Column:
    """Reason why a row is not a valid observation, or null."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    return (
        F.when(F.coalesce(F.col("id") == "", F.lit(True)), "empty_id")
        .when(blank("asset_id"), "empty_asset_id")
        .when(F.col("timestamp").isNull(), "missing_timestamp")
        .when(F.coalesce(F.col("unit") == "", F.lit(True)), "empty_unit")
    )


def validate_samples(readings: DataFrame, sample_key: str = "sample_id") -> DataFrame:
    """First problem of every sample, or null: one asset and time, then per-row checks, then completeness.

    Row checks follow the given ``row_no`` order: unsupported name, duplicate, unit, value.
    """
    known = F.col("measurement_type").isin(*CANONICAL_UNITS)
    expected = F.coalesce(*[F.when(F.col("measurement_type") == n, u) for n, u in CANONICAL_UNITS.items()])
    first_of_type = readings.groupBy(sample_key, "measurement_type").agg(F.min("row_no").alias("_first_no"))
    rows = readings.join(first_of_type, [sample_key, "measurement_type"], "inner")
    problem = (
        F.when(~known, "unsupported_measurement")
        .when(F.col("row_no") > F.col("_first_no"), "duplicate_measurement")
        .when(~F.col("unit").eqNullSafe(expected), "unit_mismatch")
        .when(~is_finite(F.col("value")), "non_finite_value")
    )
    graded = rows.withColumn("_problem", problem)
    present = [F.max((F.col("measurement_type") == n).cast("int")) for n in REQUIRED]
    grouped = graded.groupBy(sample_key).agg(
        F.min("asset_id").alias("_a0"),
        F.max("asset_id").alias("_a1"),
        F.min("timestamp").alias("_t0"),
        F.max("timestamp").alias("_t1"),
        F.min_by("_problem", F.when(F.col("_problem").isNotNull(), F.col("row_no"))).alias("_row_problem"),
        sum(present[1:], present[0]).alias("_present"),
        F.count(F.lit(1)).alias("readings"),
    )
    reason = (
        F.when(F.col("_a0") != F.col("_a1"), "multiple_assets")
        .when(F.col("_t0") != F.col("_t1"), "multiple_timestamps")
        .when(F.col("_row_problem").isNotNull(), F.col("_row_problem"))
        .when(F.col("_present") < len(REQUIRED), "missing_measurement")
    )
    return grouped.select(sample_key, "readings", reason.alias("reason"))


def rollup(obs: DataFrame, bucket: str) -> DataFrame:
    """avg/min/max/count and the last unit per (bucket, asset, type)."""
    return obs.groupBy(bucket_start(F.col("timestamp"), bucket).alias("bucket"), "asset_id", "measurement_type").agg(
        F.avg("value").alias("avg_value"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
        F.count(F.lit(1)).alias("sample_count"),
        F.max_by("unit", F.struct("timestamp", "id")).alias("unit"),
    )


def read_rollup(rolled: DataFrame, asset_id: str | None = None, start=None, end=None, measurement_type: str | None = None) -> DataFrame:
    """Filter a rollup on its bucket bounds (inclusive), ordered by bucket and type."""
    out = rolled
    if asset_id is not None:
        out = out.filter(F.col("asset_id") == asset_id)
    if start is not None:
        out = out.filter(F.col("bucket") >= F.lit(start).cast("timestamp"))
    if end is not None:
        out = out.filter(F.col("bucket") <= F.lit(end).cast("timestamp"))
    if measurement_type is not None:
        out = out.filter(F.col("measurement_type") == measurement_type)
    return out.orderBy("bucket", "measurement_type")


def resolve_bucket(bucket: str | None, seconds: float | None) -> str:
    """Explicit bucket, else daily for windows longer than seven days, else hourly."""
    if bucket is not None:
        return bucket
    return "1d" if seconds is not None and seconds > 604_800 else "1h"


def preset_window(obs: DataFrame, preset: str, now: Column, limit: int | None = None) -> DataFrame:
    """Raw rows of a preset range ending at ``now``; a caller may pass a row limit per asset, as ``preset_limit`` gives it."""
    seconds = PRESETS[preset][0]
    start = F.timestamp_micros(F.unix_micros(now) - F.lit(seconds * 1_000_000))
    return history_per_asset(obs.filter((F.col("timestamp") >= start) & (F.col("timestamp") <= now)), limit)


def preset_limit(preset: str) -> int:
    return PRESETS[preset][2]


def build_series(obs: DataFrame, limit: int | None = None) -> DataFrame:
    """Ordered samples and last unit per (asset, type) over the asset's history, or its oldest ``limit`` rows."""
    sample = F.struct("timestamp", "id", "value")
    grouped = history_per_asset(obs, limit).groupBy("asset_id", "measurement_type").agg(
        F.array_sort(F.collect_list(sample)).alias("_s"), F.max_by("unit", F.struct("timestamp", "id")).alias("unit")
    )
    return grouped.select(
        "asset_id",
        "measurement_type",
        "unit",
        F.transform("_s", lambda s: F.struct(s["timestamp"].alias("timestamp"), s["value"].alias("value"))).alias("samples"),
    )


CONTEXT_LENGTH = 24
MAX_HORIZON = 12
MIN_FEATURE_STD = 1e-6


def forecast_context(points: DataFrame, context: int = CONTEXT_LENGTH) -> DataFrame:
    """Newest ``context`` bucket averages per (asset, type), left-padded with the oldest one."""
    newest = Window.partitionBy("asset_id", "measurement_type").orderBy(F.desc("bucket"))
    kept = points.withColumn("_age", F.row_number().over(newest)).filter(F.col("_age") <= context)
    grouped = kept.groupBy("asset_id", "measurement_type").agg(
        F.array_sort(F.collect_list(F.struct("bucket", "avg_value", "unit"))).alias("_p")
    )
    values = F.transform("_p", lambda p: p["avg_value"])
    padding = F.array_repeat(F.element_at(values, 1), F.lit(context) - F.size(values))
    out = grouped.withColumn("window", F.concat(padding, values))
    mean = F.aggregate("window", F.lit(0.0), lambda a, v: a + v) / F.lit(float(context))
    out = out.withColumn("mean", mean)
    variance = F.aggregate("window", F.lit(0.0), lambda a, v: a + (v - F.col("mean")) * (v - F.col("mean"))) / F.lit(float(context))
    out = out.withColumn("std", F.greatest(F.sqrt(variance), F.lit(MIN_FEATURE_STD)))
    return out.select(
        "asset_id",
        "measurement_type",
        "window",
        "mean",
        "std",
        F.transform("window", lambda v: (v - F.col("mean")) / F.col("std")).alias("features"),
        F.element_at("_p", -1)["bucket"].alias("horizon_start"),
        F.element_at("_p", -1)["unit"].alias("unit"),
    )


def forecast(points: DataFrame, bucket: str = "1h", horizon: int = MAX_HORIZON) -> DataFrame:
    """Drift forecast: last + step * (last - previous), on the z-scored context and scaled back."""
    if not 1 <= horizon <= MAX_HORIZON:
        raise ValueError(f"horizon must be between 1 and {MAX_HORIZON}")
    seconds = {"1h": 3_600, "1d": 86_400}[bucket]
    last, previous = F.element_at("features", -1), F.element_at("features", -2)
    predicted = (last + (last - previous) * F.col("step")) * F.col("std") + F.col("mean")
    return (
        forecast_context(points)
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
        .select(
            "asset_id",
            "measurement_type",
            "unit",
            "step",
            F.timestamp_micros(F.unix_micros("horizon_start") + F.col("step") * F.lit(seconds * 1_000_000)).alias("timestamp"),
            predicted.alias("value"),
        )
    )


def fleet_order(assets: DataFrame, selected: str) -> DataFrame:
    """Alphabetical, the selected asset first; ``rank`` is the display position."""
    pinned = (F.col("asset_id") != selected).cast("int")
    return assets.orderBy(pinned, "asset_id")


def coalesce_requests(requests: DataFrame) -> DataFrame:
    """Pending triggers per asset collapse to one job with the number of absorbed triggers."""
    return requests.groupBy("asset_id").agg(
        (F.count(F.lit(1)) - 1).alias("coalesced_count"),
        F.min("timestamp").alias("created_at"),
        F.max("timestamp").alias("last_requested_at"),
    )
