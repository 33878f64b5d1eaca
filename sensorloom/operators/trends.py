"""Trend and variation of recent readings, one row per (keys, measurement type)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.functions import fixed


def bound_recent(obs: DataFrame, window: int, keys: Sequence[str] = ("asset_id",)) -> DataFrame:
    """Newest ``window`` rows per measurement type; ``_age`` is 1 for the newest row.

    ``row_number <= window`` lets Spark keep only ``window`` rows per series in every
    map task, so a very long series never travels through the shuffle.
    """
    if window <= 0:
        raise ValueError("window must be > 0")
    newest = Window.partitionBy(*keys, "measurement_type").orderBy(F.desc("timestamp"), F.desc("id"))
    return obs.withColumn("_age", F.row_number().over(newest)).filter(F.col("_age") <= window)


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values)


def _pop_std(values: Column, mean: Column) -> Column:
    return F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)) / F.size(values))


def recent_arrays(bounded: DataFrame, keys: Sequence[str] = ("asset_id",)) -> DataFrame:
    """Collapse bounded rows to ``readings`` (oldest first) per (keys, measurement type)."""
    reading = F.struct("timestamp", "id", "value", "unit")
    return (
        bounded.groupBy(*keys, "measurement_type")
        .agg(F.array_sort(F.collect_list(reading)).alias("readings"))
        .withColumn("values", F.transform("readings", lambda r: r["value"]))
        .withColumn("n", F.size("values"))
    )


def direction_of(values: Column, n: Column) -> Column:
    """Split-half trend: the means of the first and last ``n // 2`` values against the spread."""
    half = F.floor(n / 2).cast("int")
    shift = _mean(F.slice(values, n - half + 1, half)) - _mean(F.slice(values, F.lit(1), half))
    spread = _pop_std(values, _mean(values))
    sign = F.when(shift > 0, "increasing").otherwise("decreasing")
    return (
        F.when(n < fixed.MIN_TREND_ROWS, "stable")
        .when(F.abs(shift) <= fixed.STABLE_EPSILON, "stable")
        .when(spread <= fixed.STABLE_EPSILON, sign)
        .when(F.abs(shift) / spread < fixed.TREND_RATIO, "stable")
        .otherwise(sign)
    )


def variation_of(values: Column, n: Column) -> Column:
    spread = F.array_max(values) - F.array_min(values)
    return F.when((n >= fixed.MIN_TREND_ROWS) & (spread > fixed.HIGH_VARIATION), "high").otherwise("low")


def trend_signals(obs: DataFrame, window: int = fixed.SESSION_WINDOW, keys: Sequence[str] = ("asset_id",)) -> DataFrame:
    """Trend and variation per measurement type over the newest ``window`` rows."""
    arrays = recent_arrays(bound_recent(obs, window, keys), keys)
    values, n = F.col("values"), F.col("n")
    return arrays.withColumn("trend", direction_of(values, n)).withColumn("variation", variation_of(values, n))


def _monotonicity(deltas: Column, direction: Column) -> Column:
    moves = F.filter(deltas, lambda d: F.abs(d) > 1e-12)
    rising = F.size(F.filter(moves, lambda d: d > 0))
    falling = F.size(F.filter(moves, lambda d: d < 0))
    aligned = F.when(direction == "rising", rising).otherwise(falling)
    return (
        F.when(F.size(deltas) == 0, 1.0)
        .when(direction == "stable", F.when(F.size(moves) == 0, 1.0).otherwise(0.6))
        .when(F.size(moves) == 0, 0.8)
        .otherwise(aligned / F.size(moves))
    )


def with_diagnostics(arrays: DataFrame, values: str = "values", prefix: str = "") -> DataFrame:
    """Add direction, rate, monotonicity, volatility and stability of an ordered value array.

    Rows with fewer than eight values get the neutral answer (stable, 0, 50, 0) and a null
    monotonicity.
    """
    v = F.col(values)
    n = F.size(v)
    enough = n >= fixed.MIN_TREND_ROWS
    first, last = F.element_at(v, 1), F.element_at(v, -1)
    deltas = F.zip_with(F.slice(v, 2, F.greatest(n - 1, F.lit(0))), F.slice(v, 1, F.greatest(n - 1, F.lit(0))), lambda a, b: a - b)
    out = arrays.filter(n > 0).withColumn("_d", deltas)
    d = F.col("_d")
    net = last - first
    rate = net / F.greatest(n - 1, F.lit(1))
    guess = F.when(F.abs(net) <= 1e-9, "stable").when(net > 0, "rising").otherwise("falling")
    volatility = F.when(F.size(d) == 0, 0.0).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), _pop_std(d, _mean(d)) / (F.abs(rate) + 1e-6)))
    )
    out = out.withColumn("_guess", guess).withColumn("_vol", volatility)
    out = out.withColumn("_mono", _monotonicity(d, F.col("_guess")))
    raw = F.lit(0.65) * F.col("_mono") + F.lit(0.35) * (F.lit(1.0) - F.col("_vol"))
    out = out.withColumn("_stab", F.greatest(F.lit(0), F.least(F.lit(100), F.bround(raw * 100).cast("int"))))
    demoted = (F.col("_guess") != "stable") & (F.col("_stab") < 55)
    direction = F.when(demoted, "stable").otherwise(F.col("_guess"))
    p = prefix
    return (
        out.withColumn(f"{p}direction", F.when(enough, direction).otherwise("stable"))
        .withColumn(f"{p}rate_of_change", F.when(enough, rate).otherwise(0.0))
        .withColumn(
            f"{p}monotonicity",
            F.when(enough, F.when(demoted, _monotonicity(d, F.lit("stable"))).otherwise(F.col("_mono"))),
        )
        .withColumn(f"{p}volatility_norm", F.when(enough, F.col("_vol")))
        .withColumn(f"{p}stability_score", F.when(enough, F.col("_stab")).otherwise(50))
        .withColumn(f"{p}volatility_score", F.when(enough, F.bround(F.col("_vol") * 100).cast("int")).otherwise(0))
        .withColumn(f"{p}window_rows", n)
        .drop("_d", "_guess", "_vol", "_mono", "_stab")
    )


def trend_sentence(label: Column, prefix: str = "") -> Column:
    """One sentence for the diagnostics produced by :func:`with_diagnostics`."""
    c = lambda name: F.col(prefix + name)
    rows = c("window_rows").cast("string")
    verb = F.when(c("direction") == "rising", "increased").otherwise("decreased")
    across = F.concat(F.lit(" across the last "), rows, F.lit(" observations."))
    steady = (c("monotonicity") >= 0.85) & (c("stability_score") >= 70)
    qualifier = F.when(c("volatility_score") >= 45, " with variability").otherwise(" gradually")
    return (
        F.when(c("window_rows") < fixed.MIN_TREND_ROWS, F.concat(label, F.lit(" has insufficient history for trend analysis.")))
        .when(
            (c("direction") == "stable") & (c("volatility_score") >= 60),
            F.concat(label, F.lit(" stayed within a narrow range but was noisy"), across),
        )
        .when(c("direction") == "stable", F.concat(label, F.lit(" remained stable"), across))
        .when(steady, F.concat(label, F.lit(" "), verb, F.lit(" steadily"), across))
        .otherwise(F.concat(label, F.lit(" "), verb, qualifier, across))
    )


def monotonic_tail(values: Column, n: Column) -> Column:
    """Last three values never fall or never rise."""
    a, b, c = (F.element_at(values, i) for i in (-3, -2, -1))
    return F.when(n < 3, False).otherwise(((a <= b) & (b <= c)) | ((a >= b) & (b >= c)))
