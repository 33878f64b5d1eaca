"""Time-aware joins whose work stays linear even when one key holds most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.operators import series


def as_of_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_time: str,
    right_time: str,
    take: Sequence[str],
    forward: bool = False,
    tie: Sequence[str] = (),
) -> DataFrame:
    """Attach to every left row the latest right row at or before its time.

    With ``forward=True``: the earliest right row at or after it. ``take`` names the
    right columns to attach (null when there is none); ``tie`` breaks equal right
    times (the greatest wins backward, the smallest forward).

    Both sides of a key lie in one ordered run. A key with very many rows is cut into cells along
    time and ties (:func:`series.in_cells`); a cell answers from its own rows, and rows without a local answer use
    the nearest earlier (later) cell's last (first) row, carried over a table with one row per cell.
    """
    keys = list(keys)
    payload = F.struct(*[F.col(c).alias(c) for c in take])
    rights = right.select(
        *keys, F.col(right_time).alias("_t"), F.struct(*tie).alias("_tie") if tie else F.lit(0).alias("_tie"), payload.alias("_r")
    )
    lefts = left.select(
        *keys, F.col(left_time).alias("_t"), F.struct("*").alias("_left")
    )
    both = rights.unionByName(lefts, allowMissingColumns=True).withColumn("_is_left", F.col("_left").isNotNull())
    if forward:
        order = [F.desc("_t"), F.asc("_is_left"), F.desc("_tie")]
    else:
        order = [F.asc("_t"), F.asc("_is_left"), F.asc("_tie")]
    celled, cut = series.in_cells(both, keys, order)
    answer = F.when(~F.col("_is_left"), F.col("_r"))
    if not cut:
        local = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        found = celled.withColumn("_found", F.last(answer, ignorenulls=True).over(local)).filter("_is_left")
        return found.select("_left.*", *[F.col("_found")[c].alias(c) for c in take])
    local = Window.partitionBy(*keys, "_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rank = F.when(~F.col("_is_left"), F.struct("_t", "_tie"))
    edge = F.min_by(answer, rank) if forward else F.max_by(answer, rank)
    edges = celled.groupBy(*keys, "_cell").agg(edge.alias("_edge"))
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.select(*keys, "_cell", F.last("_edge", ignorenulls=True).over(before).alias("_carry"))
    answered = celled.withColumn("_local", F.last(answer, ignorenulls=True).over(local))
    found = F.coalesce(F.col("_local"), F.col("_carry"))
    return (
        series.null_safe_join(answered.filter("_is_left"), carried, [*keys, "_cell"], "left")
        .select("_left.*", *[found[c].alias(c) for c in take])
    )


def first_rows_in_window(
    anchors: DataFrame,
    rows: DataFrame,
    keys: Sequence[str],
    anchor_time: str,
    row_time: str,
    row_order: Sequence[str],
    seconds: float,
    limit: int,
    take: Sequence[str],
) -> DataFrame:
    """For each anchor: the oldest ``limit`` rows with time in [anchor - seconds, anchor].

    Rows are numbered per key; a forward as-of lookup finds the first number inside the
    window, and at most ``limit`` consecutive numbers are fetched by equality. The
    output and the work are at most ``limit`` rows per anchor, however dense the key is.
    """
    keys = list(keys)
    numbered = series.with_position(rows, keys, [row_time, *row_order], F.to_date(row_time), name="_pos")
    start = F.timestamp_micros(F.unix_micros(anchor_time) - F.lit(int(seconds * 1_000_000)))
    located = as_of_join(
        anchors.withColumn("_start", start),
        numbered.withColumn("_first", F.col("_pos")).withColumn("_rt", F.col(row_time)),
        keys,
        "_start",
        "_rt",
        ["_first"],
        forward=True,
        tie=["_pos"],
    ).filter(F.col("_first").isNotNull())
    wanted = located.withColumn("_pos", F.explode(F.sequence(F.col("_first"), F.col("_first") + limit - 1)))
    fetched = numbered.select(*keys, "_pos", *[F.col(c).alias(f"row_{c}") for c in take])
    return (
        wanted.join(fetched, [*keys, "_pos"], "inner")
        .filter(F.col(f"row_{row_time}") <= F.col(anchor_time))
        .withColumn("row_no", (F.col("_pos") - F.col("_first") + 1).cast("int"))
        .drop("_pos", "_first", "_start")
    )


def two_way_anti(left: DataFrame, right: DataFrame, keys: Sequence[str], left_only: str, right_only: str) -> DataFrame:
    """Distinct keys present on one side only, labelled by ``side``."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return (
        a.join(b, list(keys), "left_anti")
        .withColumn("side", F.lit(left_only))
        .unionByName(b.join(a, list(keys), "left_anti").withColumn("side", F.lit(right_only)))
    )


def append_unique(incoming: DataFrame, existing: DataFrame, key: str, newest: Sequence[str | Column] = ()) -> DataFrame:
    """Incoming rows whose key is neither in ``existing`` nor repeated; the first in order wins."""
    fresh = incoming.join(existing.select(key), key, "left_anti")
    if not newest:
        return fresh.dropDuplicates([key])
    order = F.struct(*newest)
    row = F.struct(*[c for c in fresh.columns if c != key])
    return fresh.groupBy(key).agg(F.min_by(row, order).alias("_r")).select(key, "_r.*")


def strict_one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join that fails when either side has a duplicate or an unmatched key.

    Each side is one aggregation by key, so that one outer join both matches the rows and shows every broken key.
    """
    keys = list(keys)
    parts = {}
    for side, df in (("l", left), ("r", right)):
        rest = F.struct(*[c for c in df.columns if c not in keys])
        parts[side] = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"_n_{side}"), F.any_value(rest).alias(f"_{side}"))
    matched = parts["l"].join(parts["r"], keys, "full_outer")
    broken = F.raise_error(F.concat(F.lit("features and labels are not 1:1 at "), F.to_json(F.struct(*keys))))
    guard = F.when(F.col("_n_l").eqNullSafe(1) & F.col("_n_r").eqNullSafe(1), F.lit(True)).otherwise(broken)
    return matched.filter(guard).select(*keys, "_l.*", "_r.*")
