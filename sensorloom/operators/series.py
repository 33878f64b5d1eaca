"""Ordered-series building blocks that stay parallel when one series is huge.

A plain ``Window.partitionBy(series)`` sends a whole series to one task. The
helpers here keep the same exact answers but never rely on a series fitting in
one task:

* :func:`in_cells` cuts series above ``hot_rows`` rows by ranges of their order, ties
  included; :func:`with_position` numbers rows cell by cell and adds the cells' offsets.
* :func:`in_blocks` cuts numbered series into blocks of consecutive rows and
  repeats the last ``halo`` rows of a block at the head of the next one, so
  lag/rolling windows can be partitioned by (series, block).
* :func:`running_total` is a two-level prefix sum over blocks.
* :func:`islands` groups consecutive equal rows.
* :func:`cumulative_by_value` and :func:`exact_quantiles` refine approximate cut
  points into exact running totals and quantiles without sorting a group in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.lineage import cut_lineage, stored

HOT_ROWS = 2_000_000
BLOCK_ROWS = 200_000
BIN_ROWS = 1_000_000  # distinct values of a bin that is not cut again
CUT_AGAIN = 256  # parts into which a larger bin is cut


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which a null key matches a null key; the right side's keys are dropped."""
    names = [f"_right_key_{i}" for i in range(len(keys))]
    renamed = right.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], *[c for c in right.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)])
    return left.join(renamed, on, how).drop(*names)


def in_cells(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], hot_rows: int | None = None) -> tuple[DataFrame, bool]:
    """Add ``_cell``, by which a huge series is cut along ``order``, and tell whether any series was cut.

    One count per series decides. Series of at most ``hot_rows`` rows are one cell. The others are dealt by ranges of
    (series, order), with a number per row behind the order, so that neither one day, nor one timestamp, nor equal rows
    make a large cell; the ranges are written to the shared folder, as everything after them must see the same ones.
    """
    limit = hot_rows or HOT_ROWS
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit)
    hot = cut_lineage(counts)  # at most total_rows / hot_rows rows
    total = hot.agg(F.sum("_n")).first()[0]
    if total is None:
        return df.withColumn("_cell", F.lit(0).cast("long")), False
    huge = null_safe_join(df, hot.select(*keys), keys, "left_semi").withColumn("_row", F.monotonically_increasing_id())
    ranged = huge.repartitionByRange(-(-total // limit) + 1, *keys, *order, "_row").drop("_row")
    cut = stored(ranged.withColumn("_cell", F.spark_partition_id().cast("long")), "series-cells")
    rest = null_safe_join(df, hot.select(*keys), keys, "left_anti").withColumn("_cell", F.lit(0).cast("long"))
    return rest.unionByName(cut), True


def with_position(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    chunk: Column | None = None,
    name: str = "pos",
    hot_rows: int | None = None,
) -> DataFrame:
    """1-based row number per ``keys`` in ``order``. A null key is a series like any other.

    Series above ``hot_rows`` are numbered cell by cell (:func:`in_cells`), and the sizes of a series' earlier cells are
    added. ``chunk``, a column that does not decrease along ``order``, may lead the cutting; it is not needed.
    """
    keys = list(keys)
    celled, cut = in_cells(df, keys, [*([chunk] if chunk is not None else []), *order], hot_rows)
    if not cut:
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        return celled.drop("_cell").withColumn(name, place.cast("long"))
    earlier = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    sizes = celled.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_rows"))
    offsets = sizes.select(*keys, "_cell", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
    numbered = celled.withColumn("_local", F.row_number().over(Window.partitionBy(*keys, "_cell").orderBy(*order)))
    placed = null_safe_join(numbered, offsets, [*keys, "_cell"]).withColumn(name, (F.col("_offset") + F.col("_local")).cast("long"))
    return placed.drop("_cell", "_local", "_offset")


def in_blocks(df: DataFrame, pos: str = "pos", halo: int = 0, ahead: int = 0, rows: int | None = None) -> DataFrame:
    """Add ``_block`` and ``_halo``: halo rows are copies owned by a neighbouring block.

    ``halo`` rows before a block and ``ahead`` rows after it are repeated into it.
    Only rows next to a block border are duplicated.
    """
    rows = rows or BLOCK_ROWS
    own = F.floor((F.col(pos) - 1) / F.lit(rows))
    offset = (F.col(pos) - 1) % F.lit(rows)
    targets = [F.when(F.lit(True), own)]
    if halo:
        targets.append(F.when(offset >= rows - halo, own + 1))
    if ahead:
        targets.append(F.when((offset < ahead) & (own > 0), own - 1))
    if len(targets) == 1:
        return df.withColumn("_block", own).withColumn("_halo", F.lit(False))
    return (
        df.withColumn("_own", own)
        .withColumn("_block", F.explode(F.array_compact(F.array(*targets))))
        .withColumn("_halo", F.col("_block") != F.col("_own"))
        .drop("_own")
    )


def block_window(keys: Sequence[str], pos: str = "pos"):
    return Window.partitionBy(*keys, "_block").orderBy(pos)


def drop_halo(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("_halo")).drop("_halo", "_block")


def lagged(df: DataFrame, keys: Sequence[str], columns: dict[str, Column], pos: str = "pos", halo: int = 1) -> DataFrame:
    """Evaluate window columns that look back at most ``halo`` rows.

    ``columns`` maps a name to a function of the block window.
    """
    window = block_window(keys, pos)
    out = in_blocks(df, pos, halo=halo)
    return drop_halo(out.withColumns({name: make(window) for name, make in columns.items()}))


def running_total(df: DataFrame, keys: Sequence[str], value: Column, name: str, pos: str = "pos") -> DataFrame:
    """Inclusive running sum of ``value`` along ``pos`` per series, in two levels."""
    keys = list(keys)
    blocked = in_blocks(df.withColumn("_v", value), pos).drop("_halo")
    local = block_window(keys, pos).rowsBetween(Window.unboundedPreceding, 0)
    totals = blocked.groupBy(*keys, "_block").agg(F.sum("_v").alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(*keys, "_block", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_base"))
    return (
        null_safe_join(blocked.withColumn("_run", F.sum("_v").over(local)), bases, [*keys, "_block"], "left")
        .withColumn(name, F.col("_run") + F.coalesce(F.col("_base"), F.lit(0)))
        .drop("_v", "_run", "_base", "_block")
    )


def running_max(df: DataFrame, keys: Sequence[str], value: Column, name: str, pos: str = "pos") -> DataFrame:
    """Greatest earlier value (this row excluded) along ``pos`` per series, in two levels."""
    keys = list(keys)
    blocked = in_blocks(df.withColumn("_v", value), pos).drop("_halo")
    tops = blocked.groupBy(*keys, "_block").agg(F.max("_v").alias("_top"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = tops.select(*keys, "_block", F.max("_top").over(earlier).alias("_base"))
    local = block_window(keys, pos).rowsBetween(Window.unboundedPreceding, -1)
    return (
        null_safe_join(blocked.withColumn("_run", F.max("_v").over(local)), bases, [*keys, "_block"], "left")
        .withColumn(name, F.greatest("_run", "_base"))
        .drop("_v", "_run", "_base", "_block")
    )


def islands(df: DataFrame, keys: Sequence[str], same: Sequence[str], pos: str = "pos", name: str = "island") -> DataFrame:
    """Number maximal stretches of consecutive rows whose ``same`` columns do not change."""
    changed = lambda w: F.when(
        F.lag(pos).over(w).isNotNull() & F.lag(F.struct(*same)).over(w).eqNullSafe(F.struct(*same)), 0
    ).otherwise(1)
    flagged = lagged(df, keys, {"_start": changed}, pos)
    return running_total(flagged, keys, F.col("_start").cast("long"), name, pos).drop("_start")


def cumulative_by_value(
    rows: DataFrame, keys: Sequence[str], value: str, measures: dict[str, Column], cuts: int = 64
) -> DataFrame:
    """Distinct values per group with running totals, computed without sorting a group in one task.

    Returns keys, ``_v`` (the value), ``_next`` (the next greater value, null for the last)
    and for every measure ``m``: ``m`` (sum at this value), ``cum_m`` (up to and including
    it) and ``total_m``.

    Equal values collapse map-side; a mergeable sketch gives up to ``cuts`` cut points per
    group, and bins that still hold more than ``BIN_ROWS`` distinct values are cut again into
    up to ``CUT_AGAIN`` each; every (group, bin) is ordered in its own task and
    the bins are chained through a table with one row per bin.
    """
    keys = list(keys)
    present = rows.filter(F.col(value).isNotNull()).select(
        *keys, F.col(value).alias("_v"), *[m.alias(f"_m_{n}") for n, m in measures.items()]
    )
    grid = [i / cuts for i in range(1, cuts)]
    counted = present.groupBy(*keys, "_v").agg(*[F.sum(f"_m_{n}").alias(n) for n in measures])
    # cut points over distinct values: bins hold similar numbers of collapsed rows, and the
    # shuffle behind ``counted`` is shared by both uses
    edges = counted.groupBy(*keys).agg(F.array_distinct(F.percentile_approx("_v", grid, 2_000)).alias("_edges"))
    # without keys there is one row of cut points, so attaching it adds no rows
    located = null_safe_join(counted, edges, keys) if keys else counted.crossJoin(F.broadcast(edges))
    binned = located.withColumn("_bin", F.size(F.filter("_edges", lambda e: e <= F.col("_v"))).cast("long")).drop("_edges")
    fine = [i / CUT_AGAIN for i in range(1, CUT_AGAIN)]
    inner = F.array_distinct(F.percentile_approx("_v", fine, 20 * CUT_AGAIN)).alias("_edges")
    large = binned.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_n"), inner).filter(F.col("_n") > BIN_ROWS).drop("_n")
    placed = null_safe_join(binned, large, [*keys, "_bin"], "left")
    finer = F.when(F.col("_edges").isNull(), 0).otherwise(F.size(F.filter("_edges", lambda e: e <= F.col("_v"))))
    binned = placed.withColumn("_bin", F.col("_bin") * CUT_AGAIN + finer).drop("_edges")
    along = Window.partitionBy(*keys).orderBy("_bin")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(*keys)
    bins = binned.groupBy(*keys, "_bin").agg(
        F.min("_v").alias("_low"), *[F.sum(n).alias(f"_bin_{n}") for n in measures]
    )
    chained = bins.select(
        *keys,
        "_bin",
        F.lead("_low").over(along).alias("_next_low"),
        *[F.coalesce(F.sum(f"_bin_{n}").over(earlier), F.lit(0)).alias(f"_base_{n}") for n in measures],
        *[F.sum(f"_bin_{n}").over(everything).alias(f"total_{n}") for n in measures],
    )
    inside = Window.partitionBy(*keys, "_bin").orderBy("_v")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    return null_safe_join(binned, chained, [*keys, "_bin"]).select(
        *keys,
        "_v",
        F.coalesce(F.lead("_v").over(inside), F.col("_next_low")).alias("_next"),
        *measures,
        *[(F.col(f"_base_{n}") + F.sum(n).over(upto)).alias(f"cum_{n}") for n in measures],
        *[f"total_{n}" for n in measures],
    )


def exact_quantiles(rows: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """Exact linearly interpolated quantiles per group, as columns ``q0, q1, ...``."""
    ranked = cumulative_by_value(rows, keys, value, {"n": F.lit(1).cast("long")})
    first, last = F.col("cum_n") - F.col("n"), F.col("cum_n") - 1
    aggregates = []
    for i, p in enumerate(probs):
        rank = F.lit(float(p)) * (F.col("total_n") - 1)
        low = F.max(F.when(F.floor(rank).between(first, last), F.col("_v").cast("double")))
        high = F.max(F.when(F.ceil(rank).between(first, last), F.col("_v").cast("double")))
        aggregates.append((low + (high - low) * F.max(rank - F.floor(rank))).alias(f"q{i}"))
    return ranked.groupBy(*keys).agg(*aggregates)


def exact_median(rows: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    return exact_quantiles(rows, keys, value, [0.5]).withColumnRenamed("q0", name)
