"""Fingerprints of tables that do not depend on the order of rows, and what differs between two of them.

Every row's cells are hashed with their column's name; a fingerprint holds the sum and the exclusive or of the row hashes and
the sum of each column's cell hashes. Sums count repeated rows (an exclusive or alone would let a pair of them vanish), and
fingerprints of parts of a table add up to that of the whole, so one aggregation with partial sums makes them. A cell's hash
holds the row's key, so a value that moves to another row changes its column's sum. Nulls are hashed as nulls, apart from
any value; the sums are exact decimals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUM = "decimal(38,0)"


def cell_hash(name: str, keys: Sequence[str], column: Column | None = None) -> Column:
    value = F.col(name) if column is None else column
    return F.xxhash64(F.lit(name), *[part for k in keys for part in (F.col(k).isNull(), F.col(k))], value.isNull(), value)


def fingerprint(df: DataFrame, keys: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """One row: ``rows``, ``row_sum``, ``row_xor``, ``key_sum`` and ``columns`` (name, place and sum of the cells, in order)."""
    columns = list(columns or df.columns)
    cells = [cell_hash(c, [k for k in keys if k != c]) for c in columns]
    row = F.xxhash64(*cells)
    key = F.xxhash64(*[part for k in keys for part in (F.col(k).isNull(), F.col(k))]) if keys else F.lit(0).cast("long")
    total = lambda h: F.coalesce(F.sum(h.cast(SUM)), F.lit(0).cast(SUM))
    sums = [F.struct(F.lit(c).alias("column"), F.lit(i).alias("place"), total(h).alias("cells")) for i, (c, h) in enumerate(zip(columns, cells))]
    return df.agg(
        F.count(F.lit(1)).alias("rows"), total(row).alias("row_sum"), F.coalesce(F.bit_xor(row), F.lit(0)).alias("row_xor"),
        total(key).alias("key_sum"), F.array(*sums).alias("columns"),
    )


def merged(parts: DataFrame) -> DataFrame:
    """The fingerprint of a table from those of its parts (same columns)."""
    cells = parts.select(F.explode("columns").alias("_c")).groupBy("_c.column", "_c.place").agg(F.sum("_c.cells").cast(SUM).alias("cells"))
    columns = cells.agg(F.array_sort(F.collect_list(F.struct("place", "column", "cells"))).alias("_c")).select(
        F.transform("_c", lambda c: F.struct(c["column"].alias("column"), c["place"].alias("place"), c["cells"].alias("cells"))).alias("columns")
    )
    sums = parts.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.sum("row_sum").cast(SUM).alias("row_sum"), F.coalesce(F.bit_xor("row_xor"), F.lit(0)).alias("row_xor"),
        F.sum("key_sum").cast(SUM).alias("key_sum"),
    )
    return sums.crossJoin(columns)  # one row each


def differences(declared: DataFrame, actual: DataFrame) -> DataFrame:
    """(check, column) that differ between two fingerprints: ``rows``, ``keys``, ``content``, and per column ``missing``,
    ``undeclared``, ``order`` or ``cells``. No rows where the tables are equal up to the order of rows."""
    both = declared.select(F.struct("*").alias("d")).crossJoin(actual.select(F.struct("*").alias("a")))  # one row each
    whole = F.array(
        F.struct((F.col("d.rows") != F.col("a.rows")).alias("found"), F.lit("rows").alias("check")),
        F.struct((F.col("d.key_sum") != F.col("a.key_sum")).alias("found"), F.lit("keys").alias("check")),
        F.struct(((F.col("d.row_sum") != F.col("a.row_sum")) | (F.col("d.row_xor") != F.col("a.row_xor"))).alias("found"), F.lit("content").alias("check")),
    )
    table = both.select(F.explode(whole).alias("_w")).filter("_w.found").select("_w.check", F.lit("").alias("column"))
    said = declared.select(F.explode("columns").alias("_c")).select("_c.column", F.col("_c.place").alias("place_d"), F.col("_c.cells").alias("cells_d"))
    seen = actual.select(F.explode("columns").alias("_c")).select("_c.column", F.col("_c.place").alias("place_a"), F.col("_c.cells").alias("cells_a"))
    problems = F.array_compact(
        F.array(
            F.when(F.col("place_a").isNull(), "missing").when(F.col("place_d").isNull(), "undeclared").when(F.col("place_d") != F.col("place_a"), "order"),
            F.when(F.col("cells_d") != F.col("cells_a"), "cells"),
        )
    )
    columns = said.join(seen, "column", "full_outer").select(F.explode(problems).alias("check"), "column")
    return table.unionByName(columns)


def misaligned_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row (rows, keys): do two tables differ in the number of rows, or in their keys with repeats, in any order?"""
    one = lambda df, side: fingerprint(df.select(*keys), keys, keys).select(F.col("rows").alias(f"rows_{side}"), F.col("key_sum").alias(f"keys_{side}"))
    both = one(left, "l").crossJoin(one(right, "r"))  # one row each
    return both.select((F.col("rows_l") != F.col("rows_r")).alias("rows"), (F.col("keys_l") != F.col("keys_r")).alias("keys"))
