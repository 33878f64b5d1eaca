"""Registration of named queries and their comparison SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Shared relations for the comparison SQL, in dependency order.
RELATIONS: dict[str, tuple[tuple[str, ...], str]] = {
    "obs": (
        (),
        """SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS asset_id, ts AS timestamp,
           event_type AS measurement_type, CAST(value AS DOUBLE) AS value, 'unit' AS unit FROM events""",
    ),
    "samples": (
        (),
        """SELECT *, tick * 10.0::DOUBLE AS elapsed FROM (
             SELECT l_suppkey AS run_id, l_shipdate, l_orderkey, l_linenumber, l_partkey,
               CAST(l_quantity AS DOUBLE) AS l_quantity, CAST(l_extendedprice AS DOUBLE) AS l_extendedprice,
               CAST(l_discount AS DOUBLE) AS l_discount, CAST(l_tax AS DOUBLE) AS l_tax,
               l_returnflag AS true_class,
               CASE WHEN l_suppkey % 5 <= 2 THEN 'train' WHEN l_suppkey % 5 = 3 THEN 'validation' ELSE 'test' END AS split,
               row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey,
                                  l_quantity, l_extendedprice) AS tick
             FROM lineitem)""",
    ),
    "runs": (
        (),
        """SELECT s_suppkey AS run_id,
             CASE s_suppkey % 4 WHEN 0 THEN 'normal' WHEN 1 THEN 'A' WHEN 2 THEN 'R' ELSE 'A' END AS class_label,
             CASE WHEN s_suppkey % 4 <> 0 THEN 1000.0::DOUBLE + 10.0::DOUBLE * (s_suppkey % 7) END AS fault_start,
             CASE WHEN s_suppkey % 4 <> 0 THEN 600.0::DOUBLE END AS fault_duration,
             CASE WHEN s_suppkey % 4 <> 0 THEN 0.15::DOUBLE + (s_suppkey % 9) / 10.0::DOUBLE END AS severity,
             CAST(s_acctbal AS DOUBLE) AS load_baseline,
             CASE WHEN s_suppkey % 5 <= 2 THEN 'train' WHEN s_suppkey % 5 = 3 THEN 'validation' ELSE 'test' END AS split
           FROM supplier""",
    ),
    "scored": (
        ("samples",),
        """SELECT *, round(qa / (qa + qn + qr), 9) AS p_A, round(qn / (qa + qn + qr), 9) AS p_N,
             round(qr / (qa + qn + qr), 9) AS p_R
           FROM (SELECT *, l_quantity / 50.0::DOUBLE + 0.01::DOUBLE AS qa, l_tax * 12.5::DOUBLE + 0.01::DOUBLE AS qn,
                 l_discount * 10.0::DOUBLE + 0.01::DOUBLE AS qr FROM samples)""",
    ),
}


SELF = "RECURSIVE_ "


def relation(name: str, sql: str, *needs: str) -> None:
    """Add a shared relation that comparison SQL can build on."""
    RELATIONS[name] = (needs, sql)


def _collect(names, seen: list[str]) -> list[str]:
    for name in names:
        needs, _ = RELATIONS[name]
        _collect(needs, seen)
        if name not in seen:
            seen.append(name)
    return seen


def with_relations(sql: str, *names: str, recursive: bool = False) -> str:
    """Prefix ``sql`` with the shared relations it needs."""
    parts = []
    for n in _collect(names, []):
        text = RELATIONS[n][1]
        if text.startswith(SELF):  # a relation that refers to itself
            recursive = True
            parts.append(f"{n} AS ({text[len(SELF):]})")
        else:
            parts.append(f"{n} AS MATERIALIZED ({text})")
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        head, body = ",\n", body[5:]
    else:
        head = "\n"
    if not parts:
        return sql
    keyword = "WITH RECURSIVE " if recursive else "WITH "
    return keyword + ",\n".join(parts) + head + body


def _plain_timestamps(df: DataFrame) -> DataFrame:
    stamps = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampType)]
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in stamps}) if stamps else df


def query(name: str, sql: str | None = None, needs: tuple[str, ...] = (), recursive: bool = False):
    """Register ``fn(spark, sf_dir)`` under ``name``; timestamps leave as UTC wall-clock values."""

    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: _plain_timestamps(fn(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_relations(sql, *needs, recursive=recursive)
        return fn

    return register
