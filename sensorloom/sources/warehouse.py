"""Map the given tables to the engine's schemas (observations, samples, runs, scored)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.operators.series import with_position

SAMPLE_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"]
SIGNALS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CLASSES = ["A", "N", "R"]
HEALTHY = "N"
CADENCE = 10.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long telemetry: one row per (asset, time, measurement)."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("id"),
        F.col("user_id").cast("string").alias("asset_id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("event_type").alias("measurement_type"),
        F.col("value").cast("double").alias("value"),
        F.lit("unit").alias("unit"),
    )


def raw_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide samples without a tick, for order-free metrics."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("long").alias("run_id"),
        F.col("l_shipdate"),
        F.col("l_orderkey"),
        F.col("l_linenumber"),
        F.col("l_partkey"),
        *[F.col(s).cast("double").alias(s) for s in SIGNALS],
        F.col("l_returnflag").alias("true_class"),
        split_of(F.col("l_suppkey")).alias("split"),
    )


def split_of(key: Column) -> Column:
    return F.when(key % 5 <= 2, "train").when(key % 5 == 3, "validation").otherwise("test")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide synchronous samples: ``tick`` numbers a run's rows, ``elapsed = tick * 10 s``."""
    numbered = with_position(
        raw_samples(spark, sf_dir), ["run_id"], SAMPLE_ORDER, F.to_date("l_shipdate"), name="tick"
    )
    return numbered.withColumn("elapsed", F.col("tick") * F.lit(CADENCE))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per run, derived from the supplier table."""
    key = F.col("s_suppkey").cast("long")
    faulty = key % 4 != 0
    return table(spark, sf_dir, "supplier").select(
        key.alias("run_id"),
        F.element_at(F.array(*[F.lit(c) for c in ("normal", "A", "R", "A")]), (key % 4 + 1).cast("int")).alias("class_label"),
        F.when(faulty, 1000.0 + 10.0 * (key % 7)).alias("fault_start"),
        F.when(faulty, F.lit(600.0)).alias("fault_duration"),
        F.when(faulty, 0.15 + (key % 9) / 10.0).alias("severity"),
        F.col("s_acctbal").cast("double").alias("load_baseline"),
        split_of(key).alias("split"),
    )


def probability_columns() -> dict[str, Column]:
    q = {
        "A": F.col("l_quantity") / 50.0 + 0.01,
        "N": F.col("l_tax") * 12.5 + 0.01,
        "R": F.col("l_discount") * 10.0 + 0.01,
    }
    total = q["A"] + q["N"] + q["R"]
    return {f"p_{c}": F.round(q[c] / total, 9) for c in CLASSES}


def with_scores(df: DataFrame) -> DataFrame:
    """Deterministic class probabilities; rounding comes before any argmax or threshold."""
    return df.withColumns(probability_columns())


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_scores(samples(spark, sf_dir))


def raw_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_scores(raw_samples(spark, sf_dir))
