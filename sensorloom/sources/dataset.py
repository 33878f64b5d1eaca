"""Typed dataset tables: export, loading, feature sinks and manifests."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.lineage import shared_folder

# Declared table schemas (name, type, nullable).
TELEMETRY = (
    ("dataset_id", "string", False),
    ("simulation_run_id", "string", False),
    ("observation_id", "string", False),
    ("timestamp", "timestamp", False),
    ("elapsed_sim_seconds", "double", False),
    ("asset_id", "string", False),
    ("measurement_type", "string", False),
    ("value", "double", False),
    ("unit", "string", False),
)
GROUND_TRUTH = (
    ("dataset_id", "string", False),
    ("simulation_run_id", "string", False),
    ("timestamp", "timestamp", False),
    ("elapsed_sim_seconds", "double", False),
    ("asset_id", "string", False),
    ("fault_type", "string", False),
    ("fault_active", "boolean", False),
    ("fault_severity", "double", False),
    ("seconds_since_fault_start", "double", True),
    ("sensor_corruption_type", "string", False),
)
SPLIT_NAMES = ("train", "validation", "test")


def required(name: str, kind: str) -> Column:
    """A column that Parquet writes as required; a null fails the write."""
    value = F.col(name).cast(kind)
    broken = F.raise_error(F.lit(f"null in the required column {name}")).cast(kind)
    never = {"string": F.lit(""), "double": F.lit(0.0), "boolean": F.lit(False), "timestamp": F.timestamp_seconds(F.lit(0))}[kind]
    return F.coalesce(F.when(value.isNull(), broken).otherwise(value), never)


def conform(df: DataFrame, declared) -> DataFrame:
    """Select and cast the declared columns in order; a missing column, or a null where none may be, is an error."""
    missing = [n for n, _, _ in declared if n not in df.columns]
    if missing:
        raise ValueError(f"missing declared columns: {missing}")
    return df.select(*[(F.col(n).cast(t) if nullable else required(n, t)).alias(n) for n, t, nullable in declared])


def write_dataset(path: str, telemetry: DataFrame, ground_truth: DataFrame, runs: DataFrame, mode: str = "error") -> None:
    """Parquet export partitioned by dataset, telemetry sorted for run/asset/time reads.

    Rows are range-partitioned on (run, time), so one very long run still spreads over
    many files.
    """
    layout = ["simulation_run_id", "elapsed_sim_seconds"]
    for name, df, declared in (("telemetry", telemetry, TELEMETRY), ("ground_truth", ground_truth, GROUND_TRUTH)):
        ordered = conform(df, declared).repartitionByRange(*layout).sortWithinPartitions("simulation_run_id", "asset_id", "elapsed_sim_seconds")
        ordered.write.mode(mode).partitionBy("dataset_id").parquet(f"{path}/{name}")
    runs.write.mode(mode).parquet(f"{path}/runs")


def load_dataset(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Typed tables of an exported dataset; any missing part fails at once."""
    ddl = lambda declared: ", ".join(f"{n} {t}" for n, t, _ in declared)
    return {
        "telemetry": spark.read.schema(ddl(TELEMETRY)).parquet(f"{path}/telemetry"),
        "ground_truth": spark.read.schema(ddl(GROUND_TRUTH)).parquet(f"{path}/ground_truth"),
        "runs": spark.read.parquet(f"{path}/runs"),
    }


def write_features(path: str, built: DataFrame, feature_columns, keys, mode: str = "error", rejected: DataFrame | None = None) -> None:
    """Valid rows and rejections as two tables with the same key columns.

    ``rejected`` are the same rows as ``built`` where those cannot be had without all their features.
    """
    built.filter("is_valid").select(*keys, *feature_columns).write.mode(mode).parquet(f"{path}/features")
    (built if rejected is None else rejected).filter("NOT is_valid").select(*keys, "reason_codes", "invalid_feature_names", "diagnostic_values_json").write.mode(mode).parquet(
        f"{path}/rejections"
    )


def write_labels(path: str, labels: DataFrame, mode: str = "error") -> None:
    labels.write.mode(mode).parquet(f"{path}/labels")


def null_counts(df: DataFrame, columns=None) -> DataFrame:
    """Rows and nulls per column, one output row per column, from a single pass."""
    columns = list(columns or df.columns)
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(f"_n_{i}") for i, c in enumerate(columns)])
    entries = [F.struct(F.lit(c).alias("column"), F.col("_rows").alias("rows"), F.col(f"_n_{i}").alias("nulls")) for i, c in enumerate(columns)]
    return counts.select(F.explode(F.array(*entries)).alias("_e")).select("_e.*")


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Name, size and SHA-256 of every file below ``path``; each file is hashed where it is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256")
    )


def compare_manifest(actual: DataFrame, declared: DataFrame) -> DataFrame:
    """Files that are missing or differ in size or hash."""
    joined = declared.alias("d").join(actual.alias("a"), "name", "left")
    problem = (
        F.when(F.col("a.sha256").isNull(), "missing")
        .when((F.col("a.size_bytes") != F.col("d.size_bytes")) | (F.col("a.sha256") != F.col("d.sha256")), "changed")
    )
    return joined.select("name", problem.alias("problem")).filter(F.col("problem").isNotNull())


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below the cluster's shared checkpoint folder."""
    return f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"
