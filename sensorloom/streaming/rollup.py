"""Incremental rollup: micro-batches of readings merged into hourly or daily buckets on disk.

A batch aggregates its readings and rewrites the time partitions they fall into (a day of hourly buckets, a month of daily
ones) with the buckets that lie there; :func:`compact_rollup` leaves one version of every partition. Readings older than the
newest reading of the earlier batches by more than the look-back change nothing and go to a table of late readings, so that
every reading is counted in one of the two. Batch numbers are kept with the versions, so a batch that is delivered again
changes nothing; they come from the checkpoint, which therefore belongs to the table.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.streaming import tables

WIDTHS = {"1h": ("hour", "yyyyMMdd"), "1d": ("day", "yyyyMM")}  # bucket -> unit of the bucket, partition
LOOK_BACK = {"1h": 7 * 86_400, "1d": 90 * 86_400}  # seconds
KEYS = ["bucket", "asset_id", "measurement_type"]
STORED = T.StructType(
    [
        T.StructField("bucket", T.TimestampType()),
        T.StructField("asset_id", T.StringType()),
        T.StructField("measurement_type", T.StringType()),
        T.StructField("total", T.DoubleType()),
        T.StructField("min_value", T.DoubleType()),
        T.StructField("max_value", T.DoubleType()),
        T.StructField("sample_count", T.LongType()),
        T.StructField(
            "newest", T.StructType([T.StructField("timestamp", T.TimestampType()), T.StructField("id", T.StringType()), T.StructField("unit", T.StringType())])
        ),
        T.StructField("part", T.IntegerType()),
    ]
)


def partial(readings: DataFrame, bucket: str) -> DataFrame:
    """One row per bucket, asset and measurement that can be merged with others of its kind."""
    unit, part = WIDTHS[bucket]
    rows = readings.withColumn("bucket", F.date_trunc(unit, "timestamp"))
    grouped = rows.groupBy(*KEYS).agg(
        F.sum("value").alias("total"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.count(F.lit(1)).alias("sample_count"),
        F.max(F.struct("timestamp", "id", "unit")).alias("newest"),
    )
    return grouped.withColumn("part", F.date_format("bucket", part).cast("int"))


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new).groupBy(*KEYS, "part").agg(
        F.sum("total").alias("total"), F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"),
        F.sum("sample_count").alias("sample_count"), F.max("newest").alias("newest"),
    )


def rollup_batches(path: str, bucket: str = "1h", look_back: float | None = None) -> Callable[[DataFrame, int], None]:
    """Micro-batch handler for readings (id, asset_id, timestamp, measurement_type, value, unit)."""
    seconds = LOOK_BACK[bucket] if look_back is None else look_back

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        log = tables.touched(spark, path)
        newest, last = log.agg(F.max("high"), F.max("batch")).first() if log is not None else (None, None)
        if last is not None and last >= batch_id:
            return
        late = F.col("timestamp") < F.lit(newest - timedelta(seconds=seconds)) if newest is not None else F.lit(False)
        batch = batch.persist()  # read for the late rows, the touched partitions and the buckets
        batch.filter(late).write.mode("overwrite").parquet(f"{path}/late/batch_id={batch_id}")
        fresh = partial(batch.filter(~late), bucket).persist()
        notes = fresh.groupBy("part").agg(F.max("newest.timestamp").alias("high"), F.lit(batch_id).cast("long").alias("batch"))
        tables.rewrite(fresh, path, ["part"], STORED, merged, notes=notes)
        fresh.unpersist()
        batch.unpersist()

    return write


def run_rollup(readings: DataFrame, path: str, bucket: str = "1h", look_back: float | None = None) -> None:
    """Merge everything that is available into the table at ``path``, whose checkpoint lies beside it."""
    handle = rollup_batches(path, bucket, look_back)
    stream = readings.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{path}/checkpoint")
    stream.foreachBatch(handle).start().awaitTermination()


def compact_rollup(spark: SparkSession, path: str) -> None:
    """One version per partition on disk."""
    tables.compact(spark, path, ["part"], STORED)


def read_rollup_table(spark: SparkSession, path: str) -> DataFrame:
    rows = tables.live(spark, path, ["part"], STORED)
    return rows.select(*KEYS, (F.col("total") / F.col("sample_count")).alias("avg_value"), "min_value", "max_value", "sample_count", F.col("newest.unit").alias("unit"))


def late_readings(spark: SparkSession, path: str) -> DataFrame:
    """The readings that came too late, with ``batch_id``, the batch that brought them."""
    return spark.read.parquet(f"{path}/late")
