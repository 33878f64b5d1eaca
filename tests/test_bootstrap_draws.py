"""Draws of a bootstrap are made by many tasks, though the slots come out of one."""

from pyspark.sql import functions as F

from sensorloom.operators import metrics


def test_draws_are_made_by_many_tasks(spark):
    slots = spark.range(1, 401, numPartitions=1).select(F.col("id").alias("_slot"))
    draws = metrics.resampled_slots(slots, spark.range(1).select(F.lit(400).cast("long").alias("_n")), 10, "42")
    per_task = [r["count"] for r in draws.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert sum(per_task) == 4_000 and len(per_task) > 1 and max(per_task) < 4_000
    assert draws.agg(F.min("_slot"), F.max("_slot")).first()[:] >= (1, 1) and draws.filter("_slot < 1 OR _slot > 400").count() == 0
