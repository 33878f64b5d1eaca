"""Spark session settings shared by tests, the bench and interactive use."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "sensorloom", master: str | None = None, **conf) -> SparkSession:
    """Session with UTC time, AQE and skew-join handling switched on.

    Partition counts are left to the cluster unless passed in ``conf``
    (keys use ``__`` for dots, e.g. ``spark__sql__shuffle__partitions=8``).
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update({k.replace("__", "."): str(v) for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
