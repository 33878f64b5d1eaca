"""Text sources: observation CSV, JSON telemetry events and topic messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.functions.scalar import is_finite, parse_iso
from sensorloom.operators.reads import CANONICAL_UNITS

OBSERVATION_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("asset_id", T.StringType(), False),
        T.StructField("timestamp", T.TimestampType(), False),
        T.StructField("measurement_type", T.StringType(), False),
        T.StructField("value", T.DoubleType(), False),
        T.StructField("unit", T.StringType(), False),
    ]
)
CSV_SCHEMA = "id string, asset_id string, measurement_type string, value double, unit string, timestamp timestamp"
CSV_COLUMNS = ["id", "asset_id", "measurement_type", "value", "unit", "timestamp"]
TOPIC_PATTERN = r"^{root}/([^/]+)/([^/]+)/telemetry/([^/]+)$"
EVENT_FIELDS = ["event_id", "event_version", "asset_id", "timestamp", "measurement_name", "value", "unit", "source"]


def read_observations_csv(spark: SparkSession, path: str, permissive: bool = False) -> DataFrame:
    """Six positional columns below a header; any bad row fails the read.

    ``permissive`` keeps bad lines in ``_corrupt_record`` instead.
    """
    reader = spark.read.option("header", True).option("enforceSchema", True)
    if permissive:
        return reader.schema(CSV_SCHEMA + ", _corrupt_record string").option("mode", "PERMISSIVE").csv(path)
    return reader.schema(CSV_SCHEMA).option("mode", "FAILFAST").csv(path)


def parse_observation_lines(lines: DataFrame, column: str = "line") -> DataFrame:
    """The CSV record format applied to a column of lines."""
    parsed = F.from_csv(F.col(column), CSV_SCHEMA, {"mode": "FAILFAST"})
    return lines.select(parsed.alias("_o")).select("_o.*")


def observations_from_rows(spark: SparkSession, rows) -> DataFrame:
    """Small in-memory source with the fixed schema."""
    return spark.createDataFrame(rows, OBSERVATION_SCHEMA)


def telemetry_to_events(obs: DataFrame, source: str) -> DataFrame:
    """Observations as versioned JSON events keyed by asset."""
    stamp = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    envelope = F.struct(
        F.col("asset_id"),
        F.col("id").alias("event_id"),
        F.lit("v1").alias("event_version"),
        F.col("measurement_type").alias("measurement_name"),
        F.lit(source).alias("source"),
        stamp.alias("timestamp"),
        "unit",
        "value",
    )
    return obs.select(F.col("asset_id").alias("key"), F.to_json(envelope).alias("value"))


def decode_events(raw: DataFrame, units: dict[str, str] | None = None, column: str = "value") -> DataFrame:
    """Decode JSON telemetry events; ``reject_reason`` is null for valid ones.

    Works on a batch or a stream. The raw value text is inspected so that strings and
    booleans are not accepted as numbers. An event is parsed once whatever is done with the result: Spark would repeat the
    parsing in every filter on the reason, but moves none over a generator (``json_tuple``, ``inline``).
    """
    units = CANONICAL_UNITS if units is None else units
    text = F.col(column).cast("string")
    variant = F.try_parse_json(text)
    kind = lambda name: F.schema_of_variant(F.try_variant_get("_variant", f"$.{name}", "variant"))
    parsed = raw.withColumns({"_variant": variant, "_object": F.coalesce(F.schema_of_variant(variant).startswith("OBJECT"), F.lit(False))})
    # what is no object may still begin like one
    rest = F.when(~F.col("_object"), F.struct(*[F.get_json_object(text, f"$.{n}").alias(n) for n in EVENT_FIELDS]))
    parsed = parsed.withColumn("_rest", rest).select("*", F.json_tuple(text, *EVENT_FIELDS).alias(*[f"_in_{n}" for n in EVENT_FIELDS]))
    own = {f"_{n}": F.when(F.col("_object"), F.col(f"_in_{n}")).otherwise(F.col("_rest")[n]) for n in EVENT_FIELDS}
    kinds = {f"_kind_{n}": kind(n) for n in ("asset_id", "timestamp", "value")}
    out = parsed.withColumns(own | kinds).withColumns({"_stamp": parse_iso(F.col("_timestamp")), "_number": F.col("_value").try_cast("double")})
    numeric = F.col("_kind_value").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL|INT|SMALLINT|TINYINT).*")
    expected = F.coalesce(*[F.when(F.col("_measurement_name") == n, u) for n, u in units.items()])
    missing = None
    for name in EVENT_FIELDS:
        test = F.when(F.col(f"_{name}").isNull(), f"missing_{name}")
        missing = test if missing is None else missing.when(F.col(f"_{name}").isNull(), f"missing_{name}")
    reason = F.coalesce(
        F.when(~F.col("_object"), "invalid_json"),
        missing,
        F.when(F.col("_event_version") != "v1", "unsupported_version"),
        F.when((F.col("_asset_id") == "") | (F.col("_kind_asset_id") != "STRING"), "invalid_asset_id"),
        F.when(F.col("_stamp").isNull() | (F.col("_kind_timestamp") != "STRING"), "malformed_timestamp"),
        F.when(expected.isNull(), "unsupported_measurement"),
        F.when(F.col("_unit") != expected, "unit_mismatch"),
        F.when(~numeric | ~is_finite(F.col("_number")), "non_finite_value"),
    )
    good = F.col("_reason").isNull()
    keep = [c for c in raw.columns if c != column]
    result = F.struct(
        F.col("_event_id").alias("event_id"),
        F.col("_asset_id").alias("asset_id"),
        F.when(good, F.col("_stamp")).alias("timestamp"),
        F.col("_measurement_name").alias("measurement_type"),
        F.when(good, F.col("_number")).alias("value"),
        F.col("_unit").alias("unit"),
        F.col("_source").alias("source"),
        F.col("_reason").alias("reject_reason"),
    )
    return out.withColumn("_reason", reason).select(*keep, F.inline(F.array(result)))


def parse_topic_payload(messages: DataFrame, root: str, now: Column | None = None) -> DataFrame:
    """Topic + JSON payload → observation; body fields override the topic, bad messages get a reason."""
    pattern = TOPIC_PATTERN.format(root=root)
    part = lambda i: F.regexp_extract("topic", pattern, i)
    body = lambda name: F.get_json_object("payload", f"$.{name}")
    variant = F.try_parse_json("payload")
    kind = lambda name: F.schema_of_variant(F.try_variant_get(variant, f"$.{name}", "variant"))
    is_text = lambda name: F.coalesce(kind(name) == "STRING", F.lit(False))
    is_object = F.coalesce(F.schema_of_variant(variant).startswith("OBJECT"), F.lit(False))
    stamp = F.when(body("timestamp").isNull(), now if now is not None else F.current_timestamp()).when(
        is_text("timestamp"), parse_iso(body("timestamp"))
    )
    truth = F.when(kind("value") == "BOOLEAN", F.when(body("value") == "true", 1.0).otherwise(0.0))  # as float() takes it
    out = messages.select(
        "topic",
        part(1).alias("site"),
        F.coalesce(body("asset_id"), part(2)).alias("asset_id"),
        F.coalesce(body("measurement_type"), part(3)).alias("measurement_type"),
        stamp.alias("timestamp"),
        F.coalesce(truth, body("value").try_cast("double")).alias("value"),
        F.when(is_text("unit"), body("unit")).alias("unit"),
        F.when(is_text("id"), body("id")).alias("_id"),
        (~is_object).alias("_bad"),
        (is_object & kind("value").isNull()).alias("_no_value"),
    )
    generated = F.concat_ws(
        "-", F.lit("mqtt"), "asset_id", "measurement_type", F.floor(F.unix_micros("timestamp") / 1000).cast("string")
    )
    reason = (
        F.when(~F.col("topic").rlike(pattern), "unsupported_topic")
        .when(F.col("_bad"), "invalid_payload")
        .when(F.col("timestamp").isNull(), "invalid_timestamp")
        .when(F.col("_no_value"), "missing_value")
        .when(F.col("value").isNull(), "invalid_value")
        .when(F.coalesce(F.col("unit") == "", F.lit(True)), "missing_unit")
    )
    given = F.when(F.col("_id") != "", F.col("_id"))
    return out.withColumn("id", F.coalesce(given, generated)).withColumn("reject_reason", reason).drop("_id", "_bad", "_no_value")
