"""Source, read, rollup, forecast and latency queries over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom.catalogue.registry import query, relation
from sensorloom.functions import scalar
from sensorloom.operators import joins, reads, series
from sensorloom.sources import text
from sensorloom.sources import warehouse as wh


@query("S01_read_observations_csv", "SELECT id, asset_id, timestamp, measurement_type, value, unit FROM obs", ("obs",))
def s01(spark, sf):
    stamp = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    columns = [F.when(F.lit(True), stamp).alias(c) if c == "timestamp" else F.col(c) for c in text.CSV_COLUMNS]
    lines = wh.observations(spark, sf).select(F.to_csv(F.struct(*columns)).alias("line"))
    return text.parse_observation_lines(lines)


@query("S02_observations_from_rows", "SELECT id, asset_id, timestamp, measurement_type, value, unit FROM obs", ("obs",))
def s02(spark, sf):
    obs = wh.observations(spark, sf)
    return obs.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in text.OBSERVATION_SCHEMA.fields])


relation(
    "event_json",
    """SELECT event_id, user_id, ts, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events""",
)
UNITS = {"click": "unit", "view": "unit", "signup": "unit", "purchase": "unit"}


@query(
    "S03_read_telemetry_events",
    """SELECT CAST(event_id AS VARCHAR) AS event_id, CASE WHEN reason IS NULL THEN ts END AS timestamp, event_type AS measurement_type,
         CASE WHEN reason IS NULL THEN value END AS value, reason AS reject_reason FROM (
       SELECT *, CASE WHEN k < 10 THEN 'unsupported_version' WHEN event_type = 'error' THEN 'unsupported_measurement'
         WHEN k < 20 THEN 'unit_mismatch' WHEN k < 30 THEN 'non_finite_value' END AS reason FROM event_json)""",
    ("event_json",),
)
def s03(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    number = F.when((k >= 20) & (k < 30), F.concat(F.lit('"'), F.col("value").cast("string"), F.lit('"'))).otherwise(
        F.col("value").cast("string")
    )
    body = F.format_string(
        '{"event_id":"%d","event_version":"%s","asset_id":"%d","timestamp":"%s","measurement_name":"%s","value":%s,"unit":"%s","source":"s"}',
        "event_id",
        F.when(k < 10, "v9").otherwise("v1"),
        "user_id",
        stamp,
        "event_type",
        number,
        F.when((k >= 10) & (k < 20), "other").otherwise("unit"),
    )
    raw = wh.table(spark, sf, "events").select(body.alias("value"))
    return text.decode_events(raw, UNITS).select("event_id", "timestamp", "measurement_type", "value", "reject_reason")


@query(
    "S04_parse_topic_payload",
    """SELECT site, asset_id, measurement_type, timestamp, value, unit, id, reason AS reject_reason FROM (
       SELECT CASE WHEN k >= 90 THEN '' ELSE 'plant' END AS site, CASE WHEN k < 50 THEN 'a' || user_id WHEN k >= 90 THEN '' ELSE CAST(user_id AS VARCHAR) END AS asset_id,
         CASE WHEN k >= 90 THEN '' ELSE event_type END AS measurement_type, CAST(ts AS TIMESTAMP) AS timestamp, value, CASE WHEN k >= 10 THEN 'unit' END AS unit,
         CASE WHEN k % 2 = 0 THEN 'e' || event_id ELSE 'mqtt-' || CASE WHEN k < 50 THEN 'a' || user_id WHEN k >= 90 THEN '' ELSE CAST(user_id AS VARCHAR) END || '-' || CASE WHEN k >= 90 THEN '' ELSE event_type END || '-' || (epoch_us(ts) // 1000) END AS id,
         CASE WHEN k >= 90 THEN 'unsupported_topic' WHEN k < 10 THEN 'missing_unit' END AS reason FROM event_json)""",
    ("event_json",),
)
def s04(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    events = wh.table(spark, sf, "events").withColumn("k", k)
    body = F.struct(
        F.when(F.col("k") < 50, F.concat(F.lit("a"), F.col("user_id").cast("string"))).alias("asset_id"),
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        "value",
        F.when(F.col("k") >= 10, "unit").alias("unit"),
        F.when(F.col("k") % 2 == 0, F.concat(F.lit("e"), F.col("event_id").cast("string"))).alias("id"),
    )
    topic = F.concat_ws(
        "/", F.lit("site/v1"), F.lit("plant"), F.col("user_id").cast("string"),
        F.when(F.col("k") >= 90, "status").otherwise("telemetry"), "event_type",
    )
    messages = events.select(topic.alias("topic"), F.to_json(body).alias("payload"))
    return text.parse_topic_payload(messages, "site/v1").drop("topic")


relation(
    "arrivals",
    "SELECT event_id // 2 AS key, ts, value, event_id FROM events WHERE event_type <> 'error'",
)


@query(
    "S10_append_unique",
    """SELECT key, min_by(event_id, ts) AS event_id, min_by(value, ts) AS value FROM arrivals
       WHERE key NOT IN (SELECT event_id // 2 FROM events WHERE event_type = 'error') GROUP BY key""",
    ("arrivals",),
)
def s10(spark, sf):
    events = wh.table(spark, sf, "events").withColumn("key", F.floor(F.col("event_id") / 2).cast("long"))
    incoming = events.filter(F.col("event_type") != "error").select("key", "ts", "value", "event_id")
    existing = events.filter(F.col("event_type") == "error").select("key").distinct()
    return joins.append_unique(incoming, existing, "key", ["ts"]).select("key", "event_id", "value")


@query(
    "S12_telemetry_to_events",
    """SELECT asset_id AS key, '{"asset_id":"' || asset_id || '","event_id":"' || id || '","event_version":"v1","measurement_name":"' || measurement_type
       || '","source":"plant","timestamp":"' || strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00","unit":"unit","value":' || CAST(value AS VARCHAR) || '}' AS value FROM obs""",
    ("obs",),
)
def s12(spark, sf):
    return text.telemetry_to_events(wh.observations(spark, sf), "plant")


@query(
    "P01_observations_in_range",
    """SELECT id, asset_id, timestamp, measurement_type, value FROM obs WHERE asset_id = '7' AND timestamp >= TIMESTAMP '2024-01-05'
       AND timestamp <= TIMESTAMP '2024-01-25' AND measurement_type = 'view' ORDER BY timestamp, id LIMIT 1000""",
    ("obs",),
)
def p01(spark, sf):
    return reads.in_range(wh.observations(spark, sf), "7", "2024-01-05", "2024-01-25", "view", 1000).drop("unit")


@query("P02_list_observations", "SELECT id, timestamp, value FROM obs ORDER BY timestamp, id", ("obs",))
def p02(spark, sf):
    return wh.observations(spark, sf).orderBy("timestamp", "id").select("id", "timestamp", "value")


@query("P03_get_by_id", "SELECT id, asset_id, timestamp, value FROM obs WHERE id = '42'", ("obs",))
def p03(spark, sf):
    # the id filter is written on the stored column so that it reaches the file scan
    row = wh.table(spark, sf, "events").filter(F.col("event_id") == 42)
    return row.select(
        F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("asset_id"),
        F.col("ts").cast("timestamp").alias("timestamp"), "value",
    )


@query("P04_list_assets", "SELECT DISTINCT asset_id FROM obs", ("obs",))
def p04(spark, sf):
    return wh.observations(spark, sf).select("asset_id").distinct().orderBy("asset_id")


relation(
    "primary_types",
    "SELECT asset_id, min_by(measurement_type, timestamp) AS measurement_type FROM obs GROUP BY asset_id",
    "obs",
)


@query(
    "P05_primary_measurement",
    "SELECT o.asset_id, o.id, o.measurement_type, o.value FROM obs o JOIN primary_types p USING (asset_id, measurement_type)",
    ("obs", "primary_types"),
)
def p05(spark, sf):
    return reads.primary_rows(wh.observations(spark, sf)).select("asset_id", "id", "measurement_type", "value")


@query(
    "P06_bound_recent",
    """SELECT id, asset_id, measurement_type, timestamp, value FROM bounded""",
    ("bounded",),
)
def p06(spark, sf):
    from sensorloom.operators.trends import bound_recent

    return bound_recent(wh.observations(spark, sf), 20).select("id", "asset_id", "measurement_type", "timestamp", "value")


@query(
    "P07_can_reason",
    """SELECT asset_id, count(*) >= 2 AND count(*) FILTER (measurement_type = p) >= 2 AS can_reason FROM (
       SELECT o.*, p.measurement_type AS p FROM obs o JOIN primary_types p USING (asset_id)) GROUP BY asset_id""",
    ("obs", "primary_types"),
)
def p07(spark, sf):
    return reads.can_reason(wh.observations(spark, sf))


@query(
    "P08_validate_observations",
    """SELECT CAST(event_id AS VARCHAR) AS id, CASE WHEN k < 5 THEN 'empty_asset_id' WHEN k < 10 THEN 'missing_timestamp' WHEN k < 15 THEN 'empty_unit' END AS reason FROM event_json""",
    ("event_json",),
)
def p08(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    rows = wh.table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("id"),
        F.when(k >= 5, F.col("user_id").cast("string")).otherwise("").alias("asset_id"),
        F.when(~k.between(5, 9), F.col("ts").cast("timestamp")).alias("timestamp"),
        F.when(k.between(10, 14), "").otherwise("unit").alias("unit"),
    )
    return rows.select("id", reads.observation_problem().alias("reason"))


NAMES = "['stack_temperature','stack_pressure','current','voltage','fuel_flow','power_output','coolant_flow']"
UNIT_LIST = "['celsius','kPa','A','V','SLPM','kW','L/min']"


@query(
    "P09_validate_samples",
    f"""WITH rows AS (SELECT l_orderkey AS sample_id, {NAMES}[l_linenumber] AS m, CASE WHEN l_tax = 0 THEN 'raw' ELSE {UNIT_LIST}[l_linenumber] END AS unit,
           {UNIT_LIST}[l_linenumber] AS expected, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS row_no FROM lineitem),
         graded AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY sample_id, m ORDER BY row_no) > 1 THEN 'duplicate_measurement' WHEN unit <> expected THEN 'unit_mismatch' END AS problem FROM rows)
       SELECT sample_id, count(*) AS readings, coalesce(min_by(problem, row_no) FILTER (problem IS NOT NULL), CASE WHEN count(DISTINCT m) < 7 THEN 'missing_measurement' END) AS reason
       FROM graded GROUP BY sample_id""",
)
def p09(spark, sf):
    from pyspark.sql import Window

    names, units = reads.REQUIRED, [reads.CANONICAL_UNITS[n] for n in reads.REQUIRED]
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), F.col("l_linenumber").cast("int"))
    rows = wh.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("sample_id"),
        F.col("l_orderkey").cast("string").alias("asset_id"),
        F.lit("2024-01-01").cast("timestamp").alias("timestamp"),
        pick(names).alias("measurement_type"),
        F.when(F.col("l_tax") == 0, "raw").otherwise(pick(units)).alias("unit"),
        F.col("l_quantity").alias("value"),
        # a sample holds a handful of readings, so numbering it in one task is bounded
        F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)).alias("row_no"),
    )
    return reads.validate_samples(rows)


@query("P10_split_filter", "SELECT run_id, l_orderkey, l_quantity FROM samples WHERE split = 'validation'", ("samples",))
def p10(spark, sf):
    # the split is a property of the run, so it is decided on the small side and applied as a semi join
    chosen = wh.runs(spark, sf).filter(F.col("split") == "validation").select("run_id")
    return wh.raw_samples(spark, sf).join(chosen, "run_id", "left_semi").select("run_id", "l_orderkey", "l_quantity")


@query(
    "P13_time_window",
    """SELECT asset_id, id, timestamp, value FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY timestamp, id) AS rk FROM obs
       WHERE timestamp >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY AND timestamp <= TIMESTAMP '2024-01-31') WHERE rk <= 5000""",
    ("obs",),
)
def p13(spark, sf):
    now = F.lit("2024-01-31").cast("timestamp")
    return reads.preset_window(wh.observations(spark, sf), "7d", now, reads.preset_limit("7d")).select("asset_id", "id", "timestamp", "value")


@query(
    "P13_time_window_all",
    """SELECT asset_id, id, timestamp, value FROM obs
       WHERE timestamp >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY AND timestamp <= TIMESTAMP '2024-01-31'""",
    ("obs",),
)
def p13_all(spark, sf):
    now = F.lit("2024-01-31").cast("timestamp")
    return reads.preset_window(wh.observations(spark, sf), "7d", now).select("asset_id", "id", "timestamp", "value")


ROLLUP = """SELECT date_trunc('{b}', timestamp) AS bucket, asset_id, measurement_type, round(avg(value), 6) AS avg_value, min(value) AS min_value,
  max(value) AS max_value, count(*) AS sample_count, max_by(unit, timestamp) AS unit FROM obs GROUP BY 1, 2, 3"""
relation("hourly", ROLLUP.format(b="hour"), "obs")
relation("daily", ROLLUP.format(b="day"), "obs")


def rounded(rolled):
    return rolled.withColumn("avg_value", F.round("avg_value", 6))


@query("A01_rollup_hourly", "SELECT * REPLACE (CAST(bucket AS TIMESTAMP) AS bucket) FROM hourly", ("hourly",))
def a01h(spark, sf):
    return rounded(reads.rollup(wh.observations(spark, sf), "1h"))


@query("A01_rollup_daily", "SELECT * REPLACE (CAST(bucket AS TIMESTAMP) AS bucket) FROM daily", ("daily",))
def a01d(spark, sf):
    return rounded(reads.rollup(wh.observations(spark, sf), "1d"))


@query(
    "A02_read_rollup",
    """SELECT CAST(bucket AS TIMESTAMP) AS bucket, measurement_type, avg_value, sample_count FROM daily WHERE asset_id = '7'
       AND bucket >= TIMESTAMP '2024-01-05' AND bucket <= TIMESTAMP '2024-01-25'""",
    ("daily",),
)
def a02(spark, sf):
    rolled = reads.read_rollup(reads.rollup(wh.observations(spark, sf), "1d"), "7", "2024-01-05", "2024-01-25")
    return rounded(rolled).select("bucket", "measurement_type", "avg_value", "sample_count")


@query(
    "P14_resolve_bucket",
    """SELECT CAST(bucket AS TIMESTAMP) AS bucket, measurement_type, sum(sample_count)::BIGINT AS sample_count FROM daily GROUP BY 1, 2""",
    ("daily",),
)
def p14(spark, sf):
    bucket = reads.resolve_bucket(None, 30 * 86_400)
    rolled = reads.rollup(wh.observations(spark, sf), bucket)
    return rolled.groupBy("bucket", "measurement_type").agg(F.sum("sample_count").alias("sample_count"))


@query(
    "A03_build_series",
    """SELECT asset_id, measurement_type, max_by(unit, timestamp) AS unit, count(*)::INTEGER AS samples,
       sha256(string_agg(epoch_us(timestamp) || '=' || CAST(value AS VARCHAR), ',' ORDER BY timestamp, id)) AS digest
       FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY timestamp, id) AS rk FROM obs) WHERE rk <= 60 GROUP BY 1, 2""",
    ("obs",),
)
def a03(spark, sf):
    return series_digest(reads.build_series(wh.observations(spark, sf), 60))


@query(
    "A03_build_series_all",
    """SELECT asset_id, measurement_type, max_by(unit, timestamp) AS unit, count(*)::INTEGER AS samples,
       sha256(string_agg(epoch_us(timestamp) || '=' || CAST(value AS VARCHAR), ',' ORDER BY timestamp, id)) AS digest
       FROM obs GROUP BY 1, 2""",
    ("obs",),
)
def a03_all(spark, sf):
    return series_digest(reads.build_series(wh.observations(spark, sf)))


def series_digest(built):
    item = lambda s: F.concat(F.unix_micros(s["timestamp"]).cast("string"), F.lit("="), s["value"].cast("string"))
    return built.select(
        "asset_id", "measurement_type", "unit", F.size("samples").alias("samples"),
        F.sha2(F.array_join(F.transform("samples", item), ","), 256).alias("digest"),
    )


@query("A04_count_by_status", "SELECT o_orderstatus AS status, count(*) AS jobs FROM orders GROUP BY 1")
def a04(spark, sf):
    return wh.table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("jobs"))


@query(
    "A05_reconcile_counts",
    """SELECT (SELECT count(*) FROM events) AS observation_rows, (SELECT count(*) FROM orders) AS evidence_rows,
       (SELECT count(DISTINCT o_custkey) FROM orders) AS distinct_investigations, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS pending_rows""",
)
def a05(spark, sf):
    events = wh.table(spark, sf, "events").agg(F.count(F.lit(1)).alias("observation_rows"))
    orders = wh.table(spark, sf, "orders").agg(
        F.count(F.lit(1)).alias("evidence_rows"),
        F.count_distinct("o_custkey").alias("distinct_investigations"),
        F.count_if(F.col("o_orderstatus") == "P").alias("pending_rows"),
    )
    return events.crossJoin(orders)  # one row each


@query(
    "A36_throughput",
    """SELECT round(count(*) / 2592000.0::DOUBLE, 9) AS events_per_second, round(count(*) FILTER (event_type <> 'error') / 2592000.0::DOUBLE, 9) AS valid_per_second FROM events""",
)
def a36(spark, sf):
    seconds = F.lit(2_592_000.0)
    return wh.observations(spark, sf).agg(
        F.round(F.count(F.lit(1)) / seconds, 9).alias("events_per_second"),
        F.round(F.count_if(F.col("measurement_type") != "error") / seconds, 9).alias("valid_per_second"),
    )


relation(
    "paired",
    """SELECT asset_id, measurement_type, timestamp, lead(timestamp) OVER (PARTITION BY asset_id ORDER BY timestamp, id) AS next_ts FROM obs""",
    "obs",
)
relation(
    "latencies",
    """SELECT measurement_type, (epoch_us(TIMESTAMP '2024-01-01' + (hash_ms * INTERVAL 1 MILLISECOND)) - epoch_us(TIMESTAMP '2024-01-01')) / 1000.0 AS ms
       FROM (SELECT event_type AS measurement_type, CAST(round(value * 10) AS BIGINT) - 50 AS hash_ms FROM events)""",
)


@query(
    "X07_latency_ms",
    """SELECT CAST(event_id AS VARCHAR) AS id, CASE WHEN d >= 0 THEN d::DOUBLE END AS ms FROM (SELECT event_id, CAST(round(value * 10) AS BIGINT) - 50 AS d FROM events)""",
)
def x07(spark, sf):
    return delayed(spark, sf).select("id", scalar.latency_ms(F.col("timestamp"), F.col("seen_at")).alias("ms"))


def delayed(spark, sf):
    shift = (F.round(F.col("value") * 10).cast("long") - 50) * 1000
    return wh.observations(spark, sf).withColumn("seen_at", F.timestamp_micros(F.unix_micros("timestamp") + shift))


@query(
    "A35_latency_summary",
    """SELECT measurement_type, count(*) AS count, max(excluded) AS excluded_count, max(ms) AS max_ms,
         max(ms) FILTER (rk = 1 + CAST(round_even(0.5 * (n - 1), 0) AS BIGINT)) AS median_ms, max(ms) FILTER (rk = 1 + CAST(round_even(0.95 * (n - 1), 0) AS BIGINT)) AS p95_ms FROM (
       SELECT l.measurement_type, ms::DOUBLE AS ms, row_number() OVER (PARTITION BY l.measurement_type ORDER BY ms) AS rk, count(*) OVER (PARTITION BY l.measurement_type) AS n, excluded
       FROM latencies l JOIN (SELECT measurement_type, count(*) FILTER (ms < 0) AS excluded FROM latencies GROUP BY 1) e USING (measurement_type) WHERE ms >= 0) GROUP BY 1""",
    ("latencies",),
)
def a35(spark, sf):
    rows = delayed(spark, sf).withColumn("ms", scalar.latency_ms(F.col("timestamp"), F.col("seen_at")))
    return nearest_rank_summary(rows, ["measurement_type"], "ms")


def nearest_rank_summary(rows, keys, value):
    from sensorloom.operators.metrics import nearest_rank_summary as summary

    return summary(rows, keys, value)


@query(
    "A37_steady_state_start",
    """SELECT CASE WHEN count(*) FILTER (n < 12) = 0 THEN max(t12) END AS steady_state_start FROM (
       SELECT asset_id, count(*) AS n, max(timestamp) FILTER (rk = 12) AS t12 FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY timestamp, id) AS rk FROM obs) GROUP BY 1)""",
    ("obs",),
)
def a37(spark, sf):
    from sensorloom.operators.metrics import steady_state_start

    return steady_state_start(wh.observations(spark, sf))


@query(
    "A38_repeated_runs",
    """SELECT event_type AS metric_name, count(*) AS run_count, round(quantile_cont(value, 0.5), 6) AS median, min(value) AS minimum, max(value) AS maximum,
       round(avg(value), 6) AS average FROM events GROUP BY 1""",
)
def a38(spark, sf):
    from sensorloom.operators.metrics import repeated_runs

    out = repeated_runs(wh.observations(spark, sf).withColumnRenamed("measurement_type", "metric_name"), "metric_name", "value")
    return out.withColumn("median", F.round("median", 6)).withColumn("average", F.round("average", 6))


@query(
    "A43_queue_growth",
    """SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, round((count(*) FILTER (event_type <> 'purchase') - count(*) FILTER (event_type = 'purchase')) / 86400.0::DOUBLE * 60, 9) AS growth_per_minute
       FROM events GROUP BY 1""",
)
def a43(spark, sf):
    from sensorloom.operators.metrics import queue_growth

    rates = wh.observations(spark, sf).groupBy(F.date_trunc("day", "timestamp").alias("day")).agg(
        (F.count_if(F.col("measurement_type") != "purchase") / 86_400.0).alias("ingest"),
        (F.count_if(F.col("measurement_type") == "purchase") / 86_400.0).alias("drain"),
    )
    return rates.select("day", F.round(queue_growth(F.col("ingest"), F.col("drain")), 9).alias("growth_per_minute"))


@query(
    "A44_coalesce_requests",
    """SELECT asset_id, count(*) - 1 AS coalesced_count, min(timestamp) AS created_at, max(timestamp) AS last_requested_at FROM obs GROUP BY 1""",
    ("obs",),
)
def a44(spark, sf):
    return reads.coalesce_requests(wh.observations(spark, sf))


@query(
    "W13_latest_per_group",
    """SELECT asset_id, measurement_type, id, age::INTEGER AS age FROM (SELECT *, row_number() OVER (PARTITION BY asset_id, measurement_type ORDER BY timestamp DESC, id DESC) AS age FROM obs) WHERE age <= 3""",
    ("obs",),
)
def w13(spark, sf):
    return reads.latest_per_type(wh.observations(spark, sf), 3).select("asset_id", "measurement_type", "id", "age")


relation(
    "context",
    """SELECT asset_id, measurement_type, n, hs, first_value, mean, greatest(sqrt(ss / 24.0), 1e-6) AS std, last, prev FROM (
       SELECT asset_id, measurement_type, max(n) AS n, max(bucket) AS hs, max(v) FILTER (pos = 1) AS first_value,
         (sum(v) + (24 - max(n)) * max(v) FILTER (pos = 1)) / 24.0 AS mean,
         max(v) FILTER (pos = n) AS last, coalesce(max(v) FILTER (pos = n - 1), max(v) FILTER (pos = 1)) AS prev,
         CASE WHEN min(v) = max(v) THEN 0 ELSE sum(v * v) + (24 - max(n)) * pow(max(v) FILTER (pos = 1), 2) - pow(sum(v) + (24 - max(n)) * max(v) FILTER (pos = 1), 2) / 24.0 END AS ss
       FROM (SELECT asset_id, measurement_type, bucket, v, row_number() OVER (PARTITION BY asset_id, measurement_type ORDER BY bucket) AS pos,
               count(*) OVER (PARTITION BY asset_id, measurement_type) AS n
             FROM (SELECT asset_id, measurement_type, date_trunc('hour', timestamp) AS bucket, avg(value) AS v,
                     row_number() OVER (PARTITION BY asset_id, measurement_type ORDER BY date_trunc('hour', timestamp) DESC) AS age FROM obs GROUP BY 1, 2, 3) WHERE age <= 24)
       GROUP BY 1, 2)""",
    "obs",
)


@query(
    "W27_forecast_features",
    """SELECT asset_id, measurement_type, 24 AS length, round(mean, 6) AS mean, round(std, 5) AS std, round((last - mean) / std, 4) AS last_feature,
       round((first_value - mean) / std, 4) AS first_feature FROM context """,
    ("context",),
)
def w27(spark, sf):
    context = reads.forecast_context(reads.rollup(wh.observations(spark, sf), "1h"))
    return context.select(
        "asset_id", "measurement_type", F.size("features").alias("length"), F.round("mean", 6).alias("mean"),
        F.round("std", 5).alias("std"), F.round(F.element_at("features", -1), 4).alias("last_feature"),
        F.round(F.element_at("features", 1), 4).alias("first_feature"),
    )


@query(
    "W28_forecast",
    """SELECT asset_id, measurement_type, 'unit' AS unit, step::INTEGER AS step, CAST(hs AS TIMESTAMP) + step * INTERVAL 1 HOUR AS timestamp, round(last + (last - prev) * step, 4) AS value
       FROM context, range(1, 13) t(step)""",
    ("context",),
)
def w28(spark, sf):
    return reads.forecast(reads.rollup(wh.observations(spark, sf), "1h")).withColumn("value", F.round("value", 4))


@query(
    "W29_sample_index",
    "SELECT asset_id, id, row_number() OVER (PARTITION BY asset_id ORDER BY timestamp, id) AS sample_index FROM obs",
    ("obs",),
)
def w29(spark, sf):
    return series.with_position(
        wh.observations(spark, sf), ["asset_id"], ["timestamp", "id"], F.to_date("timestamp"), name="sample_index"
    ).select("asset_id", "id", "sample_index")


@query("T09_fleet_order", "SELECT asset_id FROM (SELECT DISTINCT asset_id FROM obs) ORDER BY asset_id <> '42', asset_id", ("obs",))
def t09(spark, sf):
    return reads.fleet_order(wh.observations(spark, sf).select("asset_id").distinct(), "42")


@query(
    "T10_bounded_history",
    """SELECT asset_id, id, row_number() OVER (PARTITION BY asset_id ORDER BY age DESC)::INTEGER AS position FROM (
       SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY timestamp DESC, id DESC) AS age FROM obs) WHERE age <= 10""",
    ("obs",),
)
def t10(spark, sf):
    return reads.bounded_history(wh.observations(spark, sf), 10).select("asset_id", "id", "position")


@query(
    "J11_latest_before",
    """SELECT a.id AS alert_id, a.asset_id, e.id AS evidence_id, e.value AS evidence_value FROM (SELECT * FROM obs WHERE measurement_type = 'error') a
       ASOF LEFT JOIN (SELECT * FROM obs WHERE measurement_type = 'view') e ON a.asset_id = e.asset_id AND a.timestamp >= e.timestamp""",
    ("obs",),
)
def j11(spark, sf):
    obs = wh.observations(spark, sf)
    alerts = obs.filter(F.col("measurement_type") == "error").select(F.col("id").alias("alert_id"), "asset_id", "timestamp")
    evidence = obs.filter(F.col("measurement_type") == "view").select(
        "asset_id", F.col("timestamp").alias("seen"), F.col("id").alias("evidence_id"), F.col("value").alias("evidence_value")
    )
    joined = joins.as_of_join(alerts, evidence, ["asset_id"], "timestamp", "seen", ["evidence_id", "evidence_value"], tie=["evidence_id"])
    return joined.select("alert_id", "asset_id", "evidence_id", "evidence_value")


@query(
    "J12_first_visible_after",
    """SELECT a.id AS record_id, a.asset_id, e.id AS visible_id FROM (SELECT * FROM obs WHERE measurement_type = 'signup') a
       ASOF LEFT JOIN (SELECT * FROM obs WHERE measurement_type = 'purchase') e ON a.asset_id = e.asset_id AND a.timestamp <= e.timestamp""",
    ("obs",),
)
def j12(spark, sf):
    obs = wh.observations(spark, sf)
    records = obs.filter(F.col("measurement_type") == "signup").select(F.col("id").alias("record_id"), "asset_id", "timestamp")
    visible = obs.filter(F.col("measurement_type") == "purchase").select(
        "asset_id", F.col("timestamp").alias("seen"), F.col("id").alias("visible_id")
    )
    joined = joins.as_of_join(records, visible, ["asset_id"], "timestamp", "seen", ["visible_id"], forward=True, tie=["visible_id"])
    return joined.select("record_id", "asset_id", "visible_id")


@query(
    "J15_hop_latencies",
    """SELECT CAST(a.event_id AS VARCHAR) AS event_id, (epoch_us(b.o_orderdate) - epoch_us(a.ts)) / 1000.0::DOUBLE > 0 AS valid,
       CASE WHEN b.o_orderdate >= a.ts THEN ((epoch_us(b.o_orderdate) - epoch_us(a.ts)) / 1000.0)::DOUBLE END AS latency_ms
       FROM events a JOIN orders b ON a.event_id = b.o_orderkey""",
)
def j15(spark, sf):
    sent = wh.table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("sent_at"))
    stored = wh.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("event_id"), F.col("o_orderdate").cast("timestamp").alias("recorded_at")
    )
    latency = scalar.latency_ms(F.col("sent_at"), F.col("recorded_at"))
    return sent.join(stored, "event_id").select(
        F.col("event_id").cast("string").alias("event_id"), (F.unix_micros("recorded_at") > F.unix_micros("sent_at")).alias("valid"),
        latency.alias("latency_ms"),
    )


@query("X01_label", "SELECT DISTINCT upper(substr(x, 1, 1)) || substr(x, 2) AS title, x AS lower FROM (SELECT lower(replace(o_orderpriority, '_', ' ')) AS x FROM orders)")
def x01(spark, sf):
    name = F.col("o_orderpriority")
    return wh.table(spark, sf, "orders").select(scalar.label_title(name).alias("title"), scalar.label_lower(name).alias("lower")).distinct()


@query(
    "X02_contains",
    """SELECT o_orderpriority AS text, CASE WHEN contains(lower(o_orderpriority), 'urgent') THEN 'first' WHEN contains(lower(o_orderpriority), 'low') THEN 'second' ELSE 'none' END AS rule, count(*) AS n FROM orders GROUP BY 1, 2""",
)
def x02(spark, sf):
    text_col = F.lower("o_orderpriority")
    rule = F.when(text_col.contains("urgent"), "first").when(text_col.contains("low"), "second").otherwise("none")
    return wh.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("text"), rule.alias("rule")).agg(F.count(F.lit(1)).alias("n"))


@query("X04_deterministic_event_id")
def x04(spark, sf):
    namespace = "6ba7b8119dad11d180b400c04fd430c8"  # the RFC 4122 URL namespace
    return wh.observations(spark, sf).select(
        "id", scalar.name_uuid(namespace, F.concat_ws("|", "measurement_type", "asset_id", "id")).alias("event_id")
    )


@query(
    "X05_parse_iso",
    """SELECT event_id, ts AS parsed FROM events""",
)
def x05(spark, sf):
    ts = F.col("ts").cast("timestamp")
    k = F.col("event_id") % 3
    zulu = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    naive = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    offset = F.date_format(F.timestamp_micros(F.unix_micros(ts) + 7_200_000_000), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+02:00'")
    raw = F.when(k == 0, zulu).when(k == 1, naive).otherwise(offset)
    return wh.table(spark, sf, "events").select("event_id", scalar.parse_iso(raw).alias("parsed"))


@query(
    "X06_bucket_start",
    "SELECT event_id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour_start, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day_start FROM events",
)
def x06(spark, sf):
    ts = F.col("ts").cast("timestamp")
    return wh.table(spark, sf, "events").select(
        "event_id", scalar.bucket_start(ts, "1h").alias("hour_start"), scalar.bucket_start(ts, "1d").alias("day_start")
    )


@query(
    "X23_format_value_delta",
    """SELECT asset_id, measurement_type, CAST(v1 AS VARCHAR) || ' ' || last_unit AS value_text,
       CASE WHEN n >= 2 THEN 'Δ ' || printf('%.2f', v1 - v2) || ' ' || last_unit || ' (latest - previous)' END AS delta_text FROM trend""",
    ("trend",),
)
def x23(spark, sf):
    from sensorloom.operators import trends

    arrays = trends.recent_arrays(trends.bound_recent(wh.observations(spark, sf), 2))
    last = F.element_at("values", -1)
    delta = F.when(F.col("n") >= 2, last - F.element_at("values", 1))
    unit = F.element_at("readings", -1)["unit"]
    return arrays.select(
        "asset_id", "measurement_type", F.concat_ws(" ", last.cast("string"), unit).alias("value_text"),
        F.when(delta.isNotNull(), F.format_string("Δ %.2f %s (latest - previous)", delta, unit)).alias("delta_text"),
    )
