"""Streaming queries: each drives a stream over the given tables and reads its sink."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom.catalogue.c04_alerts import EVENTS, fold_sql
from sensorloom.catalogue.c06_features import SPEC, frame_sql
from sensorloom.catalogue.c08_corroboration import SECONDS, telemetry
from sensorloom.catalogue.registry import query, relation
from sensorloom.functions.fault_rules import TRANSITIONS
from sensorloom.functions.hysteresis import Policy
from sensorloom.functions.linear import LinearScorer
from sensorloom.lineage import stored
from sensorloom.operators import reads, series
from sensorloom.sources import text
from sensorloom.sources import warehouse as wh
from sensorloom.sources.dataset import scratch_dir
from sensorloom.streaming import evidence, replay, rollup, session, tables

REQUIRED = ("stack_temperature", "stack_pressure", "current")
SCORER = LinearScorer(
    ("A", "N", "R"),
    ("l_quantity__mean_30s", "l_tax__mean_30s", "l_discount__mean_30s"),
    (0.0, 0.0, 0.0),
    ((0.06, 0.0, 0.0), (0.0, 37.5, 0.0), (0.0, 0.0, 30.0)),
)
RUN_POLICY = Policy(0.40, 2, 0.40, 2)
VERSIONS = (("feature_schema", "1"), ("model_system", "linear-1"))
RESET_ALL, RESET_ONE = 200, 400  # ticks at which all sessions, and those of every seventh asset, start anew


def stream(spark, sf, name):
    wh.table(spark, sf, name)  # sets the time zone and checks that the table exists
    schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def reading_columns():
    """Columns of line items as readings: an order is one sample, its lines are the measurements."""
    names = F.array(*[F.lit(n) for n in reads.REQUIRED])
    units = F.array(*[F.lit(reads.CANONICAL_UNITS[n]) for n in reads.REQUIRED])
    line = F.col("l_linenumber").cast("int")
    return {
        "asset_id": F.concat(F.lit("asset-"), (F.col("l_orderkey") % 200).cast("string")),
        "timestamp": F.timestamp_seconds(F.col("l_orderkey")),
        "measurement_type": F.element_at(names, line),
        "value": F.col("l_quantity").cast("double"),
        "unit": F.element_at(units, line),
        "arrival": F.col("l_orderkey") * 10 + F.col("l_linenumber"),
    }


def order_readings(items):
    return items.select(*[column.alias(name) for name, column in reading_columns().items()])


@query(
    "R01_assemble_samples",
    """SELECT 'asset-' || (l_orderkey % 200) AS asset_id, make_timestamp(l_orderkey * 1000000) AS timestamp, CASE WHEN bool_or(lo <> hi) THEN 'conflicting_duplicate'
         WHEN count(*) FILTER (l_linenumber <= 3) < 3 THEN 'incomplete_timeout' ELSE 'complete' END AS status FROM (
       SELECT l_orderkey, l_linenumber, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1, 2) GROUP BY l_orderkey""",
)
def r01(spark, sf):
    return session.assemble_batch(order_readings(wh.table(spark, sf, "lineitem")), REQUIRED).drop("values")


# The outcomes of a sample, reading by reading in the order of arrival: [value of each line], whether it is complete, outcome.
relation(
    "order_lines",
    """SELECT asset_id, k, line, value, row_number() OVER (PARTITION BY k ORDER BY line, value) AS n FROM (
         SELECT 'asset-' || (l_orderkey % 200) AS asset_id, l_orderkey AS k, l_linenumber AS line, CAST(l_quantity AS DOUBLE) AS value FROM lineitem)""",
)
FOLD = """
  SELECT DISTINCT asset_id, k, 0::BIGINT AS n, [NULL, NULL, NULL, NULL, NULL, NULL, NULL]::DOUBLE[] AS held, false AS done, NULL::VARCHAR AS status FROM {lines}
  UNION ALL
  SELECT asset_id, k, n,
    CASE WHEN done OR before = value THEN held WHEN before IS NOT NULL THEN [NULL, NULL, NULL, NULL, NULL, NULL, NULL]::DOUBLE[] ELSE added END,
    done OR (before IS NULL AND added[1] IS NOT NULL AND added[2] IS NOT NULL AND added[3] IS NOT NULL),
    CASE WHEN done THEN 'late' WHEN before <> value THEN 'conflicting_duplicate' WHEN before IS NULL AND added[1] IS NOT NULL AND added[2] IS NOT NULL AND added[3] IS NOT NULL THEN 'complete' END
  FROM (SELECT f.asset_id, f.k, r.n, f.held, f.done, f.held[r.line] AS before, r.value,
               list_transform([1, 2, 3, 4, 5, 6, 7], lambda i: CASE WHEN i = r.line THEN r.value ELSE f.held[i] END) AS added
        FROM {name} f JOIN {lines} r ON r.k = f.k AND r.n = f.n + 1)"""
OUTCOMES = """SELECT asset_id, k, status FROM {name} WHERE status IS NOT NULL
  UNION ALL SELECT asset_id, k, 'incomplete_timeout' FROM (SELECT asset_id, k, arg_max(done, n) AS done, arg_max(held, n) AS held FROM {name} GROUP BY 1, 2)
  WHERE NOT done AND len(list_filter(held, lambda v: v IS NOT NULL)) > 0"""
relation("order_fold", "RECURSIVE_ " + FOLD.format(name="order_fold", lines="order_lines"), "order_lines")
relation("order_outcomes", OUTCOMES.format(name="order_fold"), "order_fold")


def outcomes(results):
    status = F.when(F.col("kind") == "quality", F.col("reason")).otherwise("complete")
    return results.select("asset_id", "timestamp", status.alias("status"))


@query(
    "R01_assemble_samples_stream",
    "SELECT asset_id, make_timestamp(k * 1000000) AS timestamp, status FROM order_outcomes",
    ("order_outcomes",),
)
def r01s(spark, sf):
    """Several micro-batches; the query is stopped half-way and started again from its checkpoint."""
    rows = order_readings(wh.table(spark, sf, "lineitem"))
    source, path, files = scratch_dir(spark), scratch_dir(spark), replay.side_by_side(spark)
    middle = rows.agg(F.expr("percentile_approx(arrival, 0.5)")).first()[0]
    flush = replay.end_of_input(rows, rows.agg(F.max("arrival")).first()[0] + 1)
    whole = replay.with_commands(rows, flush)
    for part in (whole.filter(F.col("arrival") <= middle), whole.filter(F.col("arrival") > middle)):
        replay.write_arrivals(part, source, "asset_id", 2, files)
        results = session.session_stream(replay.read_arrivals(spark, source, whole.schema, files), session.SessionConfig(REQUIRED))
        session.start_available(results, session.fan_out(path), f"{path}/checkpoint").awaitTermination()
    good = outcomes(spark.read.parquet(f"{path}/results"))
    return good.unionByName(spark.read.parquet(f"{path}/quality").select("asset_id", "timestamp", F.col("reason").alias("status")))


@query(
    "R01_assemble_fold",
    "SELECT asset_id, make_timestamp(k * 1000000) AS timestamp, status FROM order_outcomes",
    ("order_outcomes",),
)
def r01f(spark, sf):
    return session.assemble_fold(order_readings(wh.table(spark, sf, "lineitem")), REQUIRED).drop("place")


def sample_readings(spark, sf):
    """Samples as readings in the order of time."""
    pairs = F.array(*[F.struct(F.lit(s).alias("measurement_type"), F.col(s).alias("value")) for s in wh.SIGNALS])
    long = wh.samples(spark, sf).select(
        F.col("run_id").cast("string").alias("asset_id"), F.timestamp_seconds(F.col("elapsed").cast("long")).alias("timestamp"),
        F.lit("u").alias("unit"), "tick", F.posexplode(pairs).alias("_i", "_p"),
    )
    return stored(long.select("asset_id", "timestamp", "_p.*", "unit", (F.col("tick") * 10 + F.col("_i")).cast("long").alias("arrival")), "readings")


def scored_stream(spark, sf, commands=None, resets=(), **config):
    """Replay stored telemetry through assembly, features, scores and alerts in several micro-batches; three sinks."""
    rows = sample_readings(spark, sf)
    if commands is not None:
        rows = replay.with_commands(rows, commands(rows))
    source, path, files = scratch_dir(spark), scratch_dir(spark), replay.side_by_side(spark, 4)
    replay.write_arrivals(rows, source, "asset_id", 4, files)
    setup = {"spec": SPEC, "scorer": SCORER, "policy": RUN_POLICY, "healthy": "N", "versions": VERSIONS} | config
    readings = replay.read_arrivals(spark, source, rows.schema, files)
    results = session.session_stream(readings, session.SessionConfig(tuple(wh.SIGNALS), **setup), resets=resets)
    session.start_available(results, session.fan_out(path), f"{path}/checkpoint").awaitTermination()
    return path


relation(
    "stream_rows",
    """SELECT run_id, tick, elapsed, tick >= 12 AND l_discount >= 0.01 AS valid, round(ea / (ea + en + er), 9) AS p_A, round(en / (ea + en + er), 9) AS p_N, round(er / (ea + en + er), 9) AS p_R, tax_residual FROM (
       SELECT *, exp(ma - greatest(ma, mn, mr)) AS ea, exp(mn - greatest(ma, mn, mr)) AS en, exp(mr - greatest(ma, mn, mr)) AS er FROM (
       SELECT run_id, tick, elapsed, l_discount, l_tax - (0.02 + l_quantity / 50.0 * 0.04) AS tax_residual, 0.06 * avg(l_quantity) OVER w AS ma, 37.5 * avg(l_tax) OVER w AS mn, 30.0 * avg(l_discount) OVER w AS mr FROM samples WINDOW w AS (PARTITION BY run_id ORDER BY tick ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)))""",
    "samples",
)
AT = "CAST(run_id AS VARCHAR) AS asset_id, make_timestamp(CAST(elapsed * 1000000 AS BIGINT))"
STATUS = "CASE WHEN {no} < 12 THEN 'warming_up' WHEN l_discount < 0.01 THEN 'insufficient_data' ELSE 'valid_prediction' END AS status"


@query(
    "R02_rolling_features",
    f"""SELECT {AT} AS timestamp, {STATUS.format(no="tick")}, CASE WHEN tick >= 12 THEN mean_30 END AS mean_30, CASE WHEN tick >= 12 THEN std_60 END AS std_60, CASE WHEN tick >= 12 THEN min_120 END AS min_120,
        CASE WHEN tick >= 12 THEN max_120 END AS max_120, CASE WHEN tick >= 12 THEN slope_120 END AS slope_120, CASE WHEN tick >= 12 THEN delta_60 END AS delta_60,
        CASE WHEN tick >= 12 AND l_discount >= 0.01 THEN round(l_extendedprice / l_discount, 3) END AS price_per_discount, CASE WHEN tick >= 12 THEN round(l_tax - (0.02 + l_quantity / 50.0 * 0.04), 6) END AS tax_residual
        FROM (SELECT *, {', '.join(frame_sql(k) for k in (3, 6, 12))} FROM samples)""",
    ("samples",),
)
def r02(spark, sf):
    results = spark.read.parquet(f"{scored_stream(spark, sf, scorer=None, policy=None)}/results")
    of = lambda name: F.when(F.col("status") != "warming_up", F.element_at("values", F.lit(name)))
    stats = {s: f"l_quantity__{s}s" for s in ("mean_30", "std_60", "min_120", "max_120", "slope_120", "delta_60")}
    return results.select(
        "asset_id", "timestamp", "status", *[F.round(of(name), 5).alias(s) for s, name in stats.items()],
        F.round(of("price_per_discount"), 3).alias("price_per_discount"), F.round(of("tax__residual"), 6).alias("tax_residual"),
    )


relation(
    "stream_diagnosed",
    """SELECT *, greatest(p_A, p_N, p_R) AS confidence, CASE WHEN p_A >= p_N AND p_A >= p_R THEN 'A' WHEN p_N >= p_R THEN 'N' ELSE 'R' END AS predicted, true AS healthy_part FROM stream_rows""",
    "stream_rows",
)
relation(
    "fold_stream",
    "RECURSIVE_ " + fold_sql(0.40, "2", 0.40, "2", valid="s.valid", source="stream_diagnosed").replace("_self_", "fold_stream"),
    "stream_diagnosed",
)
relation("events_stream", EVENTS.format(f="fold_stream"), "fold_stream")


@query(
    "R03_score_stream",
    f"""SELECT {AT.replace("run_id", "s.run_id").replace("elapsed", "s.elapsed")} AS timestamp, CASE WHEN s.tick < 12 THEN 'warming_up' WHEN s.valid THEN 'valid_prediction' ELSE 'insufficient_data' END AS status,
        CASE WHEN s.valid THEN predicted END AS diagnosed_class, CASE WHEN s.valid THEN p_A END AS p_A, CASE WHEN s.valid THEN p_N END AS p_N, CASE WHEN s.valid THEN p_R END AS p_R, CASE WHEN s.valid THEN confidence END AS maximum_score,
        CASE WHEN s.tick >= 12 THEN CASE WHEN conf = '' THEN 'N' ELSE 'confirmed_' || conf END END AS alert_state,
        CASE WHEN s.tick >= 12 AND NOT s.valid THEN 'price_per_discount' END AS invalid_features, CASE WHEN s.valid THEN 'linear-1' END AS model_system,
        CASE WHEN s.valid THEN 'top_class_probability|runner_up_class_probability|residual:tax__residual' || CASE WHEN conf <> '' THEN '|alert_exit_progress' WHEN cand <> '' THEN '|alert_entry_progress' ELSE '' END END AS evidence,
        CASE WHEN s.valid THEN round(CASE WHEN conf <> '' THEN ex / 2.0 WHEN cand <> '' THEN streak / 2.0 ELSE tax_residual END, 6) END AS last_evidence
        FROM stream_diagnosed s JOIN fold_stream f ON f.run_id = s.run_id AND f.tick = s.tick""",
    ("stream_diagnosed", "fold_stream"),
)
def r03(spark, sf):
    results = spark.read.parquet(f"{scored_stream(spark, sf)}/results")
    labels = F.array_join(F.transform("evidence", lambda e: e["label"]), "|")
    return results.select(
        "asset_id", "timestamp", "status", "diagnosed_class", *[F.element_at("scores", F.lit(c)).alias(f"p_{c}") for c in ("A", "N", "R")],
        "maximum_score", "alert_state", F.array_join("invalid_features", "|").alias("invalid_features"),
        F.element_at("versions", F.lit("model_system")).alias("model_system"), labels.alias("evidence"),
        F.round(F.element_at("evidence", -1)["value"], 6).alias("last_evidence"),
    )


@query(
    "R04_alert_stream",
    """SELECT CAST(run_id AS VARCHAR) AS asset_id, make_timestamp(CAST(elapsed * 1000000 AS BIGINT)) AS timestamp, event_type, from_state, to_state, fault_class FROM events_stream""",
    ("events_stream",),
)
def r04(spark, sf):
    return spark.read.parquet(f"{scored_stream(spark, sf)}/results").filter(F.col("event_type").isNotNull()).select(
        "asset_id", "timestamp", "event_type", "from_state", "to_state", "fault_class"
    )


@query(
    "R05_session_manager",
    "SELECT CAST(run_id AS VARCHAR) AS asset_id, count(*) AS samples FROM samples GROUP BY 1",
    ("samples",),
)
def r05(spark, sf):
    results = spark.read.parquet(f"{scored_stream(spark, sf)}/results")
    return results.groupBy("asset_id").agg(F.max("sample_no").alias("samples"))


@query(
    "R05_session_reset",
    f"""SELECT {AT} AS timestamp, sample_no, {STATUS.format(no="sample_no")} FROM (
        SELECT *, tick - CASE WHEN run_id % 7 = 0 AND tick >= {RESET_ONE} THEN {RESET_ONE - 1} WHEN tick >= {RESET_ALL} THEN {RESET_ALL - 1} ELSE 0 END AS sample_no FROM samples)""",
    ("samples",),
)
def r05r(spark, sf):
    """All sessions start anew at one arrival, those of some assets again at a later one."""

    def commands(rows):
        some = rows.select("asset_id").distinct().filter(F.col("asset_id").cast("long") % 7 == 0)
        return some.select("asset_id", F.lit("reset").alias("op"), F.lit(RESET_ONE * 10).cast("long").alias("arrival"))

    results = spark.read.parquet(f"{scored_stream(spark, sf, commands, resets=[RESET_ALL * 10])}/results")
    return results.select("asset_id", "timestamp", "sample_no", "status")


@query(
    "R06_late_policy",
    """SELECT l_suppkey AS asset_id, count(*) FILTER (late) AS late, count(*) AS rows FROM (SELECT l_suppkey, coalesce(l_shipdate <= max(l_shipdate) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS late FROM lineitem) GROUP BY 1""",
)
def r06(spark, sf):
    items = wh.table(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "asset_id")
    arrival = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"]
    marked = session.late_rows(items, ["asset_id"], arrival, F.floor(F.col("l_orderkey") / 1_000), "l_shipdate")
    return marked.groupBy("asset_id").agg(F.count_if("late").alias("late"), F.count(F.lit(1)).alias("rows"))


@query(
    "R06_late_stream",
    """SELECT CAST(l_suppkey AS VARCHAR) AS asset_id, arrival, CAST(l_shipdate AS TIMESTAMP) AS timestamp, CASE WHEN late THEN 'late' ELSE 'complete' END AS status FROM (
       SELECT l_suppkey, l_shipdate, row_number() OVER w AS arrival, coalesce(l_shipdate <= max(l_shipdate) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS late
       FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice))""",
)
def r06s(spark, sf):
    """Every reading is a sample, so what is late on the stream is late by the window over all earlier arrivals."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"]
    items = series.with_position(wh.table(spark, sf, "lineitem"), ["l_suppkey"], order, F.floor(F.col("l_orderkey") / 1_000), name="arrival")
    place = F.col("arrival").cast("long")
    rows = stored(
        items.select(
            F.col("l_suppkey").cast("string").alias("asset_id"), F.col("l_shipdate").cast("timestamp").alias("timestamp"), F.lit("shipment").alias("measurement_type"),
            place.cast("double").alias("value"), F.lit("u").alias("unit"), place.cast("string").alias("event_id"), place.alias("arrival"),
        ),
        "shipments",
    )
    source, path, files = scratch_dir(spark), scratch_dir(spark), replay.side_by_side(spark)
    replay.write_arrivals(rows, source, "asset_id", replay.ranges(rows, 3, files), files)
    results = session.session_stream(replay.read_arrivals(spark, source, rows.schema, files), session.SessionConfig(("shipment",)))
    session.start_available(results, session.fan_out(path), f"{path}/checkpoint").awaitTermination()
    late = spark.read.parquet(f"{path}/quality").select("asset_id", F.col("source_event_id").cast("long").alias("arrival"), "timestamp", F.col("reason").alias("status"))
    good = spark.read.parquet(f"{path}/results")
    return late.unionByName(
        good.select("asset_id", F.element_at("values", F.lit("shipment")).cast("long").alias("arrival"), "timestamp", F.lit("complete").alias("status"))
    )


@query(
    "R07_transition_stream",
    """SELECT CAST(e.run_id AS VARCHAR) AS asset_id, make_timestamp(CAST(e.elapsed * 1000000 AS BIGINT)) AS observed_at, CASE event_type WHEN 'new_alert' THEN 'confirmed' WHEN 'class_change' THEN 'class_changed' ELSE 'cleared' END AS transition_type,
       from_state, to_state, fault_class, confidence AS maximum_score FROM events_stream e JOIN stream_diagnosed s ON s.run_id = e.run_id AND s.tick = e.pos""",
    ("events_stream", "stream_diagnosed"),
)
def r07(spark, sf):
    return spark.read.parquet(f"{scored_stream(spark, sf)}/transitions").drop("batch_id", "event_id")


relation(
    "quality_lines",
    """SELECT *, row_number() OVER (PARTITION BY k ORDER BY line, value) AS n FROM (
         SELECT 'asset-' || (l_orderkey % 200) AS asset_id, l_orderkey AS k, l_linenumber AS line, CAST(l_quantity AS DOUBLE) AS value FROM lineitem WHERE l_discount > 0.005 AND l_tax > 0.005)""",
)
relation("quality_fold", "RECURSIVE_ " + FOLD.format(name="quality_fold", lines="quality_lines"), "quality_lines")
relation("quality_outcomes", OUTCOMES.format(name="quality_fold"), "quality_fold")


@query(
    "R08_data_quality_stream",
    """SELECT reason AS detail, count(*) AS rows FROM (SELECT CASE WHEN k < 10 THEN 'unsupported_version' WHEN event_type = 'error' THEN 'unsupported_measurement' END AS reason FROM event_json) WHERE reason IS NOT NULL GROUP BY 1""",
    ("event_json",),
)
def r08(spark, sf):
    path = scratch_dir(spark)
    events = stream(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    body = F.struct(
        F.col("event_id").cast("string").alias("event_id"), F.when(F.col("k") < 10, "v9").otherwise("v1").alias("event_version"),
        F.col("user_id").cast("string").alias("asset_id"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
        F.col("event_type").alias("measurement_name"), "value", F.lit("unit").alias("unit"), F.lit("s").alias("source"),
    )
    units = {name: "unit" for name in ("click", "view", "signup", "purchase")}
    decoded = text.decode_events(events.select(F.to_json(body).alias("value")), units)
    malformed = decoded.filter(F.col("reject_reason").isNotNull()).select("asset_id", F.col("reject_reason").alias("detail"))

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{path}/quality/batch_id={batch_id}")

    session.start_available(malformed, write, f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/quality").groupBy("detail").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "R08_four_kinds",
    """SELECT asset_id, make_timestamp(k * 1000000) AS timestamp, status AS reason, NULL AS malformed, count(*) AS rows FROM quality_outcomes WHERE status <> 'complete' GROUP BY ALL
       UNION ALL SELECT 'asset-' || (l_orderkey % 200), NULL, 'malformed', CASE WHEN l_discount <= 0.005 THEN 'unsupported_version' ELSE 'unit_mismatch' END, count(*) FROM lineitem WHERE l_discount <= 0.005 OR l_tax <= 0.005 GROUP BY ALL""",
    ("quality_outcomes",),
)
def r08k(spark, sf):
    """JSON events of which some are malformed; the others pass the session, and both leave quality rows, each id once."""
    items = wh.table(spark, sf, "lineitem")
    numbered = series.with_position(items, ["l_orderkey"], ["l_linenumber", "l_quantity", "l_partkey", "l_suppkey"], F.col("l_linenumber"), name="n")
    body = F.struct(
        F.concat_ws("-", F.col("l_orderkey"), "n").alias("event_id"), F.when(F.col("l_discount") <= 0.005, "v9").otherwise("v1").alias("event_version"),
        "asset_id", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.col("measurement_type").alias("measurement_name"), "value",
        F.when(F.col("l_tax") <= 0.005, "other").otherwise(F.col("unit")).alias("unit"), F.lit("s").alias("source"),
    )
    keep = ["l_orderkey", "n", "l_discount", "l_tax"]
    rows = stored(numbered.select(*keep, *[c.alias(a) for a, c in reading_columns().items()]).select("asset_id", "arrival", F.to_json(body).alias("value")), "events")
    flush = replay.end_of_input(rows, rows.agg(F.max("arrival")).first()[0] + 1)
    whole = replay.with_commands(rows, flush)
    source, path, files = scratch_dir(spark), scratch_dir(spark), replay.side_by_side(spark)
    replay.write_arrivals(whole, source, "asset_id", 3, files)
    arrivals = replay.read_arrivals(spark, source, whole.schema, files)
    decoded = text.decode_events(arrivals.filter(F.col("op") == "reading").select("arrival", "value"))
    good = decoded.filter(F.col("reject_reason").isNull()).withColumn("op", F.lit("reading")).drop("source", "reject_reason")
    ends = arrivals.filter(F.col("op") == "flush").select("asset_id", "op", "arrival")
    results = session.session_stream(good.unionByName(ends, allowMissingColumns=True), session.SessionConfig(REQUIRED))
    quality = session.quality_events(decoded, results)
    put = tables.keyed_sink(f"{path}/quality", "quality_id", "timestamp")
    session.start_available(quality, put, f"{path}/checkpoint").awaitTermination()
    found = tables.read_keyed(spark, f"{path}/quality", quality.schema)
    return found.groupBy("asset_id", "timestamp", "reason", F.when(F.col("reason") == "malformed", F.col("detail")).alias("malformed")).agg(F.count(F.lit(1)).alias("rows"))


@query(
    "S08_three_sinks",
    f"""SELECT 'results' AS sink, {AT} AS timestamp, {STATUS.format(no="tick")} FROM samples UNION ALL SELECT 'transitions', {AT}, event_type FROM events_stream""",
    ("samples", "events_stream"),
)
def s08(spark, sf):
    path = scored_stream(spark, sf)
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    kind = F.coalesce(*[F.when(F.col("transition_type") == v, k) for k, v in TRANSITIONS.items()])
    parts = [
        read("results").select(F.lit("results").alias("sink"), "asset_id", "timestamp", "status"),
        read("transitions").select(F.lit("transitions").alias("sink"), "asset_id", F.col("observed_at").alias("timestamp"), kind.alias("status")),
        read("quality").select(F.lit("quality").alias("sink"), "asset_id", "timestamp", F.col("reason").alias("status")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def alert_rows(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.when(k < 50, "confirmed").when(k < 75, "class_changed").otherwise("cleared")
    state = F.concat(F.lit("confirmed_"), F.element_at(F.array(*[F.lit(c) for c in ("cooling_degradation", "hydrogen_supply_issue", "sensor_anomaly")]), k % 3 + 1))
    return wh.table(spark, sf, "events").filter(F.col("event_type") == "error").select(
        F.col("event_id").cast("string").alias("event_id"), F.col("user_id").cast("string").alias("asset_id"), F.col("ts").cast("timestamp").alias("observed_at"),
        kind.alias("transition_type"), F.when(kind == "cleared", state).otherwise("healthy").alias("from_state"),
        F.when(kind == "cleared", "healthy").otherwise(state).alias("to_state"), F.lit(0.9).alias("maximum_score"), F.col("event_id").alias("arrival"),
    )


@query(
    "R09_corroborate_stream",
    """SELECT event_id, asset_id, fault_class, investigation_id, result AS corroboration_result FROM corroborated""",
    ("corroborated",),
)
def r09(spark, sf):
    """Ten micro-batches; after half of them a new stream goes on from the evidence table alone."""
    path, readings = scratch_dir(spark), telemetry(spark, sf)
    alerts = alert_rows(spark, sf)
    middle = alerts.agg(F.expr("percentile_approx(arrival, 0.5)")).first()[0]
    handle = evidence.evidence_batches(f"{path}/evidence", readings, SECONDS)
    earlier = None
    for name, part in (("first", F.col("arrival") <= middle), ("second", F.col("arrival") > middle)):
        replay.write_arrivals(alerts.filter(part), f"{path}/{name}", "asset_id", 5)
        arrivals = replay.read_arrivals(spark, f"{path}/{name}", alerts.schema)
        found = evidence.investigation_stream(arrivals, earlier)
        session.start_available(found, handle, f"{path}/{name}-checkpoint").awaitTermination()
        earlier = evidence.read_evidence(spark, f"{path}/evidence", readings)
    return earlier.select("event_id", "asset_id", "fault_class", "investigation_id", "corroboration_result")


def event_arrivals(spark, sf, delayed=False):
    """Event readings in the order of their ids; ``delayed``: every fiftieth arrives 3,000 ids later."""
    place = F.col("event_id") + (F.when(F.col("event_id") % 50 == 0, 3_000).otherwise(0) if delayed else 0)
    rows = wh.observations(spark, sf).withColumn("event_id", F.col("id").cast("long"))
    return rows.withColumn("arrival", place).drop("event_id")


def rolled_up(spark, sf, delayed=False, look_back=None):
    rows = event_arrivals(spark, sf, delayed)
    source, path = scratch_dir(spark), scratch_dir(spark)
    replay.write_arrivals(rows, source, "asset_id", 6)
    rollup.run_rollup(replay.read_arrivals(spark, source, rows.schema).drop("arrival"), path, "1h", look_back)
    rollup.compact_rollup(spark, path)
    return path


@query(
    "R10_incremental_rollup",
    "SELECT CAST(bucket AS TIMESTAMP) AS bucket, asset_id, measurement_type, avg_value, min_value, max_value, sample_count, unit FROM hourly",
    ("hourly",),
)
def r10(spark, sf):
    rolled = rollup.read_rollup_table(spark, rolled_up(spark, sf))
    return rolled.withColumn("avg_value", F.round("avg_value", 6))


LATE_CHUNKS = """SELECT o.*, e.event_id, floor((arrival - min(arrival) OVER ()) / ceil((max(arrival) OVER () - min(arrival) OVER () + 1) / 6.0)) AS chunk
  FROM obs o JOIN (SELECT event_id, event_id + CASE WHEN event_id % 50 = 0 THEN 3000 ELSE 0 END AS arrival FROM events) e ON o.id = CAST(e.event_id AS VARCHAR)"""
relation("arrival_chunks", LATE_CHUNKS, "obs")
relation(
    "graded_arrivals",
    """SELECT a.*, coalesce(a.timestamp < h.high - INTERVAL 2 DAY, false) AS late FROM arrival_chunks a
       LEFT JOIN (SELECT c.chunk, max(b.timestamp) AS high FROM (SELECT DISTINCT chunk FROM arrival_chunks) c JOIN arrival_chunks b ON b.chunk < c.chunk GROUP BY 1) h ON h.chunk = a.chunk""",
    "arrival_chunks",
)


@query(
    "R10_late_rows",
    """SELECT id, 'late' AS kind, NULL::BIGINT AS sample_count FROM graded_arrivals WHERE late
       UNION ALL SELECT asset_id || '|' || measurement_type || '|' || strftime(date_trunc('hour', timestamp), '%Y-%m-%d %H'), 'rolled', count(*) FROM graded_arrivals WHERE NOT late GROUP BY 1""",
    ("graded_arrivals",),
)
def r10l(spark, sf):
    """A look-back of two days: readings that arrive later than that go to the late table, each reading is counted once."""
    path = rolled_up(spark, sf, delayed=True, look_back=2 * 86_400)
    late = rollup.late_readings(spark, path).select("id", F.lit("late").alias("kind"), F.lit(None).cast("long").alias("sample_count"))
    name = F.concat_ws("|", "asset_id", "measurement_type", F.date_format("bucket", "yyyy-MM-dd HH"))
    return late.unionByName(rollup.read_rollup_table(spark, path).select(name.alias("id"), F.lit("rolled").alias("kind"), "sample_count"))


@query(
    "R11_delivery_semantics",
    "SELECT event_id, 1::BIGINT AS copies FROM transitions",
    ("transitions",),
)
def r11(spark, sf):
    """The same events delivered twice, in other micro-batches and from a fresh checkpoint, into one sink keyed by event id."""
    path, rows = scratch_dir(spark), alert_rows(spark, sf)
    replay.write_arrivals(rows, f"{path}/source", "asset_id", 4)
    put = tables.keyed_sink(f"{path}/sink", "event_id", "observed_at")
    for files in (2, 5):
        session.start_available(replay.read_arrivals(spark, f"{path}/source", rows.schema, files), put, f"{path}/checkpoint-{files}").awaitTermination()
    return tables.read_keyed(spark, f"{path}/sink", rows.schema).groupBy("event_id").agg(F.count(F.lit(1)).alias("copies"))


@query(
    "R12_replay_run",
    f"SELECT {AT} AS timestamp, tick AS sample_no, {STATUS.format(no='tick')} FROM samples",
    ("samples",),
)
def r12(spark, sf):
    return spark.read.parquet(f"{scored_stream(spark, sf)}/results").select("asset_id", "timestamp", "sample_no", "status")
