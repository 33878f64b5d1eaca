"""Alert-machine queries over the scored samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom.catalogue.registry import query, relation
from sensorloom.functions.hysteresis import Policy
from sensorloom.lineage import cut_lineage, stored
from sensorloom.operators import alerts, features
from sensorloom.sources import warehouse as wh

POLICY = Policy(0.45, 3, 0.45, 2)
RATIO = features.Ratio("price_per_discount", "l_extendedprice", "l_discount", 0.01)

DIAG = "CASE WHEN p_A >= p_N AND p_A >= p_R THEN 'A' WHEN p_N >= p_R THEN 'N' ELSE 'R' END"
relation(
    "diagnosed_rows",
    f"""SELECT s.*, r.class_label AS fault_class, r.fault_start, r.fault_duration, r.severity, {DIAG} AS predicted,
         greatest(p_A, p_N, p_R) AS confidence, l_discount >= 0.01 AS valid,
         r.fault_start IS NULL OR s.elapsed < r.fault_start AS healthy_part
       FROM scored s JOIN runs r USING (run_id)""",
    "scored",
    "runs",
)


def fold_sql(ep: float, en: str, xp: float, xn: str, valid: str = "true", source: str = "diagnosed_rows", grid: str = "") -> str:
    """Recursive reference fold; ``grid`` adds candidate columns pid, ep, en, xp, xn."""
    pick = "f.pid, f.ep, f.en, f.xp, f.xn, " if grid else ""
    names = "pid, ep, en, xp, xn, " if grid else ""
    start = f"SELECT run_id, {'g.*, ' if grid else ''}0::BIGINT AS tick, 0.0::DOUBLE AS elapsed, '' AS conf, '' AS cand, 0 AS streak, 0 AS ex, NULL::VARCHAR AS ev, '' AS before, false AS part, true AS valid, '' AS frozen FROM (SELECT DISTINCT run_id FROM {source}){', ' + grid + ' g' if grid else ''}"
    return f"""
{start}
UNION ALL
SELECT run_id, {names}tick, elapsed,
  CASE WHEN NOT v THEN conf WHEN conf <> '' AND nex >= {xn} THEN '' WHEN tracked AND nst >= {en} THEN d ELSE conf END,
  CASE WHEN NOT v THEN CASE WHEN conf = '' THEN '' ELSE cand END WHEN conf <> '' AND nex >= {xn} THEN '' WHEN tracked AND nst >= {en} THEN '' WHEN tracked THEN d ELSE '' END,
  CASE WHEN NOT v THEN CASE WHEN conf = '' THEN 0 ELSE streak END WHEN conf <> '' AND nex >= {xn} THEN 0 WHEN tracked AND nst >= {en} THEN 0 WHEN tracked THEN nst ELSE 0 END,
  CASE WHEN NOT v THEN ex WHEN conf = '' THEN 0 WHEN nex >= {xn} THEN 0 WHEN tracked AND nst >= {en} THEN 0 ELSE nex END,
  CASE WHEN NOT v THEN NULL WHEN conf <> '' AND nex >= {xn} THEN 'cleared' WHEN tracked AND nst >= {en} THEN CASE WHEN conf = '' THEN 'new_alert' ELSE 'class_change' END END,
  conf, part, v, ''
FROM (SELECT *, CASE WHEN d = cand THEN streak + 1 ELSE 1 END AS nst, CASE WHEN hp >= {xp} THEN ex + 1 ELSE 0 END AS nex, q AND d <> conf AS tracked
  FROM (SELECT f.run_id, {pick}s.tick, s.elapsed, f.conf, f.cand, f.streak, f.ex, s.predicted AS d, s.predicted <> 'N' AND s.confidence >= {ep} AS q, s.p_N AS hp, {valid} AS v, s.healthy_part AS part
        FROM _self_ f JOIN {source} s ON s.run_id = f.run_id AND s.tick = f.tick + 1))"""


def fold_relation(name: str, **kwargs) -> None:
    relation(name, "RECURSIVE_ " + fold_sql(**kwargs).replace("_self_", name), "diagnosed_rows")


fold_relation("fold", ep=0.45, en="3", xp=0.45, xn="2")
fold_relation("fold_gap", ep=0.45, en="3", xp=0.45, xn="2", valid="s.valid")
EVENTS = """SELECT run_id, tick AS pos, elapsed, ev AS event_type, CASE WHEN before = '' THEN 'N' ELSE 'confirmed_' || before END AS from_state,
  CASE WHEN conf = '' THEN 'N' ELSE 'confirmed_' || conf END AS to_state, CASE WHEN conf = '' THEN before ELSE conf END AS fault_class FROM {f} WHERE ev IS NOT NULL"""
for suffix in ("", "_gap"):
    relation("events_all" + suffix, EVENTS.format(f="fold" + suffix), "fold" + suffix)
    relation(
        "segments" + suffix,
        f"""SELECT run_id, count(*) AS rows, count(*) FILTER (valid) AS valid_rows, count(*) FILTER (valid AND (conf <> '' OR cand <> '')) AS alarmed_rows,
            max(elapsed) + 10.0 AS segment_end FROM fold{suffix} WHERE part GROUP BY run_id""",
        "fold" + suffix,
    )
    relation(
        "episodes" + suffix,
        f"""SELECT e.run_id, fault_class, elapsed AS start, coalesce(nxt, segment_end) AS "end", nxt IS NULL AS censored FROM (
            SELECT *, lead(elapsed) OVER (PARTITION BY run_id ORDER BY pos) AS nxt FROM (
              SELECT e.* FROM events_all{suffix} e JOIN runs r USING (run_id) WHERE r.fault_start IS NULL OR e.elapsed < r.fault_start)) e
            JOIN segments{suffix} USING (run_id) WHERE event_type <> 'cleared'""",
        "events_all" + suffix,
        "segments" + suffix,
        "runs",
    )


def evaluated(spark, sf, scored=None):
    """Scored samples with their run's fault window, diagnosis and validity."""
    rows = wh.scored(spark, sf) if scored is None else scored
    joined = rows.drop("split").join(
        wh.runs(spark, sf).withColumnRenamed("class_label", "fault_class").select(
            "run_id", "fault_class", "fault_start", "fault_duration", "severity", "split"
        ),
        "run_id",
    )
    return joined.withColumns(
        {
            "predicted": alerts.argmax_class(wh.CLASSES),
            "confidence": F.greatest(*[F.col(f"p_{c}") for c in wh.CLASSES]),
            "valid": features.ratio_struct(RATIO)["valid"],
            "healthy_part": F.col("fault_start").isNull() | (F.col("elapsed") < F.col("fault_start")),
        }
    )


def folded(spark, sf, gap=False, policies=(POLICY,), rows=None, **kwargs):
    rows = evaluated(spark, sf) if rows is None else rows
    scores = [kwargs.get("prefix", "p_") + c for c in wh.CLASSES]
    # the fold reads its rows several times: numbered once, and only the columns that it takes
    narrow = stored(rows.select("run_id", "tick", "elapsed", *scores, "valid", "healthy_part"), "fold-rows")
    return alerts.alert_fold(
        narrow, ["run_id"], wh.CLASSES, wh.HEALTHY, list(policies),
        valid=F.col("valid") if gap else None, healthy_part=F.col("healthy_part"), **kwargs,
    )


def fault_runs(spark, sf):
    return wh.runs(spark, sf).withColumnRenamed("class_label", "fault_class").filter(F.col("fault_start").isNotNull())


def healthy_events(events, spark, sf):
    starts = wh.runs(spark, sf).select("run_id", "fault_start")
    return events.join(starts, "run_id").filter(
        F.col("fault_start").isNull() | (F.col("elapsed") < F.col("fault_start"))
    ).drop("fault_start")


EVENT_COLUMNS = ["run_id", "pos", "elapsed", "event_type", "from_state", "to_state", "fault_class"]


@query("W18_alert_state_machine", "SELECT * FROM events_all", ("events_all",))
def w18(spark, sf):
    return alerts.events_of(folded(spark, sf)).select(*EVENT_COLUMNS)


@query("W18_alert_state_machine_gaps", "SELECT * FROM events_all_gap", ("events_all_gap",))
def w18g(spark, sf):
    return alerts.events_of(folded(spark, sf, gap=True)).select(*EVENT_COLUMNS)


@query(
    "W18_alert_row_states",
    """SELECT run_id, CASE WHEN NOT valid THEN 'insufficient_data' WHEN conf <> '' THEN 'confirmed_' || conf WHEN cand <> '' THEN 'pending_' || cand ELSE 'N' END AS state,
       count(*) AS rows FROM fold_gap WHERE tick > 0 GROUP BY 1, 2""",
    ("fold_gap",),
)
def w18s(spark, sf):
    states = folded(spark, sf, gap=True, row_states=True).filter(F.col("kind") == "state")
    return states.groupBy("run_id", F.col("to_state").alias("state")).agg(F.count(F.lit(1)).alias("rows"))


@query("W19_episodes", "SELECT * FROM episodes", ("episodes",))
def w19(spark, sf):
    out = cut_lineage(folded(spark, sf))
    events = healthy_events(alerts.events_of(out), spark, sf)
    return alerts.episodes(events, alerts.segments_of(out, ["run_id"]), ["run_id"]).drop("policy_id")


DETECTION = """SELECT run_id, fault_class, correct_class_detected, correct_class_latency, any_fault_detected, any_fault_latency, first_class,
  coalesce(any_fault_detected AND first_class <> fault_class AND (NOT correct_class_detected OR any_fault_latency < correct_class_latency), false) AS wrong_class_first,
  class_at_onset IS NOT NULL AS confirmed_at_onset, class_at_onset
FROM (SELECT r.run_id, r.class_label AS fault_class, count(e.pos) FILTER (post AND e.fault_class = r.class_label) > 0 AS correct_class_detected,
    min(e.elapsed) FILTER (post AND e.fault_class = r.class_label) - any_value(r.fault_start) AS correct_class_latency,
    count(e.pos) FILTER (post) > 0 AS any_fault_detected, min(e.elapsed) FILTER (post) - any_value(r.fault_start) AS any_fault_latency,
    min_by(e.fault_class, e.pos) FILTER (post) AS first_class,
    nullif(max_by(CASE WHEN event_type = 'cleared' THEN '' ELSE e.fault_class END, e.pos) FILTER (e.elapsed < r.fault_start), '') AS class_at_onset
  FROM runs r LEFT JOIN (SELECT e.*, e.elapsed >= r2.fault_start AND event_type <> 'cleared' AS post FROM {ev} e JOIN runs r2 USING (run_id)) e ON e.run_id = r.run_id
  WHERE r.fault_start IS NOT NULL GROUP BY r.run_id, r.class_label)"""
relation("detection", DETECTION.format(ev="events_all"), "events_all", "runs")
relation("detection_gap", DETECTION.format(ev="events_all_gap"), "events_all_gap", "runs")


@query("W20_run_detection", "SELECT * FROM detection", ("detection",))
def w20(spark, sf):
    events = alerts.events_of(folded(spark, sf))
    return alerts.run_detection(events, fault_runs(spark, sf)).drop("policy_id")


FALSE = """SELECT (SELECT count(*) FROM episodes{s}) AS false_confirmed_event_count, sum(alarmed_rows)::BIGINT AS false_anomalous_row_count,
  round(sum({h}) * 10.0 / 3600.0, 9)::DOUBLE AS healthy_hours,
  round((SELECT count(*) FROM episodes{s}) / (sum({h}) * 10.0 / 3600.0), 9)::DOUBLE AS events_per_healthy_hour,
  round((SELECT avg("end" - start) FROM episodes{s}), 6)::DOUBLE AS mean_duration, (SELECT max("end" - start) FROM episodes{s})::DOUBLE AS max_duration,
  (SELECT count(DISTINCT run_id) FROM episodes{s}) AS healthy_runs_with_alert, count(*) AS segments FROM segments{s}"""


def rounded_false(out):
    return out.withColumns(
        {
            "healthy_hours": F.round("healthy_hours", 9),
            "events_per_healthy_hour": F.round("events_per_healthy_hour", 9),
            "mean_duration": F.round("mean_duration", 6),
        }
    ).drop("policy_id")


def false_alerts(spark, sf, gap):
    out = cut_lineage(folded(spark, sf, gap=gap))
    segments = alerts.segments_of(out, ["run_id"])
    found = alerts.episodes(healthy_events(alerts.events_of(out), spark, sf), segments, ["run_id"])
    return rounded_false(alerts.false_alert_summary(found, segments, gap_aware=gap))


@query("A31_false_alert_summary", FALSE.format(s="", h="rows"), ("episodes", "segments"))
def a31(spark, sf):
    return false_alerts(spark, sf, False)


@query("A31_false_alert_summary_gaps", FALSE.format(s="_gap", h="valid_rows"), ("episodes_gap", "segments_gap"))
def a31g(spark, sf):
    return false_alerts(spark, sf, True)


relation(
    "sequence_islands",
    """SELECT run_id, predicted, min(elapsed) AS start, max(elapsed) + 10.0 AS "end", count(*) AS n FROM (
       SELECT *, tick - row_number() OVER (PARTITION BY run_id, predicted ORDER BY tick) AS g FROM diagnosed_rows WHERE healthy_part) GROUP BY run_id, predicted, g""",
    "diagnosed_rows",
)


@query(
    "A32_row_sequence_false_alerts",
    """SELECT count(*) AS episodes, count(*) FILTER (n >= 3) AS false_confirmed_event_count, sum(n)::BIGINT AS false_anomalous_row_count,
       round(avg("end" - start) FILTER (n >= 3), 6)::DOUBLE AS mean_duration, (max("end" - start) FILTER (n >= 3))::DOUBLE AS max_duration,
       count(DISTINCT run_id) FILTER (n >= 3) AS healthy_runs_with_alert,
       (SELECT round(count(*) * 10.0 / 3600.0, 9) FROM diagnosed_rows WHERE healthy_part)::DOUBLE AS healthy_hours,
       round(count(*) FILTER (n >= 3) / (SELECT count(*) * 10.0 / 3600.0 FROM diagnosed_rows WHERE healthy_part), 9)::DOUBLE AS events_per_healthy_hour
       FROM sequence_islands WHERE predicted <> 'N'""",
    ("sequence_islands",),
)
def a32(spark, sf):
    rows = evaluated(spark, sf).filter("healthy_part")
    return rounded_false(alerts.row_sequence_false_alerts(rows, 3, wh.HEALTHY))


@query(
    "A33_detection_summary",
    """SELECT count(*) AS fault_runs, count(*) FILTER (NOT correct_class_detected) AS correct_class_missed, count(*) FILTER (NOT any_fault_detected) AS any_fault_missed,
       count(*) FILTER (wrong_class_first) AS wrong_class_runs,
       round(count(*) FILTER (correct_class_latency <= 30) / count(*)::DOUBLE, 9) AS within_30s, round(count(*) FILTER (correct_class_latency <= 60) / count(*)::DOUBLE, 9) AS within_60s,
       round(count(*) FILTER (correct_class_latency <= 120) / count(*)::DOUBLE, 9) AS within_120s, round(count(*) FILTER (correct_class_latency <= 240) / count(*)::DOUBLE, 9) AS within_240s,
       quantile_cont(correct_class_latency, 0.5) AS median_latency FROM detection""",
    ("detection",),
)
def a33(spark, sf):
    detected = cut_lineage(alerts.run_detection(alerts.events_of(folded(spark, sf)), fault_runs(spark, sf)))
    out = alerts.detection_summary(detected).drop("policy_id")
    return out.withColumns({c: F.round(c, 9) for c in out.columns if c.startswith("within")})


@query(
    "A34_missed_fraction_by_class",
    """SELECT fault_class, count(*) AS runs, round(avg(CASE WHEN any_fault_detected THEN 0.0 ELSE 1.0 END), 9)::DOUBLE AS any_missed_fraction,
       round(avg(CASE WHEN correct_class_detected THEN 0.0 ELSE 1.0 END), 9)::DOUBLE AS correct_missed_fraction FROM detection GROUP BY 1""",
    ("detection",),
)
def a34(spark, sf):
    detected = alerts.run_detection(alerts.events_of(folded(spark, sf)), fault_runs(spark, sf))
    out = alerts.missed_fraction_by_class(detected)
    return out.withColumns({c: F.round(c, 9) for c in out.columns if c.endswith("fraction")})


@query(
    "W16_first_qualifying_detection",
    """SELECT r.run_id, r.class_label AS fault_class, t IS NOT NULL AS detected, t - r.fault_start AS latency FROM runs r LEFT JOIN (
         SELECT run_id, min(elapsed) AS t FROM (SELECT run_id, elapsed, row_number() OVER (PARTITION BY run_id, g ORDER BY tick) AS k FROM (
           SELECT *, tick - row_number() OVER (PARTITION BY run_id ORDER BY tick) AS g FROM diagnosed_rows WHERE predicted = fault_class AND elapsed >= fault_start)) WHERE k = 3 GROUP BY run_id) d USING (run_id)
       WHERE r.fault_start IS NOT NULL""",
    ("diagnosed_rows",),
)
def w16(spark, sf):
    rows = evaluated(spark, sf).filter(F.col("fault_start").isNotNull())
    return alerts.first_qualifying_detection(rows, 3)


@query(
    "W17_false_alarm_events",
    """SELECT r.run_id, count(*) FILTER (predicted <> 'N' AND n >= 3) AS false_alarm_events, sum(n)::BIGINT AS rows FROM sequence_islands r GROUP BY r.run_id""",
    ("sequence_islands",),
)
def w17(spark, sf):
    rows = evaluated(spark, sf).filter("healthy_part")
    # the healthy part is a prefix of every run, so ticks stay consecutive
    return alerts.false_alarm_events(rows, 3, wh.HEALTHY)


@query(
    "W15_longest_streak",
    """SELECT run_id, max(n) AS longest_streak FROM (SELECT run_id, count(*) AS n FROM (
         SELECT run_id, tick - row_number() OVER (PARTITION BY run_id ORDER BY tick) AS g FROM diagnosed_rows WHERE NOT valid) GROUP BY run_id, g) GROUP BY run_id""",
    ("diagnosed_rows",),
)
def w15(spark, sf):
    rejected = evaluated(spark, sf).filter(~F.col("valid"))
    return alerts.longest_streak(rejected, ["run_id"])


relation("grid", "SELECT row_number() OVER () - 1 AS pid, ep, en, xp, xn FROM (SELECT * FROM (VALUES (0.40::DOUBLE), (0.50), (0.60), (0.70)) a(ep), (VALUES (2), (3), (4)) b(en), (VALUES (0.50::DOUBLE), (0.60), (0.70)) c(xp), (VALUES (2), (3)) d(xn) ORDER BY ep, en, xp, xn)")
relation("validation_rows", "SELECT * FROM diagnosed_rows WHERE split = 'validation'", "diagnosed_rows")
relation(
    "fold_grid",
    "RECURSIVE_ " + fold_sql("ep", "en", "xp", "xn", source="validation_rows", grid="grid").replace("_self_", "fold_grid").replace(
        "s.confidence >= ep", "s.confidence >= f.ep"
    ),
    "validation_rows",
    "grid",
)
relation(
    "search",
    """WITH ev AS (SELECT pid, run_id, tick AS pos, elapsed, ev AS event_type, CASE WHEN conf = '' THEN before ELSE conf END AS fault_class FROM fold_grid WHERE ev IS NOT NULL),
     seg AS (SELECT pid, run_id, count(*) AS rows, count(*) FILTER (conf <> '' OR cand <> '') AS alarmed, max(elapsed) + 10.0 AS segment_end FROM fold_grid WHERE part GROUP BY 1, 2),
     ep AS (SELECT e.pid, e.run_id, coalesce(nxt, segment_end) - elapsed AS duration FROM (SELECT *, lead(elapsed) OVER (PARTITION BY pid, run_id ORDER BY pos) AS nxt FROM (
        SELECT e.* FROM ev e JOIN runs r USING (run_id) WHERE r.fault_start IS NULL OR e.elapsed < r.fault_start)) e JOIN seg USING (pid, run_id) WHERE event_type <> 'cleared'),
     det AS (SELECT g.pid, r.run_id, min(e.elapsed) FILTER (e.elapsed >= r.fault_start AND event_type <> 'cleared' AND e.fault_class = r.class_label) - any_value(r.fault_start) AS latency
        FROM grid g CROSS JOIN (SELECT * FROM runs WHERE fault_start IS NOT NULL AND split = 'validation') r LEFT JOIN ev e ON e.pid = g.pid AND e.run_id = r.run_id GROUP BY 1, 2),
     d AS (SELECT pid, count(*) AS fault_runs, count(*) FILTER (latency IS NULL) AS missed, quantile_cont(latency, 0.5) AS median_latency FROM det GROUP BY 1),
     f AS (SELECT pid, sum(rows) * 10.0 / 3600.0 AS hours FROM seg GROUP BY 1),
     x AS (SELECT pid, count(*) AS episodes, avg(duration) AS mean_duration, count(DISTINCT run_id) AS runs FROM ep GROUP BY 1)
     SELECT g.pid, d.missed, d.median_latency, round(coalesce(x.episodes, 0) / f.hours, 9)::DOUBLE AS rate, coalesce(x.runs, 0) AS runs, round(coalesce(x.mean_duration, 0), 9)::DOUBLE AS mean_duration,
       CASE WHEN d.missed > 1 THEN 'correct_class_missed' END AS rejection, en + xn AS complexity
     FROM grid g JOIN d USING (pid) JOIN f USING (pid) LEFT JOIN x USING (pid)""",
    "fold_grid",
    "runs",
    "grid",
)


@query(
    "T04_select_policy",
    """SELECT pid::INTEGER AS policy_id, missed AS correct_class_missed, median_latency, round(rate, 6) AS events_per_healthy_hour, runs AS healthy_runs_with_alert, round(mean_duration, 4) AS mean_duration, rejection,
       rejection IS NULL AND row_number() OVER (ORDER BY rejection IS NOT NULL, rate, runs, mean_duration, median_latency NULLS LAST, complexity, pid) = 1 AS chosen FROM search""",
    ("search",),
)
def t04(spark, sf):
    return search_figures(policy_search(spark, sf))


def policy_search(spark, sf, grid=None, gap=False, baseline=None, any_fault=False):
    """Search over the validation runs; ``grid`` defaults to that of the plain search."""
    rows = evaluated(spark, sf).filter(F.col("split") == "validation")
    grid = alerts.policy_grid() if grid is None else grid
    runs = wh.runs(spark, sf).filter(F.col("split") == "validation").withColumnRenamed("class_label", "fault_class")
    return alerts.search_policies(folded(spark, sf, gap=gap, policies=grid, rows=rows), runs, grid, baseline, gap_aware=gap, check_any_fault=any_fault)


def search_figures(out):
    return out.select(
        "policy_id", "correct_class_missed", "median_latency", F.round("events_per_healthy_hour", 6).alias("events_per_healthy_hour"),
        "healthy_runs_with_alert", F.round("mean_duration", 4).alias("mean_duration"), "rejection", "chosen",
    )


@query(
    "J16_candidates_by_runs",
    """SELECT pid::INTEGER AS policy_id, run_id, count(*) FILTER (ev = 'new_alert') AS new_alerts, count(*) FILTER (ev = 'cleared') AS cleared FROM fold_grid WHERE ev IS NOT NULL GROUP BY 1, 2""",
    ("fold_grid",),
)
def j16(spark, sf):
    rows = evaluated(spark, sf).filter(F.col("split") == "validation")
    events = alerts.events_of(folded(spark, sf, policies=alerts.policy_grid(), rows=rows))
    return events.groupBy("policy_id", "run_id").agg(
        F.count_if(F.col("event_type") == "new_alert").alias("new_alerts"), F.count_if(F.col("event_type") == "cleared").alias("cleared")
    )


def searched(name: str, grid: str, fold: str) -> None:
    """Relations of a search over the grid relation ``grid``, gap-aware, with the any-fault gate and a baseline latency of 100 s."""
    relation(
        fold,
        "RECURSIVE_ " + fold_sql("ep", "en", "xp", "xn", valid="s.valid", source="validation_rows", grid=grid).replace("_self_", fold).replace("s.confidence >= ep", "s.confidence >= f.ep"),
        "validation_rows",
        grid,
    )
    relation(
        name,
        f"""WITH ev AS (SELECT pid, run_id, tick AS pos, elapsed, ev AS event_type, CASE WHEN conf = '' THEN before ELSE conf END AS fault_class FROM {fold} WHERE ev IS NOT NULL),
         seg AS (SELECT pid, run_id, count(*) FILTER (valid) AS rows, max(elapsed) + 10.0 AS segment_end FROM {fold} WHERE part GROUP BY 1, 2),
         ep AS (SELECT e.pid, e.run_id, coalesce(nxt, segment_end) - elapsed AS duration FROM (SELECT *, lead(elapsed) OVER (PARTITION BY pid, run_id ORDER BY pos) AS nxt FROM (
            SELECT e.* FROM ev e JOIN runs r USING (run_id) WHERE r.fault_start IS NULL OR e.elapsed < r.fault_start)) e JOIN seg USING (pid, run_id) WHERE event_type <> 'cleared'),
         det AS (SELECT g.pid, r.run_id, min(e.elapsed) FILTER (e.elapsed >= r.fault_start AND event_type <> 'cleared' AND e.fault_class = r.class_label) - any_value(r.fault_start) AS latency,
            count(*) FILTER (e.elapsed >= r.fault_start AND event_type <> 'cleared') AS seen
            FROM {grid} g CROSS JOIN (SELECT * FROM runs WHERE fault_start IS NOT NULL AND split = 'validation') r LEFT JOIN ev e ON e.pid = g.pid AND e.run_id = r.run_id GROUP BY 1, 2),
         d AS (SELECT pid, count(*) FILTER (latency IS NULL) AS missed, count(*) FILTER (seen = 0) AS missed_any, quantile_cont(latency, 0.5) AS median_latency FROM det GROUP BY 1),
         f AS (SELECT pid, sum(rows) * 10.0 / 3600.0 AS hours FROM seg GROUP BY 1),
         x AS (SELECT pid, count(*) AS episodes, avg(duration) AS mean_duration, count(DISTINCT run_id) AS runs FROM ep GROUP BY 1)
         SELECT g.pid, d.missed, d.median_latency, round(coalesce(x.episodes, 0) / f.hours, 9)::DOUBLE AS rate, coalesce(x.runs, 0) AS runs, round(coalesce(x.mean_duration, 0), 9)::DOUBLE AS mean_duration,
           CASE WHEN d.missed_any > 0 THEN 'any_fault_missed' WHEN d.missed > 1 THEN 'correct_class_missed' WHEN d.median_latency > 130 THEN 'latency' END AS rejection, en + xn AS complexity
         FROM {grid} g JOIN d USING (pid) JOIN f USING (pid) LEFT JOIN x USING (pid)""",
        fold,
        "runs",
        grid,
    )


relation(
    "robust_grid",
    "SELECT row_number() OVER () - 1 AS pid, ep, en, xp, xn FROM (SELECT * FROM (VALUES (0.50::DOUBLE), (0.55), (0.60), (0.65), (0.70)) a(ep), (VALUES (3), (4), (5)) b(en), (VALUES (0.45::DOUBLE), (0.50), (0.55), (0.60)) c(xp), (VALUES (2), (3)) d(xn) ORDER BY ep, en, xp, xn)",
)
searched("robust_search", "robust_grid", "fold_robust_grid")


@query(
    "T04_select_robust_policy",
    """SELECT pid::INTEGER AS policy_id, missed AS correct_class_missed, median_latency, round(rate, 6) AS events_per_healthy_hour, runs AS healthy_runs_with_alert, round(mean_duration, 4) AS mean_duration, rejection,
       rejection IS NULL AND row_number() OVER (ORDER BY rejection IS NOT NULL, rate, runs, mean_duration, median_latency NULLS LAST, complexity, pid) = 1 AS chosen FROM robust_search""",
    ("robust_search",),
)
def t04r(spark, sf):
    """The robust search: 120 candidates, gaps freeze the machine, no missed fault at all, and latency against a baseline."""
    baseline = spark.range(1).select(F.lit(100.0).alias("median_latency"))
    return search_figures(policy_search(spark, sf, alerts.robust_grid(), gap=True, baseline=baseline, any_fault=True))


THRESHOLDS = (0.40, 0.45, 0.50, 0.55, 0.60)  # the pseudo-probabilities rarely exceed 0.6
relation(
    "abstention_search",
    f"""WITH g AS (SELECT t, n FROM (VALUES {', '.join(f'({t}::DOUBLE)' for t in THRESHOLDS)}) a(t), (VALUES (2), (3), (4)) b(n)),
     d AS (SELECT run_id, tick, elapsed, fault_class, fault_start, healthy_part, t, CASE WHEN confidence >= t THEN predicted ELSE 'uncertain' END AS diagnosis FROM validation_rows, (SELECT DISTINCT t FROM g)),
     cov AS (SELECT t, avg((diagnosis <> 'uncertain')::INT) AS coverage, count(*) FILTER (healthy_part) * 10.0 / 3600.0 AS hours FROM d GROUP BY 1),
     hits AS (SELECT t, run_id, elapsed, row_number() OVER (PARTITION BY t, run_id, i ORDER BY tick) AS k FROM (
        SELECT *, tick - row_number() OVER (PARTITION BY t, run_id ORDER BY tick) AS i FROM d WHERE diagnosis = fault_class AND elapsed >= fault_start)),
     runs_ AS (SELECT DISTINCT run_id, fault_start FROM d WHERE fault_start IS NOT NULL),
     det AS (SELECT g.t, g.n, r.run_id, min(h.elapsed) FILTER (h.k = g.n) - any_value(r.fault_start) AS latency FROM g CROSS JOIN runs_ r LEFT JOIN hits h ON h.t = g.t AND h.run_id = r.run_id GROUP BY 1, 2, 3),
     missed AS (SELECT t, n, count(*) FILTER (latency IS NULL) AS missed, quantile_cont(latency, 0.5) AS median_latency FROM det GROUP BY 1, 2),
     isl AS (SELECT t, run_id, diagnosis, i, count(*) AS len FROM (
        SELECT *, row_number() OVER (PARTITION BY t, run_id ORDER BY tick) - row_number() OVER (PARTITION BY t, run_id, diagnosis ORDER BY tick) AS i FROM d WHERE healthy_part) GROUP BY 1, 2, 3, 4),
     alarms AS (SELECT g.t, g.n, count(*) FILTER (isl.len >= g.n AND diagnosis NOT IN ('N', 'uncertain')) AS events FROM g JOIN isl ON isl.t = g.t GROUP BY 1, 2)
     SELECT t AS threshold, n AS persistence, missed, median_latency, events / hours AS rate, coverage, missed > 1 AS rejected FROM g JOIN missed USING (t, n) JOIN alarms USING (t, n) JOIN cov USING (t)""",
    "validation_rows",
)


@query(
    "T04_select_threshold",
    """SELECT threshold, persistence, missed AS missed_runs, median_latency, round(rate, 6) AS false_alarms_per_healthy_hour, round(coverage, 9) AS coverage, rejected,
       row_number() OVER (ORDER BY rejected, rate, median_latency NULLS LAST, -coverage, threshold, persistence) = 1 AS chosen FROM abstention_search""",
    ("abstention_search",),
)
def t04t(spark, sf):
    """The search over confidence thresholds and persistence; where every candidate is rejected the best of them is taken."""
    from sensorloom.plans import evaluation

    rows = evaluated(spark, sf).filter(F.col("split") == "validation")
    out = evaluation.abstention_search(rows, "N", THRESHOLDS)
    return out.withColumns({"false_alarms_per_healthy_hour": F.round("false_alarms_per_healthy_hour", 6), "coverage": F.round("coverage", 9)})
