"""Shared SQL relations for the decision chain (comparison side)."""

from __future__ import annotations

from sensorloom.catalogue.registry import relation

BOUNDED = """
SELECT {k}, measurement_type, timestamp, id, value, unit,
  row_number() OVER (PARTITION BY {k}, measurement_type ORDER BY timestamp, id) AS pos,
  count(*) OVER (PARTITION BY {k}, measurement_type) AS n
FROM (SELECT *, row_number() OVER (PARTITION BY {k}, measurement_type ORDER BY timestamp DESC, id DESC) AS age FROM {src})
WHERE age <= {w}"""

TREND = """
SELECT *, CASE WHEN n < 8 THEN 'stable' WHEN abs(shift) <= 1e-9 THEN 'stable'
    WHEN spread <= 1e-9 THEN CASE WHEN shift > 0 THEN 'increasing' ELSE 'decreasing' END
    WHEN abs(shift) / spread < 0.8 THEN 'stable'
    WHEN shift > 0 THEN 'increasing' ELSE 'decreasing' END AS trend,
  CASE WHEN n >= 8 AND hi - lo > 60 THEN 'high' ELSE 'low' END AS variation
FROM (SELECT {k}, measurement_type, max(n) AS n,
    avg(value) FILTER (pos > n - n // 2) - avg(value) FILTER (pos <= n // 2) AS shift,
    stddev_pop(value) AS spread, max(value) AS hi, min(value) AS lo,
    min(timestamp) AS first_ts, min_by(id, timestamp) AS first_id, max(timestamp) AS last_ts,
    max(value) FILTER (pos = n) AS v1, max(value) FILTER (pos = n - 1) AS v2, max(value) FILTER (pos = n - 2) AS v3,
    max(unit) FILTER (pos = n) AS last_unit
  FROM {b} GROUP BY {k}, measurement_type)"""

REASONED = """
SELECT *, 35 + support + consistency + trend_consistency + sustained_bonus + penalties AS confidence,
  CASE WHEN contains(lower(assessment), 'increasing') OR contains(lower(assessment), 'unstable') THEN 'high' ELSE 'low' END AS priority,
  CASE WHEN contains(lower(assessment), 'increasing') OR contains(lower(assessment), 'unstable') THEN 'Investigate operational conditions'
    WHEN contains(lower(assessment), 'stable') THEN 'Continue monitoring' ELSE 'Maintain current operations' END AS recommendation,
  CASE WHEN contains(lower(assessment), 'increasing') THEN 'Operational assessment indicates increasing stress.'
    WHEN contains(lower(assessment), 'unstable') THEN 'Operational assessment indicates unstable conditions.'
    WHEN contains(lower(assessment), 'stable') THEN 'Operational conditions remain stable.'
    ELSE 'Operational conditions are improving.' END AS justification
FROM (SELECT *, CASE trend || '/' || variation
      WHEN 'increasing/low' THEN 'Increasing operational stress detected'
      WHEN 'increasing/high' THEN 'Rapidly increasing unstable operational conditions detected'
      WHEN 'stable/low' THEN 'Operational conditions stable'
      WHEN 'stable/high' THEN 'Highly unstable operating conditions detected'
      WHEN 'decreasing/low' THEN 'Operational conditions improving'
      ELSE 'Operational conditions remain unstable despite improvement' END
    || CASE WHEN has_contradictions THEN chr(10) || chr(10) || 'Cross-measurement inconsistencies detected.'
      WHEN has_correlations THEN chr(10) || chr(10) || 'Cross-measurement relationships detected.' ELSE '' END AS assessment,
    least(25, 8 * least(n_primary, 3)) AS support,
    CASE WHEN variation = 'low' AND NOT has_contradictions THEN 15 ELSE 5 END AS consistency,
    CASE WHEN trend = 'stable' THEN 8 WHEN variation = 'high' THEN 4 ELSE 12 END AS trend_consistency,
    CASE WHEN trend <> 'stable' AND monotonic_recent THEN 6 ELSE 0 END AS sustained_bonus,
    CASE WHEN has_contradictions THEN -12 ELSE 0 END + CASE WHEN has_unexpected THEN -6 ELSE 0 END AS penalties
  FROM (SELECT *, len(correlations) > 0 AS has_correlations, len(contradictions) > 0 AS has_contradictions,
      len(correlations) = 0 AND len(contradictions) > 0 AS has_unexpected,
      len(correlations) = 0 AND len(contradictions) = 0 AS has_indeterminate,
      CASE WHEN len(correlations) > 0 THEN 'expected' WHEN len(contradictions) > 0 THEN 'unexpected' ELSE 'indeterminate' END AS expectation
    FROM (SELECT p.*, obs_count, as_of,
        list_filter([CASE WHEN s['view'] = 'increasing' AND s['click'] = 'decreasing' THEN 'View increasing while click decreasing' END,
          CASE WHEN s['signup'] = 'increasing' AND s['purchase'] = 'decreasing' THEN 'Signup increasing while purchase decreasing' END,
          CASE WHEN s['error'] = 'increasing' AND s['purchase'] = 'decreasing' THEN 'Error increasing while purchase decreasing' END],
          lambda x: x IS NOT NULL) AS correlations,
        list_filter([CASE WHEN s['view'] = 'increasing' AND s['click'] = 'increasing' THEN 'View and click are increasing simultaneously.' END,
          CASE WHEN s['signup'] = 'increasing' AND s['purchase'] = 'increasing' THEN 'Signup and purchase are increasing simultaneously.' END,
          CASE WHEN s['error'] = 'increasing' AND s['purchase'] = 'increasing' THEN 'Error and purchase are increasing simultaneously.' END],
          lambda x: x IS NOT NULL) AS contradictions
      FROM (SELECT {k}, measurement_type AS primary_type, trend, variation, n AS n_primary, v1, v2, v3, last_unit,
          n >= 3 AND ((v3 <= v2 AND v2 <= v1) OR (v3 >= v2 AND v2 >= v1)) AS monotonic_recent
        FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY first_ts, first_id) AS rk FROM {t}) WHERE rk = 1) p
      JOIN (SELECT {k}, map_from_entries(list({{'k': measurement_type, 'v': trend}})) AS s, sum(n) AS obs_count,
            max(last_ts) AS as_of FROM {t} GROUP BY {k}) USING ({k}))
    WHERE obs_count >= 2 AND n_primary >= 2))"""


def chain(suffix: str, keys: str, source: str, needs: tuple[str, ...], window: int = 20) -> None:
    relation(f"bounded{suffix}", BOUNDED.format(k=keys, src=source, w=window), *needs)
    relation(f"trend{suffix}", TREND.format(k=keys, b=f"bounded{suffix}"), f"bounded{suffix}")
    relation(f"reasoned{suffix}", REASONED.format(k=keys, t=f"trend{suffix}"), f"trend{suffix}")


chain("", "asset_id", "obs", ("obs",))
relation(
    "batches",
    "SELECT *, (date_diff('day', TIMESTAMP '2024-01-01 00:00:00', date_trunc('day', timestamp)) // 10) AS batch FROM obs",
    "obs",
)
chain("_batch", "batch, asset_id", "batches", ("batches",))

DIAGNOSTICS = """
SELECT *, CASE WHEN n < 8 THEN 50 ELSE stab END AS stability_score,
  CASE WHEN n < 8 THEN 0 ELSE CAST(round_even(vol * 100, 0) AS INTEGER) END AS volatility_score,
  CASE WHEN n < 8 THEN 'stable' WHEN guess <> 'stable' AND stab < 55 THEN 'stable' ELSE guess END AS direction,
  CASE WHEN n < 8 THEN NULL WHEN guess <> 'stable' AND stab < 55 THEN CASE WHEN moves = 0 THEN 1.0 ELSE 0.6 END ELSE mono END AS monotonicity,
  CASE WHEN n < 8 THEN 0.0 ELSE rate END AS rate_of_change
FROM (SELECT *, CAST(greatest(0, least(100, round_even(100 * (0.65 * mono + 0.35 * (1.0 - vol)), 0))) AS INTEGER) AS stab
  FROM (SELECT *, CASE WHEN moves IS NULL THEN 1.0 WHEN guess = 'stable' THEN CASE WHEN moves = 0 THEN 1.0 ELSE 0.6 END
        WHEN moves = 0 THEN 0.8 WHEN guess = 'rising' THEN ups::DOUBLE / moves ELSE downs::DOUBLE / moves END::DOUBLE AS mono,
      CASE WHEN moves IS NULL THEN 0.0 ELSE greatest(0.0, least(1.0, sd / (abs(rate) + 1e-6))) END::DOUBLE AS vol
    FROM (SELECT {k}, measurement_type, max(n) AS n, stddev_pop(d) AS sd,
        (max(value) FILTER (pos = n) - max(value) FILTER (pos = 1)) / greatest(max(n) - 1, 1) AS rate,
        CASE WHEN abs(max(value) FILTER (pos = n) - max(value) FILTER (pos = 1)) <= 1e-9 THEN 'stable'
          WHEN max(value) FILTER (pos = n) > max(value) FILTER (pos = 1) THEN 'rising' ELSE 'falling' END AS guess,
        CASE WHEN max(n) > 1 THEN count(*) FILTER (abs(d) > 1e-12) END AS moves,
        count(*) FILTER (d > 1e-12) AS ups, count(*) FILTER (d < -1e-12) AS downs
      FROM (SELECT *, value - lag(value) OVER (PARTITION BY {k}, measurement_type ORDER BY pos) AS d FROM {b})
      GROUP BY {k}, measurement_type)))"""
relation("diagnosed", DIAGNOSTICS.format(k="asset_id", b="bounded"), "bounded")
relation("diagnosed_batch", DIAGNOSTICS.format(k="batch, asset_id", b="bounded_batch"), "bounded_batch")
relation("bounded8", BOUNDED.format(k="asset_id", src="obs", w=8), "obs")
relation("diagnosed8", DIAGNOSTICS.format(k="asset_id", b="bounded8"), "bounded8")

SENTENCE = """CASE WHEN n < 8 THEN {l} || ' has insufficient history for trend analysis.'
  WHEN direction = 'stable' AND volatility_score >= 60 THEN {l} || ' stayed within a narrow range but was noisy across the last ' || n || ' observations.'
  WHEN direction = 'stable' THEN {l} || ' remained stable across the last ' || n || ' observations.'
  WHEN monotonicity >= 0.85 AND stability_score >= 70 THEN {l} || CASE direction WHEN 'rising' THEN ' increased' ELSE ' decreased' END
    || ' steadily across the last ' || n || ' observations.'
  ELSE {l} || CASE direction WHEN 'rising' THEN ' increased' ELSE ' decreased' END
    || CASE WHEN volatility_score >= 45 THEN ' with variability' ELSE ' gradually' END || ' across the last ' || n || ' observations.' END"""
