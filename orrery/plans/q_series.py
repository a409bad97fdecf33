"""Time-series queries on ``events`` (W1-W5, W9, T5-T10, A5, A8, A11, A15, Q-F, Q-M, Q-Q).

``events`` is read as a per-user telemetry log: the event type gives a
control state, ``floor(value)`` and ``props.k`` are two weekly counters and
the (type, value) pair is a one-entry conflict-progress map.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.functions import json as J
from orrery.functions.timefns import seconds_between
from orrery.operators.timeseries import (
    bucket_counts,
    bucket_first_delta,
    clean_counter_series,
    fix_control_progress,
    lookback_rates,
    state_sessions,
    with_deltas,
)
from orrery.operators.chunked import day_chunk
from orrery.plans.catalog import ORACLES, register
from orrery.sources.tables import table


def state_of(et):
    """Control state implied by an event type (NULL for signups)."""
    return (
        F.when(et == "view", "Unoccupied")
        .when(et == "signup", F.lit(None))
        .when(et == "purchase", "Fortified")
        .otherwise("Exploited")
    )


def series_log(spark, sf):
    ev = table(spark, sf, "events")
    et = F.col("event_type")
    state = state_of(et)
    return ev.select(
        "user_id",
        "ts",
        "event_id",
        state.alias("state"),
        F.floor("value").cast("int").alias("r"),
        J.text_field("props", "$.k", "int").alias("u"),
        F.when(et != "error", F.col("value") * 30).alias("control"),
        F.array(F.struct(et.alias("key"), F.col("value").alias("value"))).alias("progress"),
    )


_OBS_SQL = """
  SELECT user_id, ts, event_type, value, raw, coalesce(raw, 'Unoccupied') AS state, r, u, control,
         row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n
  FROM (SELECT *, CAST(floor(value) AS INTEGER) AS r, CAST(json_extract_string(props, '$.k') AS INTEGER) AS u,
               if(event_type <> 'error', value * 30, NULL) AS control
        FROM events LEFT JOIN (VALUES ('view', 'Unoccupied'), ('purchase', 'Fortified'), ('click', 'Exploited'),
                                      ('error', 'Exploited')) s(event_type, raw) USING (event_type)) e
"""

# The weeks since the first reset after the epoch (a Thursday, 07:00).
_WEEK = "((epoch_us({0}.ts) - 25200000000) // 604800000000)"
# The literal formula's tick for a previous row, and whether it lies between both rows.
_LIT = "(604800000000 * ((epoch_us(p.ts) - 111600000000) // 604800000000) + 630000000000)"


def _clean_sql(parity: bool) -> str:
    """The cleaning as two passes of joins with the row before: the rules as
    stated in the operator, over one-entry progress maps, which grow when type
    and sign of the change say so."""
    if parity:
        tick = f"(epoch_us(c.ts) >= {_LIT} AND epoch_us(p.ts) < {_LIT})"
        known = "raw NOT IN ('Fortified', 'Exploited', 'Stronghold') OR control IS NOT NULL"
        first = f"""c.state <> 'Unoccupied' OR p.raw <> 'Unoccupied' OR (c.event_type = p.event_type AND c.value > p.value)
                    OR (c.r >= p.r AND c.u >= p.u) OR {tick}"""
        second = f"c.state = 'Unoccupied' OR (c.r > p.r AND c.u > p.u) OR {tick} OR c.ts > p.ts + INTERVAL 1 HOUR"
    else:
        tick = f"{_WEEK.format('c')} > {_WEEK.format('p')}"
        known = "state NOT IN ('Fortified', 'Exploited', 'Stronghold') OR control IS NOT NULL"
        first = f"""p.n IS NULL OR {tick} OR if(c.state = 'Unoccupied' AND p.state = 'Unoccupied',
                      c.event_type = p.event_type AND c.value > p.value,
                      NOT coalesce((c.r < p.r AND c.u IS NOT NULL AND p.u IS NOT NULL)
                                   OR (c.u < p.u AND c.r IS NOT NULL AND p.r IS NOT NULL), false))"""
        second = f"""c.state = 'Unoccupied' OR p.n IS NULL OR {tick} OR c.ts > p.ts + INTERVAL 1 HOUR
                     OR coalesce(c.r <> p.r OR c.u <> p.u, true)"""
    return f"""
    WITH obs AS (SELECT * REPLACE (row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n) FROM ({_OBS_SQL}) WHERE {known}),
    fresh AS (
      SELECT c.* REPLACE (row_number() OVER (PARTITION BY c.user_id ORDER BY c.ts) AS n)
      FROM obs c LEFT JOIN obs p ON p.user_id = c.user_id AND p.n = c.n - 1 WHERE {first}),
    caps(state, cap) AS (VALUES ('Exploited', 349999), ('Fortified', 650000), ('Stronghold', 1000000))
    SELECT c.user_id, c.ts, c.state, c.r AS reinforcement, c.u AS undermining,
           if(c.control > 1000, c.control - 4294967296 / cap, c.control) AS control_progress
    FROM fresh c LEFT JOIN fresh p ON p.user_id = c.user_id AND p.n = c.n - 1 LEFT JOIN caps ON caps.state = c.state
    WHERE {second}
    """


_CLEAN_SQL = _clean_sql(False)


def _clean(spark, sf, parity):
    log = series_log(spark, sf)
    out = clean_counter_series(
        log, key="user_id", ts="ts", state="state", r="r", u="u",
        progress="progress", control="control", parity=parity,
    )
    return out.select(
        "user_id", "ts", "state",
        F.col("r").alias("reinforcement"),
        F.col("u").alias("undermining"),
        fix_control_progress("control", "state").alias("control_progress"),
    )


@register(
    "clean_series",
    oracle=_CLEAN_SQL,
    headline=True,
)
def clean_series(spark, sf):
    return _clean(spark, sf, parity=False)


@register(
    "clean_series_parity",
    oracle=_clean_sql(True),
)
def clean_series_parity(spark, sf):
    return _clean(spark, sf, parity=True)


@register(
    "lag_deltas",
    oracle="""
    SELECT user_id, event_id, ts,
           value - lag(value) OVER w AS d_value,
           (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 AS gap_s
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
    """,
)
def lag_deltas(spark, sf):
    """W1/W2 per user, skew-safe: windows per (user, day) with carried
    boundary rows, so a user holding most events still spreads over tasks."""
    ev = table(spark, sf, "events").select("user_id", "event_id", "ts", "value")
    out = with_deltas(ev, ["user_id"], ["ts", "event_id"], ["value"], chunk=day_chunk("ts"), lag_cols=["ts"])
    return out.select(
        "user_id", "event_id", "ts", "d_value",
        seconds_between(F.col("prev_ts"), F.col("ts")).alias("gap_s"),
    )


@register(
    "rolling_8h_rate",
    oracle="""
    WITH s AS (
      SELECT user_id, ts, event_id, CAST(floor(value) AS INTEGER) AS r,
             CAST(json_extract_string(props, '$.k') AS INTEGER) AS u
      FROM events),
    f AS (
      SELECT *,
             arg_min(epoch_us(ts), (epoch_us(ts), event_id)) OVER w AS t0,
             arg_min(CAST(coalesce(r, 0) AS DOUBLE), (epoch_us(ts), event_id)) OVER w AS r0,
             arg_min(CAST(coalesce(u, 0) AS DOUBLE), (epoch_us(ts), event_id)) OVER w AS u0
      FROM s
      WINDOW w AS (PARTITION BY user_id ORDER BY ts
                   RANGE BETWEEN INTERVAL 8 HOURS PRECEDING AND CURRENT ROW))
    SELECT user_id, ts, event_id, r, u,
           CASE WHEN epoch_us(ts) - t0 <> 0 THEN CAST(floor((CAST(coalesce(r, 0) AS DOUBLE) - r0)
                / ((epoch_us(ts) - t0) / CAST(3600000000 AS DOUBLE)) + 0.5) AS BIGINT) END AS r_rate,
           CASE WHEN epoch_us(ts) - t0 <> 0 THEN CAST(floor((CAST(coalesce(u, 0) AS DOUBLE) - u0)
                / ((epoch_us(ts) - t0) / CAST(3600000000 AS DOUBLE)) + 0.5) AS BIGINT) END AS u_rate
    FROM f
    """,
    headline=True,
)
def rolling_8h_rate(spark, sf):
    log = series_log(spark, sf).select("user_id", "ts", "event_id", "r", "u")
    return lookback_rates(log, ["user_id"], "ts", {"r_rate": "r", "u_rate": "u"}, tiebreak="event_id")


@register(
    "state_sessions",
    oracle="""
    WITH seq AS (
      SELECT user_id, ts, value, event_type, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n
      FROM events),
    starts AS (
      SELECT c.user_id, c.n, row_number() OVER (PARTITION BY c.user_id ORDER BY c.n) AS session_id
      FROM seq c LEFT JOIN seq p ON p.user_id = c.user_id AND p.n = c.n - 1 WHERE c.bad AND NOT coalesce(p.bad, false)),
    members AS (
      SELECT c.*, if(c.bad AND NOT nx.bad, c.ts, NULL) AS closing
      FROM seq c LEFT JOIN seq p ON p.user_id = c.user_id AND p.n = c.n - 1
                 LEFT JOIN seq nx ON nx.user_id = c.user_id AND nx.n = c.n + 1
      WHERE c.bad OR p.bad)
    SELECT m.user_id, s.session_id, min(m.ts) AS start_ts, max(closing) AS end_ts, count(*) AS n_rows,
           round(avg(m.value), 6) AS avg_measure, string_agg(DISTINCT m.event_type, ',' ORDER BY m.event_type) AS labels,
           (epoch_us(max(closing)) - epoch_us(min(m.ts))) / 1e6 AS duration_s
    FROM members m ASOF JOIN starts s ON s.user_id = m.user_id AND m.n >= s.n
    GROUP BY m.user_id, s.session_id
    """,
    headline=True,
)
def state_sessions_q(spark, sf):
    ev = table(spark, sf, "events")
    out = state_sessions(ev, ["user_id"], "ts", F.col("event_type") == "error", "value", "event_type")
    return out.withColumn("avg_measure", F.round("avg_measure", 6))


@register(
    "hourly_buckets",
    oracle="""
    SELECT date_trunc('hour', ts) AS bucket, count(*) AS n_events,
           count(DISTINCT (user_id, event_type)) AS n_pairs,
           count(DISTINCT user_id) AS n_entities,
           array_to_string(list_sort(array_agg(DISTINCT event_type)), ',') AS labels
    FROM events GROUP BY 1
    """,
)
def hourly_buckets(spark, sf):
    ev = table(spark, sf, "events")
    return bucket_counts(ev, "ts", "user_id", "event_type")


@register(
    "hourly_first_delta",
    oracle="""
    WITH h AS (
      SELECT event_type, date_trunc('hour', ts) AS bucket,
             arg_min(value, (ts, event_id)) FILTER (WHERE value IS NOT NULL) AS first_value,
             count(*) AS n_events
      FROM events GROUP BY 1, 2)
    SELECT *, first_value - lag(first_value) OVER (PARTITION BY event_type ORDER BY bucket) AS delta
    FROM h
    """,
)
def hourly_first_delta(spark, sf):
    ev = table(spark, sf, "events")
    return bucket_first_delta(ev, ["event_type"], "ts", "value", tiebreak="event_id")


def catalog_oracle(name: str) -> str:
    return ORACLES[name]


# Skew-safe variants: the same results with windows partitioned by (user,
# day) and carried boundaries, so no single entity is confined to one task.

@register("clean_series_chunked", oracle=_CLEAN_SQL)
def clean_series_chunked(spark, sf):
    log = series_log(spark, sf)
    out = clean_counter_series(
        log, key="user_id", ts="ts", state="state", r="r", u="u",
        progress="progress", control="control", chunk=day_chunk("ts"),
    )
    return out.select(
        "user_id", "ts", "state",
        F.col("r").alias("reinforcement"),
        F.col("u").alias("undermining"),
        fix_control_progress("control", "state").alias("control_progress"),
    )


@register("rolling_8h_rate_chunked", oracle=catalog_oracle("rolling_8h_rate"))
def rolling_8h_rate_chunked(spark, sf):
    log = series_log(spark, sf).select("user_id", "ts", "event_id", "r", "u")
    return lookback_rates(log, ["user_id"], "ts", {"r_rate": "r", "u_rate": "u"}, tiebreak="event_id",
                          chunk_of=lambda c: F.date_trunc("day", c))


@register("state_sessions_chunked", oracle=catalog_oracle("state_sessions"))
def state_sessions_chunked(spark, sf):
    ev = table(spark, sf, "events")
    out = state_sessions(ev, ["user_id"], "ts", F.col("event_type") == "error", "value", "event_type",
                         chunk=day_chunk("ts"))
    return out.withColumn("avg_measure", F.round("avg_measure", 6))
