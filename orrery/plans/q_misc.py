"""Scalar, filter, aggregate and reporting queries on the driver tables
(P1, P5, P10, F7-F13, X1-X4, X9, X21, A6, A7, O1-O5, S10, K14, T7, T8,
Q-G, Q-H, Q-K, Q-U, Q-V, Q-W, Q-AB, Q-AC)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from orrery.functions import json as J
from orrery.functions.timefns import cycle_start
from orrery.functions.validate import enum_reason
from orrery.operators.latest import latest_row, latest_state
from orrery.operators.nested import explode_col, inline_rows
from orrery.operators.rules import ACQUISITION_THRESHOLD, CONFLICT_THRESHOLD, control_score
from orrery.plans.catalog import register
from orrery.plans.q_merge import _feeds
from orrery.plans.q_nested import system_docs
from orrery.plans.q_series import state_of
from orrery.sinks.retention import retention_report
from orrery.sources.coverage import coverage
from orrery.sources.tables import table

# The event types and languages the driver data may contain.
EVENT_TYPES = ["click", "view", "purchase", "signup"]
LANGS = ["en", "de", "fr"]


@register(
    "json_extract",
    oracle="""
    SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
           json_extract_string(props, '$.k') AS k_text,
           json_extract_string(props, '$.missing') AS missing
    FROM events
    """,
)
def json_extract(spark, sf):
    """Parse the JSON text once, then typed field extraction."""
    ev = table(spark, sf, "events").select("event_id", J.parse("props").alias("doc"))
    return ev.select(
        "event_id",
        J.field("doc", "$.k", "int").alias("k"),
        J.field("doc", "$.k", "string").alias("k_text"),
        J.field("doc", "$.missing", "string").alias("missing"),
    )


@register(
    "domain_drift",
    oracle="""
    SELECT 'events.event_type' AS field, event_type AS value, count(*) AS n
    FROM events WHERE event_type NOT IN ('click', 'view', 'purchase', 'signup') AND event_type <> ''
    GROUP BY event_type
    UNION ALL
    SELECT 'documents.lang' AS field, lang AS value, count(*) AS n
    FROM documents WHERE lang NOT IN ('en', 'de', 'fr') AND lang <> ''
    GROUP BY lang
    """,
)
def domain_drift(spark, sf):
    """Q-AB/V1 (keep policy): values outside the declared domain, with counts."""
    ev = table(spark, sf, "events")
    docs = table(spark, sf, "documents")
    a = (ev.filter(enum_reason("event_type", EVENT_TYPES).isNotNull())
         .groupBy(F.col("event_type").alias("value")).agg(F.count(F.lit(1)).alias("n"))
         .select(F.lit("events.event_type").alias("field"), "value", "n"))
    b = (docs.filter(enum_reason("lang", LANGS).isNotNull())
         .groupBy(F.col("lang").alias("value")).agg(F.count(F.lit(1)).alias("n"))
         .select(F.lit("documents.lang").alias("field"), "value", "n"))
    return a.unionByName(b)


@register(
    "prefix_search",
    oracle="""
    SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE 'red%'
    ORDER BY p_name, p_partkey LIMIT 20
    """,
)
def prefix_search(spark, sf, prefix="Red"):
    """F8/O2: case-insensitive prefix search, deterministic order, 20 rows."""
    p = table(spark, sf, "part")
    return (p.filter(F.lower("p_name").startswith(prefix.lower()))
            .select("p_partkey", "p_name").orderBy("p_name", "p_partkey").limit(20))


def facet_filter(df, economy=None, min_size=None, max_size=None, brand=None):
    """optional predicates; ``None`` means "any" (no constraint)."""
    cond = F.lit(True)
    if economy is not None:
        cond = cond & (F.col("p_type") == economy)
    if min_size is not None:
        cond = cond & (F.col("p_size") >= min_size)
    if max_size is not None:
        cond = cond & (F.col("p_size") <= max_size)
    if brand is not None:
        cond = cond & (F.col("p_brand") == brand)
    return df.filter(cond)


@register(
    "facet_filter",
    oracle="""
    SELECT p_partkey, p_name, p_type, p_size FROM part
    WHERE p_type = 'ECONOMY' AND p_size >= 10 AND p_size <= 30
    """,
)
def facet_filter_q(spark, sf):
    p = table(spark, sf, "part")
    return facet_filter(p, economy="ECONOMY", min_size=10, max_size=30).select(
        "p_partkey", "p_name", "p_type", "p_size")


@register(
    "coverage",
    oracle="""
    SELECT event_type, min(date_trunc('day', ts)) AS first_day, max(date_trunc('day', ts)) AS last_day,
           count(DISTINCT date_trunc('day', ts)) AS n_days, count(*) AS n_rows
    FROM events GROUP BY event_type
    """,
)
def coverage_q(spark, sf):
    """first/last day and distinct days per event type."""
    return coverage(table(spark, sf, "events"), "event_type", "ts")


# Retention in days per event type (others kept 30 days).
RETENTION = {"view": 7, "click": 14}


@register(
    "retention",
    oracle="""
    WITH a AS (SELECT max(ts) AS as_of FROM events),
    e AS (SELECT event_type, strlen(props) AS octets,
                 ts >= as_of - to_days(CASE event_type WHEN 'view' THEN 7 WHEN 'click' THEN 14 ELSE 30 END)
                   AS keep
          FROM events, a)
    SELECT event_type, count(*) FILTER (WHERE keep) AS kept, count(*) FILTER (WHERE NOT keep) AS dropped,
           CAST(coalesce(sum(octets) FILTER (WHERE keep), 0) AS BIGINT) AS kept_bytes,
           CAST(coalesce(sum(octets) FILTER (WHERE NOT keep), 0) AS BIGINT) AS dropped_bytes
    FROM e GROUP BY event_type
    """,
)
def retention_q(spark, sf):
    """K14 dry run: rows and bytes kept / dropped per type as of the newest event."""
    ev = table(spark, sf, "events")
    as_of = ev.agg(F.max("ts")).scalar()
    return retention_report(ev, "event_type", "ts", RETENTION, as_of, default_days=30,
                            size=F.octet_length("props"))


@register(
    "pivot_series",
    oracle="""
    SELECT user_id, date_trunc('day', ts) AS day,
           round(coalesce(sum(value) FILTER (WHERE event_type = 'click'), 0), 2) AS click,
           round(coalesce(sum(value) FILTER (WHERE event_type = 'error'), 0), 2) AS error,
           round(coalesce(sum(value) FILTER (WHERE event_type = 'purchase'), 0), 2) AS purchase,
           round(coalesce(sum(value) FILTER (WHERE event_type = 'signup'), 0), 2) AS signup,
           round(coalesce(sum(value) FILTER (WHERE event_type = 'view'), 0), 2) AS view
    FROM events GROUP BY user_id, date_trunc('day', ts)
    """,
)
def pivot_series(spark, sf):
    """Q-V: one series per type, 0 where absent (pivot with an explicit
    value list, so no extra job to discover the columns)."""
    ev = table(spark, sf, "events")
    types = ["click", "error", "purchase", "signup", "view"]
    day = F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")
    p = (ev.groupBy("user_id", day)
         .pivot("event_type", types).agg(F.sum("value")).fillna(0, subset=types))
    return p.select("user_id", "day", *[F.round(t, 2).alias(t) for t in types])


@register(
    "counts_by_state",
    oracle="""
    SELECT event_type, count(*) AS n_events, count(DISTINCT user_id) AS n_users,
           round(avg(value), 6) AS avg_value, min(ts) AS first_ts, max(ts) AS last_ts
    FROM events GROUP BY event_type
    """,
)
def counts_by_state(spark, sf):
    """Q-K/A6/A7."""
    ev = table(spark, sf, "events")
    return ev.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.countDistinct("user_id").alias("n_users"),
        F.round(F.avg("value"), 6).alias("avg_value"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )


@register(
    "weekly_cycles",
    oracle="""
    SELECT time_bucket(INTERVAL '7 days', ts, TIMESTAMP '1970-01-01 07:00:00') AS cycle_start,
           time_bucket(INTERVAL '7 days', ts, TIMESTAMP '1970-01-01 07:00:00') + INTERVAL '7 days' AS cycle_end,
           event_type, count(*) AS n, round(sum(value), 2) AS total
    FROM events GROUP BY ALL
    """,
)
def weekly_cycles(spark, sf):
    """Tumbling 7-day windows starting Thursday 07:00 UTC."""
    ev = table(spark, sf, "events")
    w = F.window("ts", "7 days", "7 days", "7 hours")
    return ev.groupBy(w.alias("w"), "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")
    ).select(F.col("w.start").alias("cycle_start"), F.col("w.end").alias("cycle_end"), "event_type", "n", "total")


@register(
    "cycle_snapshot",
    oracle="""
    WITH s AS (
      SELECT user_id, ts, event_id,
             CASE event_type WHEN 'view' THEN 'Unoccupied' WHEN 'signup' THEN NULL
                             WHEN 'purchase' THEN 'Fortified' ELSE 'Exploited' END AS state,
             CASE WHEN event_type <> 'error' THEN value / 500 END AS control
      FROM events),
    b AS (SELECT time_bucket(INTERVAL '7 days', max(ts), TIMESTAMP '1970-01-01 07:00:00') AS c0 FROM events),
    cyc AS (SELECT s.* FROM s, b WHERE ts >= c0 AND ts < c0 + INTERVAL '7 days'),
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn,
             count(*) OVER (PARTITION BY user_id) AS n_history
      FROM cyc)
    SELECT user_id, ts, coalesce(state, 'Unoccupied') AS state,
           CASE WHEN state IN ('Exploited', 'Fortified', 'Stronghold') THEN 'Power' || (user_id % 3)
                ELSE 'Uncontrolled' END AS power,
           CAST(floor(coalesce(control, 0) * CASE coalesce(state, 'Unoccupied') WHEN 'Fortified' THEN 650000
                WHEN 'Stronghold' THEN 1000000 ELSE 350000 END) AS BIGINT) AS control_score,
           n_history,
           CASE WHEN state IN ('Exploited', 'Fortified', 'Stronghold') THEN 0 ELSE 1 END AS power_last
    FROM ranked WHERE rn = 1
    """,
)
def cycle_snapshot(spark, sf):
    """Q-U: newest row per entity in the current weekly cycle (W6), with its
    history size, a control score (X21) and 'Uncontrolled' ordered last (O5)."""
    ev = table(spark, sf, "events")
    et = F.col("event_type")
    log = ev.select("user_id", "ts", "event_id", state_of(et).alias("state"),
                    F.when(et != "error", F.col("value") / 500).alias("control"))
    c0 = ev.agg(cycle_start(F.max("ts"))).scalar()
    cyc = log.filter((F.col("ts") >= c0) & (F.col("ts") < c0 + F.expr("INTERVAL 7 DAYS")))
    newest = latest_state(cyc, ["user_id"], "ts", tiebreak=["event_id"], extra_aggs={"n_history": F.count(F.lit(1))})
    occupied = F.col("state").isin("Exploited", "Fortified", "Stronghold")
    st = F.coalesce(F.col("state"), F.lit("Unoccupied"))
    return newest.select(
        "user_id", "ts", st.alias("state"),
        F.when(occupied, F.concat(F.lit("Power"), F.pmod("user_id", F.lit(3)).cast("string")))
        .otherwise("Uncontrolled").alias("power"),
        control_score(F.col("control"), st).cast("bigint").alias("control_score"),
        "n_history",
        F.when(occupied, 0).otherwise(1).alias("power_last"),
    )


@register(
    "conflict_ranking",
    oracle=f"""
    WITH p AS (SELECT user_id, event_type AS power, avg(value) / 500 AS progress
               FROM events GROUP BY user_id, event_type)
    SELECT user_id, power, round(progress, 9) AS progress,
           row_number() OVER (PARTITION BY user_id ORDER BY progress DESC, power) AS rank,
           CAST(floor(progress * {ACQUISITION_THRESHOLD}) AS BIGINT) AS points,
           floor(progress * {ACQUISITION_THRESHOLD}) >= {CONFLICT_THRESHOLD} AS over_conflict,
           floor(progress * {ACQUISITION_THRESHOLD}) >= {ACQUISITION_THRESHOLD} AS over_acquisition
    FROM p
    """,
)
def conflict_ranking(spark, sf):
    """Q-W: powers of each system ranked by conflict progress, points and
    threshold flags (X21)."""
    ev = table(spark, sf, "events")
    p = ev.groupBy("user_id", F.col("event_type").alias("power")).agg((F.avg("value") / 500).alias("progress"))
    w = Window.partitionBy("user_id").orderBy(F.col("progress").desc(), F.col("power"))
    pts = F.floor(F.col("progress") * ACQUISITION_THRESHOLD)
    return p.select(
        "user_id", "power", F.round("progress", 9).alias("progress"),
        F.row_number().over(w).cast("bigint").alias("rank"),
        pts.cast("bigint").alias("points"),
        (pts >= CONFLICT_THRESHOLD).alias("over_conflict"),
        (pts >= ACQUISITION_THRESHOLD).alias("over_acquisition"),
    )


@register(
    "settlements",
    oracle="""
    WITH d AS (
      SELECT user_id, dayname(ts) AS station, event_id AS market_id, value AS dist, props,
             row_number() OVER (PARTITION BY user_id, dayname(ts) ORDER BY ts DESC) AS rn
      FROM events WHERE event_type = 'purchase'),
    b AS (
      SELECT user_id, dayname(ts) AS station, props AS body_name,
             row_number() OVER (PARTITION BY user_id, dayname(ts) ORDER BY ts DESC) AS rn
      FROM events WHERE event_type = 'click')
    SELECT d.user_id, d.station, d.market_id, coalesce(b.body_name, '') AS body_name, d.dist
    FROM d LEFT JOIN b ON d.user_id = b.user_id AND d.station = b.station AND b.rn = 1
    WHERE d.rn = 1
    """,
)
def settlements(spark, sf):
    """Q-G: newest docked row per (system, station), left join the newest
    approach body name per (system, name), default ''."""
    docked, approach, _ = _feeds(table(spark, sf, "events"))
    d = latest_row(docked, ["user_id", "station"], ["ts"], ["market_id", "dist"])
    b = latest_row(approach.select("user_id", "station", "ts", F.col("allegiance").alias("body_name")),
                   ["user_id", "station"], ["ts"], ["body_name"])
    out = d.join(b, ["user_id", "station"], "left")
    return out.select("user_id", "station", "market_id",
                      F.coalesce(F.col("body_name"), F.lit("")).alias("body_name"), "dist")


@register(
    "history_newest_first",
    oracle="""
    SELECT user_id, event_id, event_type, ts, CAST(floor(value * 100) AS BIGINT) AS points
    FROM events WHERE user_id = (SELECT min(user_id) FROM events)
    ORDER BY ts DESC
    """,
)
def history_newest_first(spark, sf):
    """Q-AC/F12/P5: one entity's history newest first, columns picked by
    pattern, derived points; the point lookup is a pushed-down filter."""
    ev = table(spark, sf, "events")
    who = ev.agg(F.min("user_id")).scalar()
    h = ev.filter(F.col("user_id") == who)
    return h.select(h.colRegex("`(user_id|event_.*)`"), "ts",
                    F.floor(F.col("value") * 100).cast("bigint").alias("points")).orderBy(F.col("ts").desc())


@register(
    "recent_window",
    oracle="""
    WITH a AS (SELECT max(ts) AS as_of FROM events)
    SELECT event_type, count(*) AS n
    FROM events, a WHERE ts >= as_of - INTERVAL '1 day' AND ts < as_of
    GROUP BY event_type
    """,
)
def recent_window(spark, sf):
    """half-open relative window ending at the newest event."""
    ev = table(spark, sf, "events")
    as_of = ev.agg(F.max("ts")).scalar()
    return (ev.filter((F.col("ts") >= as_of - F.expr("INTERVAL 1 DAY")) & (F.col("ts") < as_of))
            .groupBy("event_type").agg(F.count(F.lit(1)).alias("n")))


@register(
    "regex_filter",
    oracle="""
    SELECT p_partkey, p_name, p_brand FROM part
    WHERE regexp_matches(p_brand, '^Brand#[1-2][0-9]$') AND regexp_matches(p_name, '^[a-m][a-z]* (bolt|gear)$')
    """,
)
def regex_filter(spark, sf):
    """anchored regex predicates (Java regex, anchors explicit)."""
    p = table(spark, sf, "part")
    return p.filter(F.col("p_brand").rlike("^Brand#[1-2][0-9]$") & F.col("p_name").rlike("^[a-m][a-z]* (bolt|gear)$")) \
        .select("p_partkey", "p_name", "p_brand")


@register(
    "url_parts",
    oracle="""
    SELECT page_id, lower(split_part(url, '/', 3)) AS host,
           regexp_replace(url, '^https?://[^/]+', '') AS path,
           url LIKE 'https:%' AS secure,
           split_part(split_part(url, '/', 4), '?', 1) AS section
    FROM pages
    """,
)
def url_parts(spark, sf):
    """split_part, lower, anchored regexp_replace, LIKE."""
    pg = table(spark, sf, "pages")
    return pg.select(
        "page_id",
        F.lower(F.split_part("url", F.lit("/"), F.lit(3))).alias("host"),
        F.regexp_replace("url", "^https?://[^/]+", "").alias("path"),
        F.col("url").like("https:%").alias("secure"),
        F.split_part(F.split_part("url", F.lit("/"), F.lit(4)), F.lit("?"), F.lit(1)).alias("section"),
    )


@register(
    "time_labels",
    oracle="""
    SELECT event_id, strftime(ts, '%d %H:%M') AS label, date_trunc('week', ts) AS week,
           date_trunc('hour', ts) AS hour
    FROM events
    """,
)
def time_labels(spark, sf):
    """Strftime-style labels and Monday-week / hour truncation."""
    ev = table(spark, sf, "events")
    return ev.select(
        "event_id",
        F.date_format("ts", "dd HH:mm").alias("label"),
        F.date_trunc("week", "ts").cast("timestamp_ntz").alias("week"),
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"),
    )


@register(
    "factions_flat",
    oracle="""
    WITH fac AS (
      SELECT o_custkey, o_orderpriority, list_sort(array_agg(DISTINCT o_orderstatus)) AS active_states,
             max(o_orderdate) AS ts
      FROM orders GROUP BY o_custkey, o_orderpriority),
    sys_doc AS (
      SELECT o_custkey, max(ts) AS ts,
             array_agg({'name': o_orderpriority, 'active_states': active_states}) AS factions
      FROM fac GROUP BY o_custkey),
    f AS (SELECT o_custkey, ts, unnest(factions) AS fa FROM sys_doc)
    SELECT o_custkey AS system, ts, fa.name AS faction, len(fa.active_states) AS n_states,
           array_to_string(fa.active_states, ',') AS states,
           list_contains(fa.active_states, 'F') AS finished
    FROM f
    """,
)
def factions_flat(spark, sf):
    """Q-H/E2/P6: one flat row per (system, faction) from a nested list."""
    docs = system_docs(table(spark, sf, "orders"))
    f = explode_col(docs, "factions", "fa")
    return f.select(
        F.col("o_custkey").alias("system"), "ts",
        F.col("fa.name").alias("faction"),
        F.size("fa.active_states").cast("bigint").alias("n_states"),
        F.array_join("fa.active_states", ",").alias("states"),
        F.array_contains("fa.active_states", "F").alias("finished"),
    )


@register(
    "faction_inline_counts",
    oracle="""
    WITH fac AS (
      SELECT o_custkey, o_orderpriority, list_sort(array_agg(DISTINCT o_orderstatus)) AS active_states,
             max(o_orderdate) AS ts
      FROM orders GROUP BY o_custkey, o_orderpriority),
    sys_doc AS (
      SELECT o_custkey, max(ts) AS ts,
             array_agg({'name': o_orderpriority, 'active_states': active_states}) AS factions
      FROM fac GROUP BY o_custkey),
    f AS (SELECT o_custkey, UNNEST(factions, recursive := true) FROM sys_doc),
    s AS (SELECT o_custkey, name, unnest(active_states) AS state FROM f)
    SELECT name, state, count(*) AS n, count(DISTINCT o_custkey) AS n_systems
    FROM s GROUP BY name, state
    """,
)
def faction_inline_counts(spark, sf):
    """Q-N: state-occurrence profile: inline the faction list, explode the
    states, count (E1 + E2 + A7)."""
    docs = system_docs(table(spark, sf, "orders"))
    f = inline_rows(docs, "factions", keep=["o_custkey"])
    s = explode_col(f, "active_states", "state", keep=["o_custkey", "name"])
    return s.groupBy("name", "state").agg(F.count(F.lit(1)).alias("n"),
                                          F.countDistinct("o_custkey").alias("n_systems"))


@register(
    "landing_gap",
    oracle="""
    WITH files AS (
      SELECT DISTINCT event_type, event_type || '-' || strftime(ts, '%Y-%m-%d') || '.jsonl' AS file FROM events),
    latest AS (
      SELECT event_type, max(CAST(regexp_extract(file, '(\\d{4}-\\d{2}-\\d{2})', 1) AS DATE)) AS latest_day
      FROM files GROUP BY event_type),
    today AS (SELECT CAST(max(ts) AS DATE) + 3 AS today FROM events)
    SELECT event_type, CAST(latest_day AS TIMESTAMP) AS latest_day,
           CAST(coalesce(greatest(date_diff('day', latest_day, today), 1), 1) AS BIGINT) AS lookback_days
    FROM latest, today
    """,
)
def landing_gap_q(spark, sf):
    """Per feed, the newest date found in landed file names and the days
    to re-read (at least 1, no upper limit).  File names are derived from events (one
    file per type and day); "today" is three days after the newest event."""
    from orrery.sources.coverage import date_from_name, lookback_days

    ev = table(spark, sf, "events")
    files = ev.select("event_type", F.concat("event_type", F.lit("-"), F.date_format("ts", "yyyy-MM-dd"),
                                             F.lit(".jsonl")).alias("file")).distinct()
    today = ev.agg(F.date_add(F.to_date(F.max("ts")), 3)).scalar()
    latest = files.groupBy("event_type").agg(F.max(date_from_name("file")).alias("latest_day"))
    return latest.select("event_type", F.col("latest_day").cast("timestamp_ntz").alias("latest_day"),
                         lookback_days(F.col("latest_day"), today).cast("bigint").alias("lookback_days"))
