"""Merge / upsert queries on ``events`` (K2-K6, K8, T3, T4, Q-B).

The station-latest merge of the reference is run over the event log: a
"station" is (user, weekday); purchases play the docked feed, clicks the
settlement-approach feed (type 'Empty', no distance or pads) and views with
value > 5 the docked-location feed (no allegiance or pads).  Two batches:
events before 2024-01-16 build the first snapshot from nothing, then the
whole log is merged into it (in the parity form with a 1-hour overlap cutoff).
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from orrery.functions import json as J
from orrery.operators.upsert import Stage, empty_like, keyed_replace, merge_latest, watermark_cutoff
from orrery.operators.state import merge, stage_rows, stage_state
from orrery.plans.catalog import register
from orrery.session import scratch_path
from orrery.sinks.buckets import Buckets
from orrery.sources.tables import table

KEYS = ["user_id", "station"]
COLS = ["market_id", "station_type", "dist", "pads", "allegiance"]
SPLIT = "2024-01-16 00:00:00"


def _feeds(ev):
    k = J.text_field("props", "$.k", "int")
    base = ev.select(
        "user_id",
        F.date_format("ts", "EEEE").alias("station"),
        "ts",
        F.col("event_id").alias("market_id"),
        "event_type",
        "value",
        k.alias("k"),
        "props",
    )
    docked = base.filter(F.col("event_type") == "purchase").select(
        *KEYS, "ts", "market_id",
        F.col("event_type").alias("station_type"),
        F.col("value").alias("dist"),
        F.when(F.col("value") >= 10, F.col("k")).alias("pads"),
        F.col("props").alias("allegiance"),
    )
    approach = base.filter(F.col("event_type") == "click").select(
        *KEYS, "ts", "market_id",
        F.lit("Empty").alias("station_type"),
        F.lit(None).cast("double").alias("dist"),
        F.lit(None).cast("int").alias("pads"),
        F.col("props").alias("allegiance"),
    )
    location = base.filter((F.col("event_type") == "view") & (F.col("value") > 5)).select(
        *KEYS, "ts", "market_id",
        F.col("event_type").alias("station_type"),
        F.col("value").alias("dist"),
        F.lit(None).cast("int").alias("pads"),
        F.lit(None).cast("string").alias("allegiance"),
    )
    return docked, approach, location


def _stages(docked=None, approach=None, location=None):
    """Latest known value; the approach placeholders never replace data."""
    return [
        Stage(docked, prefer_new=COLS, fill_if_null=["pads"]),
        Stage(approach, keep_old=["pads", "station_type", "dist"], prefer_new=["market_id", "allegiance"]),
        Stage(location, prefer_new=COLS),
    ]


def station_latest(target, ev, parity: bool):
    """Q-B: three ordered MERGE stages into ``target``; the parity form has the T3 cutoff."""
    docked, approach, location = _feeds(ev)
    if parity:
        stages = [
            Stage(docked, fill_if_null=["pads"]),
            Stage(approach, keep_old=["pads"]),
            Stage(location, keep_old=["pads"]),
        ]
    else:
        stages = _stages(docked, approach, location)
    return merge_latest(target, stages, KEYS, "ts", COLS, cutoff=watermark_cutoff(target, "ts") if parity else None)


def _two_batches(spark, sf, parity):
    ev = table(spark, sf, "events")
    docked, _, _ = _feeds(ev)
    empty = empty_like(docked, [*KEYS, "ts", *COLS])
    first = station_latest(empty, ev.filter(F.col("ts") < F.lit(SPLIT).cast("timestamp_ntz")), parity)
    return station_latest(first, ev, parity)


# --- oracle: the same merge written as FULL OUTER JOIN chains -------------

def _src_sql(where, type_, dist, pads, alleg, batch_filter):
    def am(x):
        return f"arg_max({x}, ts) FILTER (WHERE {x} IS NOT NULL)"

    return f"""(SELECT user_id, dayname(ts) AS station, max(ts) AS ts,
        {am('event_id')} AS market_id, {am(type_)} AS station_type, {am(dist)} AS dist,
        {am(pads)} AS pads, {am(alleg)} AS allegiance
      FROM events WHERE {where} AND {batch_filter} AND ts > (SELECT cutoff FROM {{cut}})
      GROUP BY user_id, dayname(ts))"""


_K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"


def _stage_sql(t, s, keep_old=(), prefer_new=(), fill=()):
    cols = ["ts", *COLS]
    parts = ["coalesce(t.user_id, s.user_id) AS user_id", "coalesce(t.station, s.station) AS station"]
    for c in cols:
        if c in keep_old:
            upd = f"coalesce(t.{c}, s.{c})"
        elif c in prefer_new:
            upd = f"coalesce(s.{c}, t.{c})"
        else:
            upd = f"s.{c}"
        fill_sql = f" WHEN t.{c} IS NULL AND s.{c} IS NOT NULL THEN s.{c}" if c in fill else ""
        parts.append(
            f"CASE WHEN t.user_id IS NULL THEN s.{c} WHEN s.user_id IS NULL THEN t.{c} "
            f"WHEN s.ts > t.ts THEN {upd}{fill_sql} ELSE t.{c} END AS {c}"
        )
    return (f"SELECT {', '.join(parts)} FROM {t} t FULL OUTER JOIN {s} s "
            f"ON t.user_id = s.user_id AND t.station = s.station")


def _merge_sql(parity, batches=((1, f"ts < TIMESTAMP '{SPLIT}'"), (2, "true"))):
    if parity:
        opts = [dict(fill=["pads"]), dict(keep_old=["pads"]), dict(keep_old=["pads"])]
    else:
        opts = [dict(prefer_new=COLS, fill=["pads"]),
                dict(keep_old=["pads", "station_type", "dist"], prefer_new=["market_id", "allegiance"]),
                dict(prefer_new=COLS)]
    ctes = []
    target = "empty"
    ctes.append("empty AS (SELECT NULL::BIGINT AS user_id, NULL::VARCHAR AS station, NULL::TIMESTAMP AS ts, "
                "NULL::BIGINT AS market_id, NULL::VARCHAR AS station_type, NULL::DOUBLE AS dist, "
                "NULL::INTEGER AS pads, NULL::VARCHAR AS allegiance WHERE false)")
    for b, bf in batches:
        cut = f"cut{b}"
        # Only the parity form has an overlap cutoff.
        lost = f"coalesce(max(ts) - INTERVAL 1 HOUR, TIMESTAMP '1970-01-01')" if parity else "min(TIMESTAMP '0001-01-01')"
        ctes.append(f"{cut} AS (SELECT {lost} AS cutoff FROM " + (target if parity else "(SELECT 1)") + ")")
        srcs = [
            _src_sql("event_type = 'purchase'", "event_type", "value",
                     f"CASE WHEN value >= 10 THEN {_K} END", "props", bf),
            _src_sql("event_type = 'click'", "'Empty'", "NULL::DOUBLE", "NULL::INTEGER", "props", bf),
            _src_sql("event_type = 'view' AND value > 5", "event_type", "value", "NULL::INTEGER",
                     "NULL::VARCHAR", bf),
        ]
        for i, (src, o) in enumerate(zip(srcs, opts), 1):
            name = f"b{b}s{i}"
            ctes.append(f"{name} AS ({_stage_sql(target, src.format(cut=cut), **o)})")
            target = name
    return "WITH " + ",\n".join(ctes) + f"\nSELECT * FROM {target}"


@register("merge_feeds", oracle=_merge_sql(False), headline=True)
def merge_feeds(spark, sf):
    return _two_batches(spark, sf, parity=False)


@register("merge_feeds_parity", oracle=_merge_sql(True))
def merge_feeds_parity(spark, sf):
    return _two_batches(spark, sf, parity=True)


@register("merge_feeds_state", oracle=_merge_sql(False, ((1, "true"),)))
def merge_feeds_state(spark, sf):
    """Q-B/K2/T4 incrementally: the log arrives in two loads, the later rows first;
    each is merged into a bucketed state, of which only the touched buckets are
    rewritten.  Equal to one merge of the whole log."""
    ev = table(spark, sf, "events")
    state_table = Buckets(spark, scratch_path(spark, f"orrery-merge-state-{uuid.uuid4().hex}"), KEYS, buckets=16)
    early = F.col("ts") < F.lit(SPLIT).cast("timestamp_ntz")
    for part in (ev.where(~early), ev.where(early)):
        state_table.update(stage_state(_stages(*_feeds(part)), KEYS, "ts", COLS), merge)
    return stage_rows(state_table.read(), _stages(), KEYS, "ts", COLS)


# --- keyed replace (K2) ----------------------------------------------------

_B1 = ("signup", "click", "view")
_B2 = ("error", "purchase")


def _kr(spark, sf, newest_wins):
    ev = table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type", "value")
    b1 = ev.filter(F.col("event_type").isin(*_B1))
    b2 = ev.filter(F.col("event_type").isin(*_B2))
    empty = ev.limit(0)
    t1 = keyed_replace(empty, b1, ["user_id"], ["ts", "event_id"], newest_wins)
    return keyed_replace(t1, b2, ["user_id"], ["ts", "event_id"], newest_wins)


def _dedup_sql(types):
    lst = ", ".join(f"'{t}'" for t in types)
    return f"""(SELECT user_id, event_id, ts, event_type, value FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
      FROM events WHERE event_type IN ({lst})) x WHERE rn = 1)"""


@register(
    "keyed_replace_last_batch",
    oracle=f"""
    WITH b1 AS {_dedup_sql(_B1)}, b2 AS {_dedup_sql(_B2)}
    SELECT * FROM b1 WHERE user_id NOT IN (SELECT user_id FROM b2)
    UNION ALL SELECT * FROM b2
    """,
)
def keyed_replace_last_batch(spark, sf):
    return _kr(spark, sf, newest_wins=False)


@register("keyed_replace_newest", oracle=_dedup_sql(_B1 + _B2).strip()[1:-1])
def keyed_replace_newest(spark, sf):
    return _kr(spark, sf, newest_wins=True)
