"""Latest-state queries on the driver tables (A1-A5, A14, W6, U1, Q-A)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from orrery.functions import json as J
from orrery.operators.latest import latest_row, latest_state
from orrery.operators.state import latest_parts, latest_rows, merge, reduce_rows
from orrery.plans.catalog import ORACLES, register
from orrery.session import scratch_path
from orrery.sinks.buckets import Buckets
from orrery.sources.tables import table


@register(
    "latest_event_per_user",
    oracle="""
    SELECT user_id, event_id, ts, event_type, value, props FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
      FROM events) t
    WHERE rn = 1
    """,
    headline=True,
)
def latest_event_per_user(spark, sf):
    ev = table(spark, sf, "events")
    return latest_row(ev, ["user_id"], ["ts", "event_id"])


def _sparse_events(spark, sf):
    """Events with value missing on 'error' rows and k missing on 'click' rows."""
    ev = table(spark, sf, "events")
    return ev.select(
        "user_id",
        "ts",
        "event_id",
        "event_type",
        F.when(F.col("event_type") != "error", F.col("value")).alias("value"),
        F.when(F.col("event_type") != "click", J.text_field("props", "$.k", "int")).alias("k"),
    )


_SPARSE_SQL = """
  SELECT user_id, ts, event_id, event_type,
         CASE WHEN event_type <> 'error' THEN value END AS value,
         CASE WHEN event_type <> 'click' THEN CAST(json_extract_string(props, '$.k') AS INTEGER) END AS k
  FROM events
"""


@register(
    "latest_nonnull_per_user",
    oracle=f"""
    WITH ev AS ({_SPARSE_SQL})
    SELECT user_id,
           first(event_id ORDER BY ts DESC, event_id DESC) AS event_id,
           first(event_type ORDER BY ts DESC, event_id DESC) AS event_type,
           first(value ORDER BY ts DESC, event_id DESC) FILTER (WHERE value IS NOT NULL) AS value,
           first(k ORDER BY ts DESC, event_id DESC) FILTER (WHERE k IS NOT NULL) AS k,
           max(ts) AS ts,
           max(ts) FILTER (WHERE value IS NOT NULL) AS value_ts
    FROM ev GROUP BY user_id
    """,
)
def latest_nonnull_per_user(spark, sf):
    ev = _sparse_events(spark, sf)
    return latest_state(
        ev,
        key=["user_id"],
        ts="ts",
        nonnull_cols=["value", "k"],
        filtered_ts={"value_ts": F.col("value").isNotNull()},
        tiebreak=["event_id"],
    )


def activity_log(spark, sf):
    """Two logs with different schemas, projected to one and UNION ALL-ed.

    The second log is filtered (finished orders only) before the union so the
    filter reaches its parquet scan.
    """
    ev = table(spark, sf, "events").select(
        F.lit("event").alias("src"),
        F.col("user_id").alias("entity_id"),
        F.col("ts"),
        F.col("event_id").alias("item_id"),
        F.col("value").alias("amount"),
    )
    od = (
        table(spark, sf, "orders")
        .filter(F.col("o_orderstatus") == "F")
        .select(
            F.lit("order").alias("src"),
            F.col("o_custkey").alias("entity_id"),
            F.col("o_orderdate").alias("ts"),
            F.col("o_orderkey").alias("item_id"),
            F.col("o_totalprice").alias("amount"),
        )
    )
    return ev.unionByName(od)


_UNION_SQL = """
  SELECT 'event' AS src, user_id AS entity_id, ts, event_id AS item_id, value AS amount FROM events
  UNION ALL
  SELECT 'order' AS src, o_custkey AS entity_id, o_orderdate AS ts, o_orderkey AS item_id,
         o_totalprice AS amount
  FROM orders WHERE o_orderstatus = 'F'
"""


@register("union_logs", oracle=_UNION_SQL)
def union_logs(spark, sf):
    return activity_log(spark, sf)


@register(
    "latest_over_union",
    oracle=f"""
    WITH u AS ({_UNION_SQL})
    SELECT entity_id,
           first(src ORDER BY ts DESC, src DESC, item_id DESC) AS src,
           first(item_id ORDER BY ts DESC, src DESC, item_id DESC) AS item_id,
           first(amount ORDER BY ts DESC, src DESC, item_id DESC) AS amount,
           max(ts) AS ts,
           max(ts) FILTER (WHERE src = 'order') AS last_order_ts,
           count(*) AS n_rows
    FROM u GROUP BY entity_id
    """,
)
def latest_over_union(spark, sf):
    """Q-A composition: union of two logs, newest row per entity, filtered max."""
    u = activity_log(spark, sf)
    st = latest_state(
        u,
        key=["entity_id"],
        ts="ts",
        filtered_ts={"last_order_ts": F.col("src") == "order"},
        tiebreak=["src", "item_id"],
        extra_aggs={"n_rows": F.count(F.lit(1))},
    )
    return st


@register(
    "latest_over_union_state",
    oracle=f"SELECT * EXCLUDE (n_rows) FROM ({ORACLES['latest_over_union']})",
)
def latest_over_union_state(spark, sf):
    """Q-A incrementally: each log is a load of its own, merged into a bucketed
    state; the result reads the state only and equals the whole recompute."""
    u = activity_log(spark, sf)
    order, cond = [F.col("ts"), F.col("src"), F.col("item_id")], {"last_order_ts": F.col("src") == "order"}
    parts = latest_parts(u.columns, ["entity_id"], "ts", filtered_ts=cond)
    state_table = Buckets(spark, scratch_path(spark, f"orrery-latest-state-{uuid.uuid4().hex}"), ["entity_id"], buckets=16)
    for src in ("order", "event"):
        state_table.update(reduce_rows(u.where(F.col("src") == src), ["entity_id"], order, parts), merge)
    return latest_rows(state_table.read(), ["entity_id"], "ts", filtered_ts=cond)
