"""Ingest-path queries over envelopes derived from the driver tables
(S1, S2, F1-F3, P1, P2, N1, N3-N5, N7, N10, V1, Q-AA).

``events`` rows are rendered as raw NDJSON envelopes by Spark (client
version from the event type, receive time ``floor(value)`` minutes after the
event, unparsable times where ``props.k`` is 0-2, corrupted lines where it is 99),
then run through the real gate: ``try_parse_json`` -> version, time and
lateness checks.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery import schemas as S
from orrery.functions import json as J
from orrery.functions import normalize as N
from orrery.functions.validate import enum_reason, validate_enum
from orrery.plans.catalog import register
from orrery.sources import ndjson
from orrery.sources.tables import table

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def envelopes(spark, sf):
    """Raw text lines ``{"header": ..., "message": ...}`` derived from events."""
    ev = table(spark, sf, "events")
    et = F.col("event_type")
    k = J.text_field("props", "$.k", "int")
    gv = (F.when(et == "click", "4.0.0.1904").when(et == "view", "3.8.0.407")
          .when(et == "error", "Fleet Carriers Update").when(et == "signup", "CAPI-Live-market")
          .otherwise("4.1.0"))
    gw = F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.floor("value").cast("int"))
    msg_ts = F.when(k < 3, F.lit("not-a-time")).otherwise(F.date_format("ts", ISO))
    doc = F.to_json(F.struct(
        F.struct(gv.alias("gameversion"), F.date_format(gw, ISO).alias("gatewayTimestamp")).alias("header"),
        F.struct(msg_ts.alias("timestamp"), et.alias("event"), F.col("user_id").alias("UserId"),
                 F.col("event_id").alias("EventId"), F.col("value").alias("Value")).alias("message"),
    ))
    line = F.when(k == 99, F.concat(F.lit("{"), doc)).otherwise(doc)   # corrupted: not valid JSON
    return ev.select("event_id", "event_type", line.alias("line"))


def gated(spark, sf):
    env = envelopes(spark, sf)
    return ndjson.gate(env.select("event_id", "event_type", J.parse_once("line").alias("doc")))


_GATE_SQL = """
  WITH e AS (
    SELECT event_id, event_type, ts, value, user_id,
           CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
           CASE event_type WHEN 'click' THEN '4.0.0.1904' WHEN 'view' THEN '3.8.0.407'
                           WHEN 'error' THEN 'Fleet Carriers Update' WHEN 'signup' THEN 'CAPI-Live-market'
                           ELSE '4.1.0' END AS gv
    FROM events)
  SELECT *, CASE
      WHEN k = 99 THEN 'malformed'
      WHEN NOT coalesce(gv IN ('CAPI-journal', 'CAPI-Live-market', 'CAPI-market')
                        OR TRY_CAST(split_part(gv, '.', 1) AS INTEGER) >= 4, false) THEN 'version'
      WHEN k < 3 THEN 'bad_timestamp'
      WHEN ts < ts + to_minutes(CAST(floor(value) AS BIGINT)) - INTERVAL 1 HOUR THEN 'late'
      ELSE 'accepted' END AS outcome
  FROM e
"""


@register(
    "ingest_gate",
    oracle=f"""
    WITH g AS ({_GATE_SQL})
    SELECT event_type, outcome, count(*) AS n FROM g GROUP BY event_type, outcome
    """,
    headline=True,
)
def ingest_gate(spark, sf):
    """F1-F3 over parsed envelopes: rows per event type and gate outcome."""
    g = gated(spark, sf)
    return g.groupBy("event_type", F.coalesce("reject_reason", F.lit("accepted")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("n"))


@register(
    "raw_inspection",
    oracle=f"""
    WITH g AS ({_GATE_SQL})
    SELECT event_id, gv AS gameversion, event_type AS event, ts AS timestamp, value
    FROM g WHERE outcome = 'accepted' AND user_id = (SELECT min(user_id) FROM events)
    """,
)
def raw_inspection(spark, sf):
    """Q-AA/P1/P2: accepted raw messages of one entity, fields pulled from the
    parsed document by path (the point lookup is a filter on a typed field)."""
    who = table(spark, sf, "events").agg(F.min("user_id")).scalar()
    acc = ndjson.accepted(gated(spark, sf))
    return acc.filter(ndjson.msg("UserId", "bigint") == who).select(
        "event_id",
        ndjson.hdr("gameversion").alias("gameversion"),
        ndjson.msg("event").alias("event"),
        ndjson.parse_ts(ndjson.msg("timestamp")).alias("timestamp"),
        ndjson.msg("Value", "double").alias("value"),
    )


def _cap(name: str):
    return F.expr(f"upper(substr({name}, 1, 1)) || lower(substr({name}, 2))")


@register(
    "normalise_codes",
    oracle=f"""
    WITH sec(low, security) AS (VALUES (-1e18, 'Anarchy'), (0, 'Low'), (2000, 'Medium'), (5000, 'High'), (8000, 'Lawless')),
    st(low, station_type) AS (VALUES (-1, 'Empty'), (3, 'MegaShip'), (6, 'Orbis')),
    br(k, bracket) AS (VALUES (0, 'None'), (1, 'Low'), (2, 'Med'), (3, 'High')),
    c AS (SELECT *, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS word FROM customer)
    SELECT c_custkey, word AS economy, 'Unknown' AS second_economy, word AS government,
           if(c_acctbal < 0, 'None', c_mktsegment) AS allegiance, security, station_type, bracket,
           if(list_contains({S.ECONOMY}, word), word, NULL) AS economy_valid,
           if(list_contains({S.GOVERNMENT}, word), NULL, 'unknown') AS government_reason
    FROM c ASOF JOIN sec ON c_acctbal >= sec.low ASOF JOIN st ON c_nationkey >= st.low
           LEFT JOIN br ON floor(c_acctbal / 3000) = k
    """,
)
def normalise_codes(spark, sf):
    """N1/N3/N4/N5/N7/N10 on raw feed-style codes derived from customers,
    with V1 under the ``null`` policy and a quarantine reason."""
    c = table(spark, sf, "customer")
    seg, bal = F.col("c_mktsegment"), F.col("c_acctbal")
    eco = F.concat(F.lit("$economy_"), _cap("c_mktsegment"), F.lit(";"))
    eco2 = F.when(bal < 100, F.concat(F.lit("$economy_UNKNOWN_"), F.col("c_custkey").cast("string")))
    gov = F.concat(F.lit("$government_"), _cap("c_mktsegment"), F.lit(";"))
    alg = F.when(bal < 0, F.lit("")).otherwise(F.concat(F.lit("$faction_"), seg, F.lit(";")))
    sec = (F.when(bal < 0, "$GAlAXY_MAP_INFO_state_anarchy;").when(bal < 2000, "$SYSTEM_SECURITY_low;")
           .when(bal < 5000, "$SYSTEM_SECURITY_medium;").when(bal < 8000, "$SYSTEM_SECURITY_high;")
           .otherwise("$GALAXY_MAP_INFO_state_lawless;"))
    st = F.when(F.col("c_nationkey") < 3, "").when(F.col("c_nationkey") < 6, "Megaship").otherwise("Orbis")
    br = F.floor(bal / 3000).cast("bigint").cast("string")
    out = c.select(
        "c_custkey",
        N.economy(eco).alias("economy"),
        N.economy(eco2).alias("second_economy"),
        N.government(gov).alias("government"),
        N.allegiance(alg).alias("allegiance"),
        N.security(sec).alias("security"),
        N.station_type(st).alias("station_type"),
        N.bracket(br).alias("bracket"),
    )
    return out.select(
        "*",
        validate_enum("economy", S.ECONOMY, "Economy", "null").alias("economy_valid"),
        enum_reason("government", S.GOVERNMENT).alias("government_reason"),
    )


# --- quarantine (S1, V1, V2, F1-F3) ------------------------------------------

_SERVICES = "CASE event_id % 5 WHEN 0 THEN 'Odd' WHEN 1 THEN 'Coriolis' WHEN 2 THEN 'Ocellus' WHEN 3 THEN 'MegaShip' END"


def station_lines(spark, sf):
    """Docked envelopes derived from events: a fifth of the station types is
    unknown, every seventh line has no name, and the gate's cases are those of
    ``envelopes``."""
    env = envelopes(spark, sf).withColumnRenamed("line", "__line")
    ev = table(spark, sf, "events").select("event_id", "user_id")
    j = env.join(ev, "event_id")
    extra = F.to_json(F.struct(
        F.when(F.col("event_id") % 7 != 0, F.concat(F.lit("S"), F.col("user_id"))).alias("StationName"),
        F.expr(_SERVICES).alias("StationType"), F.col("event_id").alias("MarketID"), F.col("user_id").alias("SystemAddress")))
    # The message is the line's last object: its braces are opened once more.
    line = F.concat(F.expr("substring(__line, 1, length(__line) - 2)"), F.lit(","), F.expr("substring(x, 2)"), F.lit("}"))
    return j.withColumn("x", extra).select("event_id", "event_type", line.alias("value"))


@register(
    "ingest_quarantine",
    oracle=f"""
    WITH g AS ({_GATE_SQL}),
    r AS (SELECT event_type, CASE WHEN outcome <> 'accepted' THEN outcome WHEN event_id % 5 = 0 THEN 'value: StationType'
                                  WHEN event_id % 7 = 0 THEN 'missing: StationName' ELSE 'kept' END AS outcome FROM g)
    SELECT event_type, outcome, count(*) AS n FROM r GROUP BY ALL
    """,
)
def ingest_quarantine(spark, sf):
    """Every line with a row or with the reason why there is none: malformed,
    rejected by the gate, outside a domain, or without a column it must have."""
    lines = station_lines(spark, sf).withColumn("doc", J.parse_once("value"))
    seen = ndjson.checked(ndjson.gate(lines), "docked")
    return seen.groupBy("event_type", F.coalesce("reason", F.lit("kept")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@register(
    "nested_documents",
    oracle="""
    SELECT event_id, user_id AS id, [value, value * 2] AS readings, event_type AS kind FROM events
    WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) <> 99
    """,
)
def nested_documents(spark, sf):
    """JSON text -> a typed nested struct; text that is no JSON gives none."""
    ev = table(spark, sf, "events")
    doc = F.to_json(F.struct(F.col("user_id").alias("id"), F.array(F.col("value"), F.col("value") * 2).alias("readings"),
                             F.struct(F.col("event_type").alias("kind"), F.lit(1).alias("more")).alias("tag")))
    broken = J.text_field("props", "$.k", "int") == 99
    text = ev.select("event_id", F.when(broken, F.concat(F.lit("["), doc)).otherwise(doc).alias("text"))
    shape = "struct<id: bigint, readings: array<double>, tag: struct<kind: string>>"
    d = text.select("event_id", J.as_nested(J.parse_once("text"), shape).alias("d")).where("d IS NOT NULL")
    return d.select("event_id", "d.id", "d.readings", "d.tag.kind")
