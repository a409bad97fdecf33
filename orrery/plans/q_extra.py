"""More composite query shapes on the driver tables
(E4, U3, J10, F6, F7, W8, M3, J13, P8, X4, Q-O, Q-P, Q-X, Q-AD)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from orrery.functions.timefns import cycle_start
from orrery.operators.chunked import chunked_running_sum, day_chunk, with_chunk
from orrery.operators.latest import latest_row
from orrery.operators.nested import exists_in, explode_two_level, inline_rows
from orrery.operators.timeseries import clean_counter_series, with_deltas
from orrery.plans.catalog import register
from orrery.plans.q_nested import market_docs, system_docs
from orrery.plans.q_series import _CLEAN_SQL, series_log
from orrery.plans.q_spatial import SUPPORT_SQL, star_systems, support_pairs
from orrery.sources.tables import table


def body_docs(spark, sf):
    """Per order ("system") a list of bodies — its lines grouped by return
    flag — each with two lists of lines: open ("rings") and filled ("belts").
    Every list is bounded by the size of one order, so no group grows with
    the data (a customer-level list would)."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    ring = F.struct(F.concat_ws(" ", F.concat(F.lit("O"), F.col("l_orderkey").cast("string")),
                                F.col("l_linenumber").cast("string")).alias("name"),
                    F.col("l_linestatus").alias("type"))
    # Both nesting levels group by the order: one shuffle by order key serves
    # both (list aggregates gain nothing from map-side partial aggregation).
    per_body = li.repartition("l_orderkey").groupBy("l_orderkey", "l_returnflag").agg(
        F.collect_list(F.when(F.col("l_linestatus") == "O", ring)).alias("rings"),
        F.collect_list(F.when(F.col("l_linestatus") == "F", ring)).alias("belts"),
    )
    body = F.struct(F.concat(F.lit("O"), F.col("l_orderkey").cast("string"), F.lit("-"),
                             F.col("l_returnflag")).alias("name"), "belts", "rings")
    return per_body.groupBy("l_orderkey").agg(F.collect_list(body).alias("bodies"))


@register(
    "ring_hotspots",
    oracle="""
    WITH lines AS (
      SELECT l_orderkey, 'O' || l_orderkey || '-' || l_returnflag AS body,
             'O' || l_orderkey || ' ' || l_linenumber AS ring, l_linestatus AS type, l_quantity
      FROM lineitem),
    rings AS (SELECT l_orderkey, body, ring, type FROM lines WHERE type IN ('O', 'F')),
    hot AS (SELECT l_orderkey, ring, l_quantity AS signals FROM lines WHERE l_quantity > 45)
    SELECT r.l_orderkey, r.body AS name, r.ring AS name_1, r.type, h.signals
    FROM rings r JOIN hot h ON h.l_orderkey = r.l_orderkey AND h.ring = r.ring
    """,
)
def ring_hotspots(spark, sf):
    """Q-O: two-level explode (bodies -> belts + rings, E4/U3), duplicate
    field renamed ``name_1``, joined to hotspots on the compound natural key
    (system, ring name) (J10)."""
    rings = explode_two_level(body_docs(spark, sf), "bodies", ["belts", "rings"], keep=["l_orderkey"])
    hot = table(spark, sf, "lineitem").filter(F.col("l_quantity") > 45).select(
        F.col("l_orderkey").alias("h_order"),
        F.concat_ws(" ", F.concat(F.lit("O"), F.col("l_orderkey").cast("string")),
                    F.col("l_linenumber").cast("string")).alias("h_ring"),
        F.col("l_quantity").alias("signals"),
    )
    j = rings.join(hot, (F.col("l_orderkey") == F.col("h_order")) & (F.col("name_1") == F.col("h_ring")))
    return j.select("l_orderkey", "name", "name_1", "type", "signals")


@register(
    "markets_with_item",
    oracle="""
    WITH mk AS (
      SELECT l_orderkey, max(l_shipdate) AS market_ts,
             array_agg({'name': CAST(l_partkey AS VARCHAR), 'buy_price': l_extendedprice,
                        'stock': l_quantity, 'flag': l_returnflag}) AS commodities
      FROM lineitem GROUP BY l_orderkey)
    SELECT l_orderkey AS market_id, market_ts, len(commodities) AS n_items
    FROM mk
    WHERE len(list_filter(commodities, lambda c: c.flag = 'R' AND c.stock > 40)) > 0
      AND regexp_matches(CAST(l_orderkey AS VARCHAR), '^[1-4][0-9]*7$')
    """,
)
def markets_with_item(spark, sf):
    """Q-J: markets whose nested goods list has a matching item (F6, a
    higher-order ``exists`` — no explode), filtered by a regex (F7)."""
    mk = market_docs(table(spark, sf, "lineitem"))
    hit = exists_in("commodities", lambda c: (c["flag"] == "R") & (c["stock"] > 40))
    return mk.filter(hit & F.col("l_orderkey").cast("string").rlike("^[1-4][0-9]*7$")).select(
        F.col("l_orderkey").alias("market_id"), "market_ts", F.size("commodities").cast("bigint").alias("n_items"))


@register(
    "hourly_delta_global",
    oracle="""
    WITH h AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS n, round(sum(value), 2) AS total
               FROM events GROUP BY 1)
    SELECT hour, n, total, n - lag(n) OVER (ORDER BY hour) AS d_n,
           row_number() OVER (ORDER BY hour) AS hour_no
    FROM h
    """,
)
def hourly_delta_global(spark, sf):
    """An unpartitioned LAG / row_number, only over the hourly aggregate
    (its size is bounded by the time span, not by the data volume)."""
    ev = table(spark, sf, "events")
    h = ev.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    w = Window.orderBy("hour")
    return h.select("hour", "n", "total", (F.col("n") - F.lag("n").over(w)).alias("d_n"),
                    F.row_number().over(w).cast("bigint").alias("hour_no"))


@register(
    "prepared_search",
    oracle="""
    SELECT c_custkey, c_name, c_acctbal FROM customer
    WHERE lower(c_name) LIKE lower('Customer#0000001') || '%' AND c_acctbal >= 0
    ORDER BY c_name, c_custkey LIMIT 20
    """,
)
def prepared_search(spark, sf, prefix="Customer#0000001", min_balance=0):
    """M3/F8: a parameterised SQL statement (named parameter markers bound
    by Spark, never string-spliced) over a DataFrame argument."""
    return spark.sql(
        "SELECT c_custkey, c_name, c_acctbal FROM {customer} "
        "WHERE lower(c_name) LIKE lower(:prefix) || '%' AND c_acctbal >= :min_balance "
        "ORDER BY c_name, c_custkey LIMIT 20",
        args={"prefix": prefix, "min_balance": min_balance},
        customer=table(spark, sf, "customer"),
    )


@register(
    "cycle_history",
    oracle="""
    WITH b AS (SELECT time_bucket(INTERVAL '7 days', max(ts), TIMESTAMP '1970-01-01 07:00:00') AS c0 FROM events),
    cyc AS (SELECT e.* FROM events e, b WHERE ts >= c0 AND ts < c0 + INTERVAL '7 days'),
    snap AS (
      SELECT user_id, event_type AS last_type, ts AS last_ts FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM cyc) x
      WHERE rn = 1)
    SELECT c.user_id, c.ts, c.event_type, c.value, s.last_type, s.last_ts,
           row_number() OVER (PARTITION BY c.user_id ORDER BY c.ts, c.event_id) AS step
    FROM cyc c JOIN snap s USING (user_id)
    """,
)
def cycle_history(spark, sf):
    """J13 re-aimed: the history rows of the current cycle, each carrying its
    entity's newest-row snapshot, plus the step number.  A flat join instead
    of one collected list per entity, so no group is ever materialised, and
    no window confines an entity to one task."""
    ev = table(spark, sf, "events")
    c0 = ev.agg(cycle_start(F.max("ts"))).scalar()
    cyc = ev.filter((F.col("ts") >= c0) & (F.col("ts") < c0 + F.expr("INTERVAL 7 DAYS"))).select(
        "user_id", "ts", "event_id", "event_type", "value")
    # Snapshot: a keyed aggregation (partial-aggregated, one row per entity).
    snap = latest_row(cyc, ["user_id"], ["ts", "event_id"], ["event_type", "ts"]).select(
        "user_id", F.col("event_type").alias("last_type"), F.col("ts").alias("last_ts"))
    # Step number: a running count per (entity, day) plus earlier days' counts.
    steps = chunked_running_sum(with_chunk(cyc, day_chunk("ts")), ["user_id"], ["ts", "event_id"],
                                F.lit(1).cast("bigint"), "step")
    return steps.join(snap, "user_id").select("user_id", "ts", "event_type", "value", "last_type", "last_ts",
                                               "step")


@register(
    "clean_series_diagnostics",
    oracle=f"""
    WITH c AS ({_CLEAN_SQL}),
    d AS (
      SELECT *, reinforcement - lag(reinforcement) OVER w AS d_reinforcement,
             undermining - lag(undermining) OVER w AS d_undermining,
             strftime(ts, '%d %H:%M') AS label,
             time_bucket(INTERVAL '7 days', ts, TIMESTAMP '1970-01-01 07:00:00') AS cycle
      FROM c WINDOW w AS (PARTITION BY user_id ORDER BY ts))
    SELECT user_id, ts, label, state, reinforcement, undermining, d_reinforcement, d_undermining, cycle,
           last_value(reinforcement) OVER cw - first_value(reinforcement) OVER cw AS net_reinforcement
    FROM d WINDOW cw AS (PARTITION BY user_id, cycle ORDER BY ts
                         ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
    """,
)
def clean_series_diagnostics(spark, sf):
    """Q-AD: the cleaned series with per-step deltas, a display label
    and the net change over each weekly cycle (chained columns, P8).

    Skew-safe throughout: the cleaning and the deltas run on (user, day)
    chunks with carried boundaries, and the net change is a window per
    (user, weekly cycle), a bounded time chunk."""
    log = series_log(spark, sf)
    c = clean_counter_series(log, "user_id", "ts", "state", "r", "u", progress="progress", control="control",
                             chunk=day_chunk("ts"))
    d = c.select("user_id", "ts", F.date_format("ts", "dd HH:mm").alias("label"), "state",
                 F.col("r").alias("reinforcement"), F.col("u").alias("undermining"), cycle_start("ts").alias("cycle"))
    d = with_deltas(d, ["user_id"], ["ts"], ["reinforcement", "undermining"], chunk=day_chunk("ts"))
    # The weekly cycle is itself a time chunk: a window per (user, cycle)
    # holds at most one week of one entity, and reuses d's rows in place.
    cw = Window.partitionBy("user_id", "cycle").orderBy("ts").rowsBetween(Window.unboundedPreceding,
                                                                          Window.unboundedFollowing)
    net = F.last("reinforcement").over(cw) - F.first("reinforcement").over(cw)
    return d.select("user_id", "ts", "label", "state", "reinforcement", "undermining", "d_reinforcement",
                    "d_undermining", "cycle", net.alias("net_reinforcement"))


@register(
    "support_lookup",
    oracle=f"""
    WITH pairs AS ({SUPPORT_SQL}),
    hero AS (SELECT supported_id FROM pairs WHERE supporting_id = (SELECT min(supporting_id) FROM pairs))
    SELECT direction, other_id,
           CASE WHEN k <= 1 THEN 'Stronghold' WHEN k <= 4 THEN 'Fortified' WHEN k <= 6 THEN 'Exploited' ELSE 'Unoccupied' END
             AS other_state, round(distance, 6) AS distance
    FROM (SELECT 'supported' AS direction, supported_id AS other_id, supported_label AS k, distance
          FROM pairs WHERE supporting_id = (SELECT min(supporting_id) FROM pairs)
          UNION ALL
          SELECT 'supporting', supporting_id, 9 - supported_label, distance FROM pairs SEMI JOIN hero USING (supported_id))
    """,
)
def support_lookup(spark, sf):
    """Q-X: the systems one system supports, and everything supporting those,
    with the dimension attached (J5) — lookups on the pair table."""
    systems = star_systems(spark, sf).drop("embedding")
    # The one system first: its pairs are a range join with one side of a row.
    who = support_pairs(systems).agg(F.min("supporting_id")).scalar()
    mine = support_pairs(systems, supporting=F.col("system_id") == who)
    near = mine.select(F.col("supported_id").alias("sid")).distinct()
    pairs = support_pairs(systems, supported=systems.join(near, F.col("system_id") == F.col("sid"), "left_semi"))
    dim = systems.select(F.col("system_id").alias("other_id"), F.col("state").alias("other_state"))
    a = mine.select(F.lit("supported").alias("direction"), F.col("supported_id").alias("other_id"), "distance")
    b = pairs.select(F.lit("supporting").alias("direction"), F.col("supporting_id").alias("other_id"), "distance")
    out = a.unionByName(b).join(dim, "other_id")
    return out.select("direction", "other_id", "other_state", F.round("distance", 6).alias("distance"))


@register(
    "signals_per_listed",
    oracle="""
    WITH fac AS (
      SELECT o_custkey, o_orderpriority, list_sort(array_agg(DISTINCT o_orderstatus)) AS active_states,
             max(o_orderdate) AS ts
      FROM orders GROUP BY o_custkey, o_orderpriority),
    f AS (SELECT o_custkey, o_orderpriority AS name, active_states FROM fac)
    SELECT o_custkey, count(*) AS n_factions, CAST(sum(len(active_states)) AS BIGINT) AS n_states,
           min(name) AS first_faction, max(name) AS last_faction
    FROM f WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
    GROUP BY o_custkey
    """,
)
def signals_per_listed(spark, sf):
    """Q-P: inline a nested list for systems named in a list (IN subquery ->
    left semi join, F4) and aggregate (A6)."""
    listed = table(spark, sf, "customer").filter(F.col("c_mktsegment") == "BUILDING").select(
        F.col("c_custkey").alias("o_custkey"))
    docs = system_docs(table(spark, sf, "orders")).join(listed, "o_custkey", "left_semi")
    f = inline_rows(docs, "factions", keep=["o_custkey"])
    return f.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_factions"),
        F.sum(F.size("active_states")).cast("bigint").alias("n_states"),
        F.min("name").alias("first_faction"),
        F.max("name").alias("last_faction"),
    )


@register(
    "settlement_categories",
    oracle="""
    WITH s AS (
      SELECT c_custkey, c_nationkey,
             CASE c_mktsegment WHEN 'MACHINERY' THEN 'Industrial' WHEN 'AUTOMOBILE' THEN 'High Tech'
                               WHEN 'HOUSEHOLD' THEN 'Tourism' WHEN 'FURNITURE' THEN 'Agri'
                               ELSE 'Colony' END AS economy,
             CAST(floor(c_acctbal / 2500) AS INTEGER) AS small_pads
      FROM customer),
    c AS (
      SELECT *, coalesce(CASE lower(regexp_replace(trim(economy), '\\s+', '', 'g'))
                  WHEN 'agri' THEN 'agricultural' WHEN 'extraction' THEN 'extraction'
                  WHEN 'industrial' THEN 'industrial' WHEN 'military' THEN 'military'
                  WHEN 'hightech' THEN 'hightech' WHEN 'tourism' THEN 'tourist' END, '') AS map_category
      FROM s)
    SELECT map_category, small_pads, count(*) AS n FROM c
    WHERE map_category <> '' AND small_pads BETWEEN 1 AND 3
    GROUP BY map_category, small_pads
    """,
)
def settlement_categories(spark, sf):
    """Q-Z/X22/F13: economy -> settlement-map category, then facet filters
    (category given, exact pad counts) and counts per facet value."""
    from orrery.plans.adhoc import map_category

    c = table(spark, sf, "customer")
    seg = F.col("c_mktsegment")
    economy = (F.when(seg == "MACHINERY", "Industrial").when(seg == "AUTOMOBILE", "High Tech")
               .when(seg == "HOUSEHOLD", "Tourism").when(seg == "FURNITURE", "Agri").otherwise("Colony"))
    s = c.select(map_category(economy).alias("map_category"),
                 F.floor(F.col("c_acctbal") / 2500).cast("int").alias("small_pads"))
    f = s.filter((F.col("map_category") != "") & F.col("small_pads").between(1, 3))
    return f.groupBy("map_category", "small_pads").agg(F.count(F.lit(1)).alias("n"))
