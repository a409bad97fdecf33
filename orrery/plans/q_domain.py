"""The domain marts and analyst products as registered queries (Q-C, Q-I, Q-J,
Q-Y, A17, E3, J8, J9, F14, M1, N2, N6, N8-N12, U2, V2, X20, X23).

The telemetry tables are derived from the driver tables: a customer is a star
system, an order an observation of it and also a station with a market, the
order's lines the goods of that market.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from orrery import schemas as S
from orrery.functions import normalize as N
from orrery.operators.nested import struct_columns
from orrery.operators.union import union_by_name
from orrery.plans import adhoc, marts, sqlnames
from orrery.plans.catalog import register
from orrery.plans.q_spatial import POWERS
from orrery.session import scratch_path
from orrery.sources.tables import table

GOODS = ("gold", "silver", "palladium", "tritium", "steel")  # by part key modulo 5
CARRIER = S.STRONGHOLD_CARRIER_NAMES[0]


def _goods(key):
    return F.element_at(F.array(*[F.lit(g) for g in GOODS]), (key % 5 + 1).cast("int"))


def _pos(key, nation):
    """Star position of a customer: three small integers, exact as doubles."""
    return F.array((key % 97).cast("double"), (key % 89).cast("double"), nation.cast("double"))


def _typed(df, columns):
    """``columns`` (name, type) of ``df`` in order; missing ones are NULL."""
    return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in columns])


def observations(spark, sf):
    """The jump log: one row per order.  Times are made unique by the order key."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    us = F.unix_micros(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    key, total = F.col("o_orderkey"), F.col("o_totalprice")
    share = F.struct(F.element_at(F.array(*[F.lit(p) for p in POWERS]), (key % 12 + 1).cast("int")).alias("Power"),
                     (F.floor(total) / 1000).alias("ConflictProgress"))
    faction = F.struct(F.col("o_orderpriority").alias("Name"), F.lit("Federation").alias("Allegiance"), F.lit("Boom").alias("FactionState"),
                       F.lit("Democracy").alias("Government"), F.lit(0.5).alias("Influence"), F.lit("Happy").alias("Happiness"),
                       F.when(F.col("o_orderstatus") == "F", F.array(F.lit("InfrastructureFailure"))).otherwise(F.array().cast("array<string>")).alias("ActiveStates"),
                       F.lit(None).cast(S.FACTION_DETAIL["RecoveringStates"].dataType).alias("RecoveringStates"),
                       F.lit(None).cast(S.FACTION_DETAIL["PendingStates"].dataType).alias("PendingStates"))
    rows = j.select(
        F.timestamp_micros(us).cast("timestamp_ntz").alias("timestamp"),
        F.col("c_name").alias("StarSystem"), F.col("c_custkey").alias("SystemAddress"),
        F.lit(1000).cast("long").alias("Population"),
        F.when(key % 3 == 0, "Exploited").when(key % 3 == 1, "Fortified").alias("PowerplayState"),
        F.when(key % 3 != 2, F.element_at(F.array(*[F.lit(p) for p in POWERS]), (key % 12 + 1).cast("int"))).alias("ControllingPower"),
        F.when(key % 2 == 0, F.array(share["Power"])).alias("Powers"),
        F.when(key % 3 == 2, F.array(share)).alias("PowerplayConflictProgress"),
        F.when(key % 5 != 0, F.floor(total) / 100).alias("PowerplayStateControlProgress"),
        F.when(key % 4 != 0, F.floor(total).cast("int")).alias("PowerplayStateReinforcement"),
        F.array(faction).alias("Factions"),
        _pos(F.col("c_custkey"), F.col("c_nationkey")).alias("StarPos"),
    )
    return _typed(rows, S.JUMP_COLUMNS)


def stations(spark, sf):
    """One station per order; every 50th is a stronghold carrier, status P a fleet carrier."""
    o = table(spark, sf, "orders")
    rows = o.select(
        F.col("o_orderdate").alias("timestamp"), F.col("o_custkey").alias("SystemAddress"),
        F.when(F.col("o_orderkey") % 50 == 0, CARRIER).otherwise(F.concat(F.lit("S"), F.col("o_orderkey").cast("string"))).alias("StationName"),
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("StarSystem"),
        F.when(F.col("o_orderstatus") == "P", "FleetCarrier").otherwise("Orbis").alias("StationType"),
        F.col("o_orderkey").alias("MarketId"),
        F.struct(F.col("o_orderpriority").alias("Name"), F.lit("Boom").alias("FactionState")).alias("StationFaction"),
    )
    return _typed(rows, S.STATION_COLUMNS)


def markets(spark, sf):
    """The goods of each order: every line is an offer."""
    li = table(spark, sf, "lineitem")
    offer = F.struct(_goods(F.col("l_partkey")).alias("Name"), F.floor("l_extendedprice").cast("int").alias("BuyPrice"),
                     F.floor(F.col("l_extendedprice") / 2).cast("int").alias("SellPrice"), F.lit(0).alias("MeanPrice"),
                     (F.col("l_quantity").cast("int") - 10).alias("Stock"), F.lit("Low").alias("StockBracket"),
                     F.col("l_linenumber").cast("int").alias("Demand"), F.lit("Low").alias("DemandBracket"),
                     F.array().cast("array<string>").alias("StatusFlags"))
    return li.groupBy(F.col("l_orderkey").alias("MarketId")).agg(
        F.max("l_shipdate").alias("timestamp"), F.collect_list(offer).alias("Commodities"))


def populated(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("Id64"), F.col("c_name").alias("Name"),
                    _pos(F.col("c_custkey"), F.col("c_nationkey")).alias("StarPos"))


def systems(spark, sf):
    return marts.systems(populated(spark, sf), marts.system_latest(observations(spark, sf)), stations(spark, sf))


_NAMES = str(POWERS)
_GOOD = str(list(GOODS)) + "[l_partkey % 5 + 1]"
_PLACE = "[CAST(c_custkey % 97 AS DOUBLE), CAST(c_custkey % 89 AS DOUBLE), CAST(c_nationkey AS DOUBLE)]"


def _far(a: str, b: str) -> str:
    """Distance of two customers by their keys and nations."""
    return (f"sqrt(({a}.c_custkey % 97 - {b}.c_custkey % 97) ** 2 + ({a}.c_custkey % 89 - {b}.c_custkey % 89) ** 2 "
            f"+ ({a}.c_nationkey - {b}.c_nationkey) ** 2)")


@register(
    "systems_mart",
    oracle=f"""
    WITH o AS (SELECT *, o_orderdate + to_microseconds(o_orderkey) AS t FROM orders),
    last AS (
      SELECT o_custkey, max(t) AS seen, arg_max(o_orderkey, t) AS k, arg_max(floor(o_totalprice), t) AS total,
             arg_max(floor(o_totalprice) / 100, t) FILTER (o_orderkey % 5 <> 0) AS progress,
             arg_max(CAST(floor(o_totalprice) AS INTEGER), t) FILTER (o_orderkey % 4 <> 0) AS reinforcement,
             bool_or(o_orderkey % 50 = 0) AS carrier
      FROM o GROUP BY o_custkey),
    named AS (SELECT *, ['Exploited', 'Fortified', 'Unoccupied'][k % 3 + 1] AS state, {_NAMES}[k % 12 + 1] AS power FROM last)
    SELECT c_custkey AS "SystemAddress", c_name AS "StarSystem", array_to_string({_PLACE}, ' ') AS "StarPos",
           if(k % 3 <> 2, power, NULL) AS "ControllingPower", state AS "PowerplayState", carrier AS "PowerplayHasStrongholdCarrier",
           round(if(progress > 1000, CASE state WHEN 'Exploited' THEN progress - 4294967296 / 349999
                                                WHEN 'Fortified' THEN progress - 4294967296 / 650000 END, progress), 6) AS "PowerplayStateControlProgress",
           if(k % 2 = 0, power, '') AS "Powers", reinforcement AS "PowerplayStateReinforcement",
           if(k % 3 = 2, power, NULL) AS "ConflictPower", seen AS "LastUpdate"
    FROM named JOIN customer ON c_custkey = o_custkey
    """,
)
def systems_mart(spark, sf):
    """Q-C: populated systems with their latest state, corrected progress and a
    carrier flag."""
    s = systems(spark, sf)
    pos = F.transform("StarPos", lambda x: F.format_string("%.1f", x))
    return s.select("SystemAddress", "StarSystem", F.array_join(pos, " ").alias("StarPos"), "ControllingPower", "PowerplayState",
                    "PowerplayHasStrongholdCarrier", F.round("PowerplayStateControlProgress", 6).alias("PowerplayStateControlProgress"),
                    F.array_join("Powers", ",").alias("Powers"), "PowerplayStateReinforcement",
                    F.get("PowerplayConflictProgress", F.lit(0))["Power"].alias("ConflictPower"), "LastUpdate")


@register(
    "nearest_market",
    oracle=f"""
    SELECT c.c_name AS "StarSystem", CASE WHEN o_orderkey % 50 = 0 THEN '{CARRIER}' ELSE 'S' || o_orderkey END AS "StationName",
           o_orderkey AS "MarketId", CAST(floor(l_extendedprice) AS INTEGER) AS "BuyPrice",
           CAST(l_quantity AS INTEGER) - 10 AS "Stock", round({_far('c', 'h')}, 2) AS "Distance"
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer c ON c.c_custkey = o_custkey,
         (SELECT * FROM customer WHERE c_custkey = (SELECT min(o_custkey) FROM orders)) h
    WHERE {_GOOD} = 'palladium' AND l_quantity > 10 AND o_orderstatus <> 'P'
    ORDER BY "Distance", o_orderkey, "BuyPrice" LIMIT 25
    """,
)
def nearest_market(spark, sf):
    """Q-I: the 25 nearest markets with palladium in stock, seen from the first
    system with a station (the limit is the feature)."""
    s = populated(spark, sf).select(F.col("Id64").alias("SystemAddress"), F.col("Name").alias("StarSystem"), "StarPos")
    first = table(spark, sf, "orders").agg(F.min("o_custkey")).scalar()
    home = s.filter(F.col("SystemAddress") == first).select("StarSystem").scalar()
    out = adhoc.nearest_market(s, stations(spark, sf), markets(spark, sf), home, "palladium", k=25, order=["BuyPrice"])
    return out.select("StarSystem", "StationName", "MarketId", "BuyPrice", "Stock", "Distance")


@register(
    "markets_near",
    oracle=f"""
    SELECT o_orderkey AS "MarketId", c.c_name AS "SystemName", {_far('c', 'h')} AS "Distance"
    FROM orders JOIN customer c ON c.c_custkey = o_custkey,
         (SELECT * FROM customer WHERE c_custkey = (SELECT min(o_custkey) FROM orders)) h
    WHERE {_far('c', 'h')} <= 30 AND regexp_matches('S' || o_orderkey, '^S[0-9]*[05]$')
      AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE {_GOOD} = 'gold' AND l_quantity > 10)
    """,
)
def markets_near(spark, sf):
    """Q-J: markets within 30 of a system that have gold in stock, names by a pattern."""
    s = populated(spark, sf).select(F.col("Id64").alias("SystemAddress"), F.col("Name").alias("StarSystem"), "StarPos")
    first = table(spark, sf, "orders").agg(F.min("o_custkey")).scalar()
    home = s.filter(F.col("SystemAddress") == first).select("StarSystem").scalar()
    o = table(spark, sf, "orders").join(s, F.col("o_custkey") == F.col("SystemAddress"))
    named = o.select(F.col("o_orderkey").alias("MarketId"), F.col("StarSystem").alias("SystemName"),
                     F.concat(F.lit("S"), F.col("o_orderkey").cast("string")).alias("StationName"))
    goods = markets(spark, sf).join(named, "MarketId")
    out = adhoc.markets_near(s, goods, stations(spark, sf), "gold", home, 30.0, "^S[0-9]*[05]$")
    return out.select("MarketId", "SystemName", "Distance")


@register(
    "infra_with_distance",
    oracle=f"""
    WITH last AS (SELECT o_custkey, arg_max(o_orderstatus, o_orderdate + to_microseconds(o_orderkey)) AS status,
                         arg_max(o_orderpriority, o_orderdate + to_microseconds(o_orderkey)) AS priority FROM orders GROUP BY ALL),
    h AS (SELECT * FROM customer WHERE c_custkey = (SELECT min(c_custkey) FROM customer))
    SELECT o.o_orderkey AS "MarketId", o.o_custkey AS "SystemAddress", o.o_orderpriority AS "FactionName",
           round({_far('c', 'h')}, 0) AS "Distance",
           string_agg(concat_ws(':', {_GOOD}, CAST(floor(l_extendedprice) AS INTEGER), CAST(l_quantity AS INTEGER) - 10), ';'
                      ORDER BY {_GOOD}, CAST(CAST(floor(l_extendedprice) AS INTEGER) AS VARCHAR), CAST(CAST(l_quantity AS INTEGER) - 10 AS VARCHAR)) AS "Goods"
    FROM orders o JOIN last ON last.o_custkey = o.o_custkey AND status = 'F' AND priority = o.o_orderpriority
         JOIN lineitem ON l_orderkey = o.o_orderkey AND {_GOOD} IN ('gold', 'silver', 'palladium') AND l_quantity > 10
         JOIN customer c ON c.c_custkey = o.o_custkey, h
    GROUP BY ALL
    """,
)
def infra_with_distance(spark, sf):
    """Q-Y / X23: failing stations with precious goods in order of name, and the
    rounded distance from the first system."""
    sl, st = marts.system_latest(observations(spark, sf)), stations(spark, sf)
    mart = marts.systems(populated(spark, sf), sl, st)
    infra = marts.infra_failures(sl, st, markets(spark, sf), mart)
    places = populated(spark, sf).select(F.col("Id64").alias("SystemAddress"), "StarPos")
    first = table(spark, sf, "customer").agg(F.min("c_custkey")).scalar()
    out = adhoc.infra_with_distance(infra, places, first)
    goods = F.transform("Commodities", lambda g: F.array_join(g, ":"))
    return out.select("MarketId", "SystemAddress", "FactionName", "Distance", F.array_join(goods, ";").alias("Goods"))


@register(
    "system_distance",
    oracle=f"""
    SELECT {_far('a', 'b')} AS distance
    FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 1) a, (SELECT * FROM customer ORDER BY c_custkey DESC LIMIT 1) b
    """,
)
def system_distance(spark, sf):
    """M1: distance between the first and the last system, looked up by name."""
    s = populated(spark, sf).select(F.col("Id64").alias("SystemAddress"), F.col("Name").alias("StarSystem"), "StarPos")
    ends = [s.orderBy(x).limit(1).select("StarSystem").scalar() for x in (F.col("SystemAddress"), F.col("SystemAddress").desc())]
    return adhoc.system_distance(s, *ends)


@register("powers_in_history", oracle=f"SELECT DISTINCT {_NAMES}[o_orderkey % 12 + 1] AS \"Power\" FROM orders WHERE o_orderkey % 3 = 2")
def powers_in_history(spark, sf):
    """The powers that occur in any conflict."""
    return adhoc.powers_in_history(observations(spark, sf))


@register(
    "union_missing_columns",
    oracle="""
    SELECT 'supplier' AS kind, s_suppkey AS key, s_nationkey AS nation, s_acctbal AS balance, NULL AS segment FROM supplier
    UNION ALL SELECT 'customer', c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer
    UNION ALL SELECT 'nation', n_nationkey, n_nationkey, NULL, NULL FROM nation
    """,
)
def union_missing_columns(spark, sf):
    """Frames of different shape, matched by name."""
    s = table(spark, sf, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("key"),
                                           F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    c = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("key"), F.lit("customer").alias("kind"),
                                           F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_nationkey").alias("nation"), F.lit("nation").alias("kind"))
    return union_by_name(s, c, n)


@register(
    "normalise_lists",
    oracle="""
    WITH c AS (SELECT *, c_custkey % 4 AS k FROM customer)
    SELECT c_custkey,
           ['HighTech', 'Agri', 'Military', '-'][k + 1] || ':' || k || ',Unknown:0' AS economies,
           c_name || '/' || if(k = 0, 'None', 'Boom') AS faction,
           ['Geological', 'Tritium', 'Human', '-'][k + 1] || '*' || k AS signals,
           c_name || ' v ' || c_mktsegment || ' ' || ['active', 'pending', '-', '-'][k + 1] || ' ' || ['war', '-', 'election', 'civilwar'][k + 1] AS conflict,
           concat_ws(' ', 'gold', ['None', 'Low', 'Med', 'High'][k + 1], if(k % 2 = 0, 'None', '-'), if(k = 1, 'Rare+High Demand', 'Rare')) AS goods,
           concat_ws(' ', c_name, if(k = 0, 'None', 'Empire'), ['Elated', 'Happy', 'Unknown', 'Despondent'][k + 1], if(k = 2, 'Boom+War', 'Boom')) AS detail,
           (k = 1) || ' ' || ['Empty', 'Titan', '-', 'Codex'][k + 1] AS fss,
           'Aisling Duval,' || if(k = 3, '-', 'Yuri Grom') AS powers,
           c_mktsegment AS name, if(k = 0, 'None', 'Boom') AS state
    FROM c
    """,
)
def normalise_lists(spark, sf):
    """Nested raw lists derived from customers,
    normalised under the ``null`` policy; every list is rendered as text ('-'
    for a value that did not pass)."""
    c = table(spark, sf, "customer")
    k = F.col("c_custkey") % 4

    def pick(*values):
        return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (k + 1).cast("int"))

    def shown(x):
        return F.coalesce(x.cast("string"), F.lit("-"))

    name, seg = F.col("c_name"), F.col("c_mktsegment")
    eco = F.array(F.struct(pick("$economy_HighTech;", "$economy_Agri;", "$economy_Military;", "$economy_Bogus;").alias("name"), k.alias("proportion")),
                  F.struct(F.lit(None).cast("string").alias("name"), F.lit(0).cast("long").alias("proportion")))
    ref = F.struct(seg.alias("Name"), F.when(k != 0, "Boom").alias("FactionState"))
    sig = F.array(F.struct(k.cast("string").alias("Count"), pick("$SAA_SignalType_Geological;", "tritium", "$SAA_SignalType_Human;", "$SAA_SignalType_Odd;").alias("Type")))

    def side(x):
        return F.struct(x.alias("Name"), F.lit("").alias("Stake"), F.lit(1).alias("WonDays"))

    war = F.array(F.struct(side(name).alias("Faction1"), side(seg).alias("Faction2"), pick("active", "pending", "", "lost").alias("Status"),
                           pick("war", "feud", "election", "civilwar").alias("WarType")))
    zero = F.lit(0)
    goods = F.array(F.struct(F.lit("gold").alias("name"), zero.alias("buyPrice"), zero.alias("sellPrice"), zero.alias("meanPrice"), zero.alias("stock"),
                             k.cast("string").alias("stockBracket"), zero.alias("demand"), pick("", "9", "0", "4").alias("demandBracket"),
                             F.when(k == 1, F.array(F.lit("rare"), F.lit("High demand"))).otherwise(F.array(F.lit("rare"))).alias("statusFlags")))
    states = F.when(k == 2, F.array(F.struct(F.lit("Boom").alias("State")), F.struct(F.lit("War").alias("State")))).otherwise(F.array(F.struct(F.lit("Boom").alias("State"))))
    empty = F.array().cast("array<string>")
    detail = F.array(F.struct(name.alias("Name"), F.when(k == 0, "").otherwise("$faction_Empire;").alias("Allegiance"), F.lit("War").alias("FactionState"),
                              F.lit("$government_Feudal;").alias("Government"), F.lit(0.1).alias("Influence"),
                              pick("$Faction_HappinessBand1;", "$Faction_HappinessBand2;", "", "$Faction_HappinessBand5;").alias("Happiness"),
                              states.alias("ActiveStates"), empty.alias("RecoveringStates"), empty.alias("PendingStates")))
    fss = F.array(F.struct(F.when(k == 1, "true").otherwise("false").alias("IsStation"), name.alias("SignalName"), pick("", "Titan", "Nonsense", "Codex").alias("SignalType")))
    powers = F.array(F.lit("Aisling Duval"), F.when(k == 3, "Nobody").otherwise("Yuri Grom"))
    clean = c.select(
        "c_custkey", "c_name", N.economies(eco, "null").alias("e"), N.faction_ref(ref).alias("r"), N.signal_counts(sig, "null").alias("s"),
        N.conflicts(war, "null")[0].alias("w"), N.commodities(goods, "null")[0].alias("g"), N.faction_details(detail, "null")[0].alias("d"),
        N.fss_signals(fss, "null")[0].alias("f"), N.powers(powers, "null").alias("p"))
    text = clean.select(
        "c_custkey",
        F.array_join(F.transform("e", lambda x: F.concat_ws(":", shown(x["Name"]), x["Proportion"].cast("int"))), ",").alias("economies"),
        F.concat_ws("/", "c_name", "r.FactionState").alias("faction"),
        F.array_join(F.transform("s", lambda x: F.concat_ws("*", shown(x["Type"]), x["Count"])), ",").alias("signals"),
        F.concat(F.col("w.Faction1.Name"), F.lit(" v "), F.col("w.Faction2.Name"), F.lit(" "), shown(F.col("w.Status")), F.lit(" "), shown(F.col("w.WarType"))).alias("conflict"),
        F.concat_ws(" ", "g.Name", shown(F.col("g.StockBracket")), shown(F.col("g.DemandBracket")), F.array_join("g.StatusFlags", "+")).alias("goods"),
        F.concat_ws(" ", "d.Name", shown(F.col("d.Allegiance")), shown(F.col("d.Happiness")), F.array_join("d.ActiveStates", "+")).alias("detail"),
        F.concat_ws(" ", F.col("f.IsStation").cast("string"), shown(F.col("f.SignalType"))).alias("fss"),
        F.array_join(F.transform("p", shown), ",").alias("powers"),
        "r")
    # The struct's fields as columns.
    return struct_columns(text, "r", [x for x in text.columns if x != "r"]).withColumnRenamed("Name", "name").withColumnRenamed("FactionState", "state")


@register(
    "distances_by_name",
    oracle=f"""
    WITH o AS (SELECT * FROM customer ORDER BY c_custkey LIMIT 1)
    SELECT c.c_custkey AS "SystemAddress", c.c_name AS "StarSystem", {_far('o', 'c')} AS distance, {_far('o', 'c')} AS by_address
    FROM customer c, o WHERE {_far('o', 'c')} <= 20
    """,
)
def distances_by_name(spark, sf):
    """Tables and distance functions asked for by their SQL names."""
    at = scratch_path(spark, f"orrery-names-{uuid.uuid4().hex}")
    s = populated(spark, sf).select(F.col("Id64").cast("long").alias("SystemAddress"), F.col("Name").alias("StarSystem"), "StarPos")
    s.write.parquet(f"{at}/systems")
    sqlnames.install(spark, {"systems": f"{at}/systems"})
    origin = s.orderBy("SystemAddress").first().StarSystem
    at = spark.sql("SELECT star.position_of(:name) AS at", args={"name": origin}).first().at
    return spark.sql("""
        SELECT SystemAddress, StarSystem, distance, star.distance_from(SystemAddress, :at) AS by_address
        FROM systems_within(:at, 20D)""", args={"at": F.array(*[F.lit(x) for x in at])})
