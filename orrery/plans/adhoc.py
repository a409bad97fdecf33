"""Ad-hoc analyst products over the marts (Q-I .. Q-AE, M1, M2, X22).

Parameters that were literals, prepared markers or notebook variables in
the reference are function arguments here.  Lookups of a single origin are
scalar subqueries (evaluated once); nothing is collected to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.timefns import HOUR_US, cycle_start
from orrery.operators.chunked import day_chunk
from orrery.operators.latest import latest_row
from orrery.operators.nested import inline_rows, sort_by_first_field
from orrery.operators.rules import classify_action, control_score, group_by_category, rule_join, rules_df
from orrery.operators.spatial import array_distance
from orrery.operators.timeseries import lookback_rates, state_sessions

# Settlement economy -> map category.
ECONOMY_CATEGORY = {
    "agri": "agricultural",
    "extraction": "extraction",
    "industrial": "industrial",
    "military": "military",
    "hightech": "hightech",
    "tourism": "tourist",
}


def map_category(economy: str | Column) -> Column:
    """Economy name -> settlement-map category ('' when unmapped)."""
    e = F.col(economy) if isinstance(economy, str) else economy
    key = F.regexp_replace(F.lower(F.trim(F.coalesce(e, F.lit("")))), r"\s+", "")
    m = F.create_map(*[x for kv in ECONOMY_CATEGORY.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return F.coalesce(F.try_element_at(m, key), F.lit(""))


def _pos_of(systems: DataFrame, cond: Column) -> Column:
    """StarPos of the first system matching ``cond``, as a scalar subquery."""
    return systems.filter(cond).orderBy("SystemAddress").select("StarPos").limit(1).scalar()


def system_distance(systems: DataFrame, name1: str, name2: str) -> DataFrame:
    """M1 ``system_distance(name1, name2)``: one row, NULL if either is unknown."""
    p1 = _pos_of(systems, F.col("StarSystem") == name1)
    p2 = _pos_of(systems, F.col("StarSystem") == name2)
    one = systems.sparkSession.range(1)
    return one.select(p1.alias("a"), p2.alias("b")).select(array_distance("a", "b").alias("distance"))


def with_distance_from(df: DataFrame, systems: DataFrame, origin_address: int, name: str = "Distance",
                       pos_col: str = "StarPos") -> DataFrame:
    """M2 ``system__address_distance`` for every row: the origin position is a
    scalar subquery, so ``df`` is neither joined nor shuffled for it."""
    o = _pos_of(systems, F.col("SystemAddress") == origin_address)
    return df.withColumn("__o", o).withColumn(name, array_distance(pos_col, "__o")).drop("__o")


def nearest_market(systems: DataFrame, stations: DataFrame, commodities: DataFrame, origin: str,
                   item: str, k: int = 10, sell: bool = True, order: Sequence[str] = ()) -> DataFrame:
    """Q-I: the ``k`` nearest non-carrier markets selling (or buying) ``item``.

    Stations are de-duplicated per market (J8), commodities inlined (E1),
    distances from the origin system (J7 as a scalar, X12), top-k (O3) by
    distance, market and ``order``.
    """
    st = latest_row(stations.filter(F.col("MarketId").isNotNull()
                                    & (F.coalesce(F.col("StationType"), F.lit("")) != "FleetCarrier")),
                    ["MarketId"], ["timestamp"], ["StationName", "SystemAddress", "StationType"])
    goods = inline_rows(commodities.select(F.col("MarketId").alias("cMarketId"), "Commodities"), "Commodities")
    goods = goods.filter((F.col("Name") == item) & ((F.col("Stock") > 0) if sell else (F.col("Demand") > 0)))
    pos = systems.select(F.col("SystemAddress").alias("sSystemAddress"), "StarPos", "StarSystem")
    j = goods.join(st, F.col("cMarketId") == F.col("MarketId")).join(
        pos, F.col("SystemAddress") == F.col("sSystemAddress"))
    origin_pos = _pos_of(systems, F.col("StarSystem") == origin)
    out = j.withColumn("__o", origin_pos).withColumn("Distance", array_distance("StarPos", "__o"))
    return (out.select("StarSystem", "StationName", "MarketId", "BuyPrice", "SellPrice", "Stock", "Demand",
                       F.round("Distance", 2).alias("Distance"))
            .orderBy(F.col("Distance").asc_nulls_last(), F.col("MarketId"), *order).limit(k))


def markets_near(systems: DataFrame, commodities: DataFrame, stations: DataFrame, item: str, origin: str,
                 max_distance: float, station_pattern: str | None = None) -> DataFrame:
    """Q-J: markets within ``max_distance`` of ``origin`` whose goods list
    holds ``item`` in stock (F6: ``exists`` on the nested list, no explode),
    optionally with station names matching a regex (F7)."""
    has = F.exists("Commodities", lambda c: (c["Name"] == item) & (c["Stock"] > 0))
    mk = commodities.filter(has).select("MarketId", "SystemName", "StationName")
    if station_pattern:
        mk = mk.filter(F.col("StationName").rlike(station_pattern))
    pos = systems.select("StarSystem", "StarPos")
    j = mk.join(pos, F.col("SystemName") == F.col("StarSystem"))
    o = _pos_of(systems, F.col("StarSystem") == origin)
    d = j.withColumn("__o", o).withColumn("Distance", array_distance("StarPos", "__o")).drop("__o")
    return d.filter(F.col("Distance") <= max_distance).orderBy("Distance", "MarketId")


def infra_with_distance(infra: DataFrame, systems: DataFrame, origin_address: int) -> DataFrame:
    """Q-Y: infrastructure-failure stations with the rounded distance from an
    origin system and their goods sorted by name (X23)."""
    pos = systems.select(F.col("SystemAddress").alias("pSystemAddress"), "StarPos")
    j = infra.join(pos, F.col("SystemAddress") == F.col("pSystemAddress"), "left").drop("pSystemAddress")
    d = with_distance_from(j, systems, origin_address)
    return d.withColumn("Distance", F.round("Distance", 0)).withColumn(
        "Commodities", sort_by_first_field("Commodities")).drop("StarPos")


def settlements_of(settlements: DataFrame, system_address: int) -> DataFrame:
    """Q-Z: one system's settlements (point lookup, F12) with the map category."""
    s = settlements.filter(F.col("SystemAddress") == system_address)
    return s.withColumn("MapCategory", map_category("StationEconomy"))


def settlement_facets(settlements: DataFrame, category: str | None = None, small: int | None = None,
                      medium: int | None = None, large: int | None = None) -> DataFrame:
    """F13 re-aimed at the settlements mart: category and exact pad counts;
    ``None`` means "any"."""
    s = settlements.withColumn("MapCategory", map_category("StationEconomy"))
    cond = F.lit(True)
    if category is not None:
        cond = cond & (F.col("MapCategory") == category)
    for name, v in (("Small", small), ("Medium", medium), ("Large", large)):
        if v is not None:
            cond = cond & (F.coalesce(F.col(f"LandingPads.{name}"), F.lit(0)) == v)
    return s.filter(cond)


def faction_state_sessions(jl: DataFrame, state: str = "InfrastructureFailure") -> DataFrame:
    """Q-M: per (system, faction), contiguous runs of a faction state with
    start, end, duration, mean influence and the happiness labels."""
    f = jl.select("StarSystem", "timestamp", F.inline("Factions")).select(
        "StarSystem", F.col("Name").alias("Faction"), "timestamp", "Influence",
        F.coalesce("Happiness", F.lit("")).alias("Happiness"), "ActiveStates")
    return state_sessions(f, ["StarSystem", "Faction"], "timestamp",
                          F.coalesce(F.array_contains("ActiveStates", state), F.lit(False)),
                          "Influence", "Happiness", chunk=day_chunk("timestamp"))


def hourly_state_counts(jl: DataFrame, state: str = "InfrastructureFailure") -> DataFrame:
    """Q-L / Q18: per hour the number of observations reporting ``state``
    (what the notebook counts) and the distinct (system, faction) pairs."""
    f = jl.select(F.date_trunc("hour", "timestamp").alias("hour"), "SystemAddress",
                  F.inline("Factions")).filter(F.array_contains("ActiveStates", state))
    return f.groupBy("hour").agg(
        F.count(F.lit(1)).alias("observations"),
        F.count_distinct(F.struct("SystemAddress", "Name")).alias("system_factions"),
        F.sort_array(F.collect_set("Name")).alias("factions"),
    )


def cycle_view(enclave: DataFrame, as_of: Column, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """Q-U: (snapshot, history) of the cycle ``offset`` weeks from the one
    containing ``as_of``.  Snapshot: newest row per system, power default
    'Uncontrolled' ordered last, control score (X21).  History: rows with
    8-hour rates of both counters (W9)."""
    c0 = cycle_start(as_of) + F.make_dt_interval(F.lit(7 * offset))
    c1 = c0 + F.expr("INTERVAL 7 DAYS")
    cyc = enclave.filter((F.col("timestamp") >= c0) & (F.col("timestamp") < c1))
    snap = latest_row(cyc, ["StarSystem"], ["timestamp"],
                      ["ControllingPower", "PowerplayState", "PowerplayStateControlProgress", "Powers"])
    snap = snap.select(
        "StarSystem", F.coalesce("ControllingPower", F.lit("Uncontrolled")).alias("Power"), "PowerplayState",
        control_score(F.col("PowerplayStateControlProgress"), F.col("PowerplayState")).alias("ControlScore"),
        F.coalesce("Powers", F.array().cast("array<string>")).alias("Powers"),
    ).orderBy(F.when(F.col("Power") == "Uncontrolled", 1).otherwise(0), "Power", "StarSystem")
    hist = cyc.select("StarSystem", "timestamp", "reinforcement", "undermining",
                      F.xxhash64("reinforcement", "undermining").alias("__tb"))
    hist = lookback_rates(hist, ["StarSystem"], "timestamp",
                          {"ReinforcementRate": "reinforcement", "UnderminingRate": "undermining"}, "__tb",
                          chunk_of=lambda c: F.date_trunc("day", c))
    return snap, hist.drop("__tb")


def conflict_pivot(enclave: DataFrame, powers: Sequence[str]) -> DataFrame:
    """Q-V: per system and time, one progress column per power, 0 when absent.
    The power list is the caller's (A17: ``powers_in_history`` computes it)."""
    e = enclave.select("StarSystem", "timestamp", F.inline("PowerplayConflictProgress"))
    p = e.groupBy("StarSystem", "timestamp").pivot("Power", list(powers)).agg(F.first("ConflictProgress"))
    return p.fillna(0.0, subset=list(powers))


def powers_in_history(enclave: DataFrame) -> DataFrame:
    """Distinct powers seen in conflict progress, sorted."""
    return (enclave.select(F.explode("PowerplayConflictProgress.Power").alias("Power"))
            .distinct().orderBy("Power"))


def conflict_ranking(systems: DataFrame, conflict_threshold: int = 36000,
                     acquisition_threshold: int = 120000) -> DataFrame:
    """Q-W: powers of each system by conflict progress, points and flags."""
    c = systems.select("SystemAddress", F.inline("PowerplayConflictProgress"))
    w = Window.partitionBy("SystemAddress").orderBy(F.col("ConflictProgress").desc(), "Power")
    pts = F.floor(F.col("ConflictProgress") * acquisition_threshold)
    return c.select("SystemAddress", "Power", "ConflictProgress", F.row_number().over(w).alias("Rank"),
                    pts.alias("Points"), (pts >= conflict_threshold).alias("OverConflict"),
                    (pts >= acquisition_threshold).alias("OverAcquisition"))


def activities(systems: DataFrame, power: str = "Li Yong-Rui") -> DataFrame:
    """Q-S + Q-T + A16: per system the action for ``power`` and the
    available activities grouped by category in display order."""
    s = systems.select(
        "SystemAddress",
        F.col("ControllingPower").alias("controlling_power"),
        classify_action(F.col("ControllingPower"), F.col("PowerplayState"), F.col("Powers"), power).alias("action"),
        F.coalesce(F.size("PowerplayConflictProgress") > 0, F.lit(False)).alias("in_conflict"),
        F.coalesce(F.col("PowerplayHasStrongholdCarrier"), F.lit(False)).alias("has_carrier"),
    )
    applied = rule_join(s, rules_df(systems.sparkSession), power, system_cols=("SystemAddress",))
    return group_by_category(applied, system_cols=("SystemAddress",))


def station_pad_configs(stations: DataFrame) -> DataFrame:
    """Q-R: distinct landing-pad configurations with counts (group by struct)."""
    return stations.filter(F.col("LandingPads").isNotNull()).groupBy("LandingPads").count()


def history_of(jl: DataFrame, address: int, pattern: str = "`(timestamp|StarSystem|Powerplay.*)`") -> DataFrame:
    """Q-AC: one system's history newest first, columns picked by pattern,
    derived merit points."""
    h = jl.filter(F.col("SystemAddress") == address)
    return h.select(h.colRegex(pattern)).withColumn(
        "MeritPoints", control_score(F.col("PowerplayStateControlProgress"), F.col("PowerplayState"))
    ).orderBy(F.col("timestamp").desc())


def gap_hours(df: DataFrame, key: Sequence[str], ts: str) -> DataFrame:
    """Helper for diagnostics: hours since the previous row of the key."""
    w = Window.partitionBy(*key).orderBy(ts)
    prev = F.lag(ts).over(w)
    return df.withColumn("GapHours", (F.unix_micros(F.col(ts).cast("timestamp"))
                                      - F.unix_micros(prev.cast("timestamp"))) / F.lit(float(HOUR_US)))
