"""The published marts over the ingested telemetry tables (Q-A .. Q-H).

Inputs are the tables produced by ``orrery.sources.ndjson`` (``jumps``,
``location``, ``docked``, ``approach_settlement``, ``commodities_latest``)
and the populated-systems dump.  Every mart is a function of DataFrames;
``orrery.sinks.publish`` writes them as one versioned release.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery import schemas as S
from orrery.operators.chunked import day_chunk
from orrery.operators.latest import latest_row, latest_state
from orrery.operators.nested import has_any, inline_rows, or_empty
from orrery.operators.state import Part, latest_parts, latest_rows, reduce_rows, stage_rows, stage_state
from orrery.operators.timeseries import clean_counter_series, fix_control_progress
from orrery.operators.upsert import Stage, empty_like, merge_latest, watermark_cutoff
from orrery.plans.q_spatial import support_pairs

JUMP_COLS = [n for n, _ in S.JUMP_COLUMNS]
STATION_COLS = [n for n, _ in S.STATION_COLUMNS]
STATION_KEYS = ["SystemAddress", "StationName"]
COUNTERS = ["PowerplayStateControlProgress", "PowerplayStateReinforcement", "PowerplayStateUndermining"]


def _row_hash(df: DataFrame, cols) -> Column:
    """Deterministic full-row tie-break for rows sharing a timestamp (Q15)."""
    return F.xxhash64(*[F.col(c) for c in cols])


def jumps_location(jumps: DataFrame, location: DataFrame) -> DataFrame:
    """U1 view: all jumps plus undocked locations (NULL Docked excluded)."""
    return jumps.select(*JUMP_COLS).unionByName(
        location.filter(F.col("Docked") == F.lit(False)).select(*JUMP_COLS))


def system_latest(jl: DataFrame) -> DataFrame:
    """Q-A: newest values per system; the three counters newest non-NULL;
    ``PowerplayTimestamp`` = newest time with a control progress."""
    other = [c for c in JUMP_COLS if c not in ("SystemAddress", "timestamp")]
    return latest_state(
        jl,
        key=["SystemAddress"],
        ts="timestamp",
        nonnull_cols=COUNTERS,
        filtered_ts={"PowerplayTimestamp": F.col("PowerplayStateControlProgress").isNotNull()},
        tiebreak=[_row_hash(jl, other)],
    )


SYSTEM_KEYS = ["SystemAddress"]
SYSTEM_TIMES = {"PowerplayTimestamp": "PowerplayStateControlProgress IS NOT NULL"}


def system_state(jl: DataFrame) -> DataFrame:
    """The mergeable state behind :func:`system_latest`."""
    other = [c for c in JUMP_COLS if c not in ("SystemAddress", "timestamp")]
    parts = latest_parts(jl.columns, SYSTEM_KEYS, "timestamp", COUNTERS, {n: F.expr(x) for n, x in SYSTEM_TIMES.items()})
    return reduce_rows(jl, SYSTEM_KEYS, [F.col("timestamp"), _row_hash(jl, other)], parts)


def system_from_state(state: DataFrame) -> DataFrame:
    return latest_rows(state, SYSTEM_KEYS, "timestamp", COUNTERS, SYSTEM_TIMES)


def row_state(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """The mergeable state behind ``latest_row`` by time: the newest ``cols`` per key."""
    return reduce_rows(df, keys, [F.col("timestamp"), _row_hash(df, cols)], [Part("row", F.struct(*[F.col(c) for c in cols]))])


def row_from_state(state: DataFrame, keys: list[str]) -> DataFrame:
    return state.select(*keys, "row.v.*")


def station_sources(docked: DataFrame, approach: DataFrame, location: DataFrame):
    d = docked.select(*STATION_COLS)
    a = approach.select(
        "timestamp", "StarSystem", "SystemAddress", F.col("Name").alias("StationName"),
        F.lit("Empty").alias("StationType"), "MarketId", F.lit(None).cast("double").alias("DistFromStarLS"),
        "StarPos", "StationAllegiance", "StationEconomies", "StationEconomy", "StationFaction",
        "StationGovernment", "StationServices", F.lit(None).cast(S.LANDING_PADS).alias("LandingPads"),
    )
    loc = location.filter((F.col("Docked") == F.lit(True)) & F.col("StationName").isNotNull()).select(
        "timestamp", "StarSystem", "SystemAddress", "StationName", "StationType", "MarketId", "DistFromStarLS",
        "StarPos", F.lit(None).cast("string").alias("StationAllegiance"), "StationEconomies", "StationEconomy",
        "StationFaction", "StationGovernment", "StationServices",
        F.lit(None).cast(S.LANDING_PADS).alias("LandingPads"),
    )
    return d, a, loc


STATION_VALUES = [c for c in STATION_COLS if c not in STATION_KEYS and c != "timestamp"]


def _station_stages(d: DataFrame | None = None, a: DataFrame | None = None, loc: DataFrame | None = None) -> list[Stage]:
    """Latest known value: a newer row's non-NULL values win, NULLs keep the old
    value; the approach feed's placeholder type and distance never replace known
    ones."""
    cols, placeholders = STATION_VALUES, ["StationType", "DistFromStarLS"]
    return [Stage(d, prefer_new=cols, fill_if_null=["LandingPads"]),
            Stage(a, keep_old=[*placeholders, "LandingPads"], prefer_new=[c for c in cols if c not in placeholders]),
            Stage(loc, prefer_new=cols)]


def station_state(docked: DataFrame, approach: DataFrame, location: DataFrame) -> DataFrame:
    """The mergeable state behind :func:`station_latest` over whole logs."""
    return stage_state(_station_stages(*station_sources(docked, approach, location)), STATION_KEYS, "timestamp", STATION_VALUES)


def station_from_state(state: DataFrame) -> DataFrame:
    return stage_rows(state, _station_stages(), STATION_KEYS, "timestamp", STATION_VALUES).select(*STATION_COLS)


def station_latest(target: DataFrame | None, docked: DataFrame, approach: DataFrame, location: DataFrame,
                   parity: bool = False, incremental: bool = True) -> DataFrame:
    """Q-B: merge docked, settlement approaches and docked locations into the
    station snapshot.

    ``parity=True``: a newer docking overwrites pads even with NULL (Q5), an
    approach resets type/distance and a location resets allegiance (Q4).
    and only rows newer than ``max(target.timestamp) - 1 hour`` count, so what
    is lost depends on how batches are split.
    Default keeps the latest known value of every column and loses no row.
    """
    d, a, loc = station_sources(docked, approach, location)
    if target is None:
        target = empty_like(d, STATION_COLS)
    cols = STATION_VALUES
    if parity:
        stages = [Stage(d, fill_if_null=["LandingPads"]),
                  Stage(a, keep_old=["LandingPads"]),
                  Stage(loc, keep_old=["LandingPads"])]
    else:
        stages = _station_stages(d, a, loc)
    out = merge_latest(target, stages, STATION_KEYS, "timestamp", cols,
                       cutoff=watermark_cutoff(target, "timestamp") if parity else None, incremental=incremental)
    return out.select(*STATION_COLS)


def systems(populated: DataFrame, sys_latest: DataFrame, stations: DataFrame) -> DataFrame:
    """Q-C: populated systems with powerplay data, corrected control
    progress (Q11) and a stronghold-carrier flag (EXISTS -> ExistenceJoin)."""
    pp = sys_latest.alias("pp")
    j = populated.alias("sys").join(pp, F.col("pp.SystemAddress") == F.col("sys.Id64"), "inner")
    st = stations.alias("st")
    carrier = st.where(
        (F.col("st.SystemAddress") == F.col("sys.Id64").outer())
        & F.col("st.StationName").isin(*S.STRONGHOLD_CARRIER_NAMES)
    ).exists()
    state = F.coalesce(F.col("pp.PowerplayState"), F.lit("Unoccupied"))
    return j.select(
        F.col("sys.Id64").alias("SystemAddress"),
        F.col("sys.Name").alias("StarSystem"),
        F.col("sys.StarPos").alias("StarPos"),
        F.col("pp.ControllingPower").alias("ControllingPower"),
        state.alias("PowerplayState"),
        carrier.alias("PowerplayHasStrongholdCarrier"),
        fix_control_progress(F.col("pp.PowerplayStateControlProgress"), state).alias("PowerplayStateControlProgress"),
        or_empty(F.col("pp.Powers"), "string").alias("Powers"),
        F.col("pp.PowerplayStateReinforcement").alias("PowerplayStateReinforcement"),
        F.col("pp.PowerplayStateUndermining").alias("PowerplayStateUndermining"),
        F.col("pp.PowerplayConflictProgress").alias("PowerplayConflictProgress"),
        F.col("pp.timestamp").alias("LastUpdate"),
    )


def powerplay_support(sys_latest: DataFrame, power: str | None = "Li Yong-Rui") -> DataFrame:
    """Q-D: supporting -> supported system pairs (gridded range join)."""
    s = sys_latest.filter(F.col("Population") > 0).select(
        F.col("SystemAddress").alias("system_id"),
        F.col("StarPos").alias("star_pos"),
        F.coalesce("PowerplayState", F.lit("Unoccupied")).alias("state"),
        F.col("ControllingPower").alias("controlling_power"),
        or_empty("Powers", "string").alias("powers"),
    )
    pairs = support_pairs(s, power)
    return pairs.select(F.col("supporting_id").alias("SupportingSystemAddress"),
                        F.col("supported_id").alias("SupportedSystemAddress"),
                        F.col("distance").alias("Distance"))


def infra_failures(sys_latest: DataFrame, stations: DataFrame, commodities: DataFrame,
                   systems_mart: DataFrame, goods=("gold", "silver", "palladium")) -> DataFrame:
    """Q-E: stations of factions in InfrastructureFailure that stock precious goods."""
    inf = (inline_rows(sys_latest.select("SystemAddress", "timestamp", "Factions"), "Factions")
           .filter(has_any("ActiveStates", ["InfrastructureFailure"]))
           .select("SystemAddress", F.col("Name").alias("FactionName"),
                   F.col("timestamp").alias("InfraFailTimestamp")).distinct())
    st = stations.filter(F.col("MarketId").isNotNull()).select(
        "SystemAddress", "MarketId", "StationName", "StarSystem", F.col("StationFaction.Name").alias("FactionName"))
    infra_st = st.join(inf, ["SystemAddress", "FactionName"])
    comm = inline_rows(commodities.select(F.col("MarketId").alias("cMarketId"), "Commodities",
                                          F.col("timestamp").alias("MarketTimestamp")), "Commodities")
    swc = infra_st.join(comm, F.col("MarketId") == F.col("cMarketId")).filter(
        F.col("Name").isin(*goods) & (F.col("Stock") > 0))
    wash = swc.groupBy("StarSystem", "SystemAddress", "StationName", "MarketId", "FactionName").agg(
        F.sort_array(F.collect_list(F.array("Name", F.col("BuyPrice").cast("string"),
                                            F.col("Stock").cast("string")))).alias("Commodities"),
        F.max("InfraFailTimestamp").alias("InfraFailTimestamp"),
        F.max("MarketTimestamp").alias("MarketTimestamp"),
    )
    s = systems_mart.select("SystemAddress", "ControllingPower", "PowerplayState")
    return wash.join(s, "SystemAddress").orderBy(F.col("InfraFailTimestamp").desc_nulls_last(),
                                                 F.col("MarketTimestamp").desc_nulls_last())


def enclave_activity(jl: DataFrame, names: DataFrame, parity: bool = False, chunked: bool = True) -> DataFrame:
    """Q-F: cleaned weekly counter series of the listed systems (windows per
    (system, day) with carried boundaries unless ``chunked=False``)."""
    listed = jl.join(names.select(F.col("Name").alias("StarSystem")).distinct(), "StarSystem", "left_semi")
    clean = clean_counter_series(
        listed, key="StarSystem", ts="timestamp", state="PowerplayState",
        r="PowerplayStateReinforcement", u="PowerplayStateUndermining",
        progress="PowerplayConflictProgress", control="PowerplayStateControlProgress", parity=parity,
        chunk=day_chunk("timestamp") if chunked else None,
    )
    return clean.select(
        "timestamp", "StarSystem", "ControllingPower", or_empty("Powers", "string").alias("Powers"), "PowerplayState",
        "PowerplayConflictProgress",
        fix_control_progress("PowerplayStateControlProgress", "PowerplayState").alias("PowerplayStateControlProgress"),
        F.col("PowerplayStateReinforcement").alias("reinforcement"),
        F.col("PowerplayStateUndermining").alias("undermining"),
    ).orderBy("StarSystem", "timestamp")


def settlements(docked: DataFrame, approach: DataFrame) -> DataFrame:
    """Q-G: newest docking per on-foot settlement with its newest body name."""
    d = latest_row(docked.filter(F.col("StationType") == "OnFootSettlement"), STATION_KEYS, ["timestamp"],
                   ["MarketId", "StationEconomy", "StationGovernment", "StationFaction", "LandingPads"])
    b = latest_row(approach.select("SystemAddress", F.col("Name").alias("StationName"), "timestamp", "BodyName"),
                   STATION_KEYS, ["timestamp"], ["BodyName"])
    out = d.join(b, STATION_KEYS, "left")
    return out.select(
        "SystemAddress", "StationName", "MarketId", F.coalesce("BodyName", F.lit("")).alias("BodyName"),
        F.col("StationFaction.Name").alias("FactionName"), "StationEconomy", "StationGovernment", "LandingPads",
    ).orderBy("SystemAddress", "StationName")


def factions(jl: DataFrame, since: str | None = None) -> DataFrame:
    """Q-H: one flat row per (observation, faction); three columns stay nested."""
    src = jl if since is None else jl.filter(F.col("timestamp") >= F.lit(since).cast("timestamp_ntz"))
    u = src.select("timestamp", "StarSystem", "SystemAddress", "SystemFaction", "SystemAllegiance", "SystemEconomy",
                   "SystemGovernment", "SystemSecondEconomy", "SystemSecurity", F.explode("Factions").alias("t"))
    return u.select(
        "timestamp", "StarSystem", "SystemAddress",
        F.col("SystemFaction.Name").alias("SystemFactionName"),
        F.col("SystemFaction.FactionState").alias("SystemFactionState"),
        "SystemAllegiance", "SystemEconomy", "SystemGovernment", "SystemSecondEconomy", "SystemSecurity",
        F.col("t.Name").alias("FactionName"), F.col("t.Allegiance").alias("FactionAllegiance"),
        F.col("t.FactionState").alias("FactionState"), F.col("t.Government").alias("FactionGovernment"),
        F.col("t.Influence").alias("Influence"), F.col("t.Happiness").alias("Happiness"),
        F.col("t.ActiveStates").alias("ActiveStates"), F.col("t.RecoveringStates").alias("RecoveringStates"),
        F.col("t.PendingStates").alias("PendingStates"),
    )


def saa_signals_latest(saa: DataFrame) -> DataFrame:
    """View: newest signals per (system, body) — DISTINCT ON with order."""
    cols = [c for c in saa.columns if c not in ("SystemAddress", "BodyName", "file")]
    return latest_row(saa.drop("file"), ["SystemAddress", "BodyName"], ["timestamp"], cols)
