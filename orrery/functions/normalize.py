"""Normalisers of raw feed strings (N1-N12), as JVM column expressions.

Raw enum strings arrive as localisation keys (``$economy_HighTech;``,
``$government_Democracy;``, ``$SYSTEM_SECURITY_high;``); these functions map
them to the clean domain values, then :mod:`orrery.functions.validate`
checks the domain.  ``LIKE`` keeps its SQL meaning: ``_`` is a wildcard.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orrery import schemas as S
from orrery.functions.validate import validate_enum, validate_enum_list


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _strip(v: Column, prefix_regex: str) -> Column:
    return F.regexp_replace(F.regexp_replace(v, prefix_regex, ""), ";$", "")


def economy(col: str | Column) -> Column:
    """Unknown keys and anything unrecognised (NULL included) -> 'Unknown'."""
    v = _c(col)
    return (
        F.when(v.like("$economy_UNKNOWN%"), "Unknown")
        .when(v.like("$economy_%"), _strip(v, r"^\$economy_"))
        .otherwise("Unknown")
    )


def government(col: str | Column) -> Column:
    """Strip ``$government_`` and the trailing ``;``."""
    return _strip(_c(col), r"^\$government_")


def allegiance(col: str | Column) -> Column:
    """N4: '' -> 'None'; strip ``$faction_`` and ``;``."""
    v = _c(col)
    return F.when(v == "", "None").otherwise(_strip(v, r"^\$faction_"))


def security(col: str | Column) -> Column:
    """Classify by substring; default 'Unknown'.

    Fixed values: the anarchy key is matched with the odd-case spelling the
    feed uses (``GAlAXY``).
    """
    v = _c(col)
    return (
        F.when(v.like("%$SYSTEM_SECURITY_high%"), "High")
        .when(v.like("%$SYSTEM_SECURITY_low%"), "Low")
        .when(v.like("%$SYSTEM_SECURITY_medium%"), "Medium")
        .when(v.like("%$GAlAXY_MAP_INFO_state_anarchy%"), "Anarchy")
        .when(v.like("%$GALAXY_MAP_INFO_state_lawless%"), "Lawless")
        .otherwise("Unknown")
    )


def faction_ref(col: str | Column) -> Column:
    """``{Name, FactionState}`` with FactionState defaulting to 'None'."""
    v = _c(col)
    return F.struct(v["Name"].alias("Name"), F.coalesce(v["FactionState"], F.lit("None")).alias("FactionState"))


def station_type(col: str | Column) -> Column:
    """N7: '' -> 'Empty', 'Megaship' -> 'MegaShip'."""
    v = _c(col)
    return F.when(v == "", "Empty").when(v == "Megaship", "MegaShip").otherwise(v)


def economies(col: str | Column, policy: str = "fail") -> Column:
    """``[{name, proportion}]`` -> ``[{Name, Proportion}]`` with N1 + V1."""
    return F.transform(
        _c(col),
        lambda e: F.struct(
            validate_enum(economy(e["name"]), S.ECONOMY, "Economies.Name", policy).alias("Name"),
            e["proportion"].cast("double").alias("Proportion"),
        ),
    )


def signal_counts(col: str | Column, policy: str = "fail") -> Column:
    """``[{Count, Type}]``: count to int, type key stripped, 'tritium' fixed."""
    def one(s):
        t = s["Type"]
        clean = F.when(t == "tritium", "Tritium").otherwise(_strip(t, r"^\$SAA_SignalType_"))
        return F.struct(
            s["Count"].cast("int").alias("Count"),
            validate_enum(clean, S.SIGNAL_TYPE, "Signals.Type", policy).alias("Type"),
        )

    return F.transform(_c(col), one)


def conflicts(col: str | Column, policy: str = "fail") -> Column:
    """Conflict list -> nested struct with validated Status / WarType.

    Status '' is a legal value and validates to NULL like any empty enum.
    """
    def side(x):
        return F.struct(
            x["Name"].alias("Name"), x["Stake"].alias("Stake"), x["WonDays"].cast("int").alias("WonDays")
        )

    return F.transform(
        _c(col),
        lambda c: F.struct(
            side(c["Faction1"]).alias("Faction1"),
            side(c["Faction2"]).alias("Faction2"),
            validate_enum(c["Status"], S.CONFLICT_STATUS, "Conflict.Status", policy).alias("Status"),
            validate_enum(c["WarType"], S.CONFLICT_WAR_TYPE, "Conflict.WarType", policy).alias("WarType"),
        ),
    )


def bracket(col: Column) -> Column:
    """Bracket code '0'/'' -> 'None', '1' Low, '2' Med, '3' High, else NULL."""
    v = col.cast("string")
    return (
        F.when(v.isin("0", ""), "None").when(v == "1", "Low").when(v == "2", "Med").when(v == "3", "High")
    )


def commodities(col: str | Column, policy: str = "fail") -> Column:
    """Market commodity list with brackets and status-flag text fixes."""
    def one(c):
        return F.struct(
            c["name"].alias("Name"),
            c["buyPrice"].cast("int").alias("BuyPrice"),
            c["sellPrice"].cast("int").alias("SellPrice"),
            c["meanPrice"].cast("int").alias("MeanPrice"),
            c["stock"].cast("int").alias("Stock"),
            validate_enum(bracket(c["stockBracket"]), S.COMMODITY_BRACKET, "Commodities.StockBracket",
                          policy).alias("StockBracket"),
            c["demand"].cast("int").alias("Demand"),
            validate_enum(bracket(c["demandBracket"]), S.COMMODITY_BRACKET, "Commodities.DemandBracket",
                          policy).alias("DemandBracket"),
            F.transform(
                c["statusFlags"],
                lambda f: F.replace(F.replace(f, F.lit("rare"), F.lit("Rare")), F.lit("High demand"),
                                    F.lit("High Demand")),
            ).alias("StatusFlags"),
        )

    return F.transform(_c(col), one)


def happiness(col: Column) -> Column:
    """Happiness band 1..5 -> label, anything else 'Unknown'."""
    # Band keys and their labels.
    bands = [
        ("$Faction_HappinessBand1;", "Elated"),
        ("$Faction_HappinessBand2;", "Happy"),
        ("$Faction_HappinessBand3;", "Discontented"),
        ("$Faction_HappinessBand4;", "Unhappy"),
        ("$Faction_HappinessBand5;", "Despondent"),
    ]
    e = None
    for key, label in bands:
        e = F.when(col == key, label) if e is None else e.when(col == key, label)
    return e.otherwise("Unknown")


def faction_details(col: str | Column, policy: str = "fail") -> Column:
    """Faction detail list: enums normalised and validated, active
    states reduced to their names."""
    def one(f):
        return F.struct(
            f["Name"].alias("Name"),
            validate_enum(allegiance(f["Allegiance"]), S.ALLEGIANCE, "Factions.Allegiance", policy).alias("Allegiance"),
            validate_enum(f["FactionState"], S.FACTION_STATE, "Factions.FactionState", policy).alias("FactionState"),
            validate_enum(government(f["Government"]), S.GOVERNMENT, "Factions.Government", policy).alias("Government"),
            f["Influence"].cast("double").alias("Influence"),
            validate_enum(happiness(f["Happiness"]), S.HAPPINESS, "Factions.Happiness", policy).alias("Happiness"),
            F.transform(f["ActiveStates"], lambda s: s["State"]).alias("ActiveStates"),
            f["RecoveringStates"].alias("RecoveringStates"),
            f["PendingStates"].alias("PendingStates"),
        )

    return F.transform(_c(col), one)


def fss_signals(col: str | Column, policy: str = "fail") -> Column:
    """``IsStation`` parsed from text, SignalType '' -> 'Empty' then V1."""
    def one(s):
        t = s["SignalType"]
        return F.struct(
            (s["IsStation"].cast("string") == "true").alias("IsStation"),
            s["SignalName"].alias("SignalName"),
            validate_enum(F.when(t == "", "Empty").otherwise(t), S.FSS_SIGNAL_TYPE, "SignalType",
                          policy).alias("SignalType"),
        )

    return F.transform(_c(col), one)


def powers(col: str | Column, policy: str = "fail") -> Column:
    """V2 over the Powers list."""
    return validate_enum_list(col, S.POWER, "Powers", policy)
