"""Hand-made raw feed files (FIXTURES.md §1-§3) written to a scratch folder."""

from __future__ import annotations

import gzip
import json
import os

GOOD = "4.0.0.1904"


def envelope(message: dict, gameversion: str = GOOD, gateway: str | None = None) -> str:
    gw = gateway or message.get("timestamp")
    return json.dumps({"header": {"gameversion": gameversion, "gatewayTimestamp": gw}, "message": message})


def faction(name, state="None", active=(), happiness="$Faction_HappinessBand2;", influence=0.3):
    return {
        "Name": name, "Allegiance": "$faction_Federation;", "FactionState": state,
        "Government": "$government_Democracy;", "Influence": influence, "Happiness": happiness,
        "ActiveStates": [{"State": s} for s in active],
    }


def system_msg(ts, name, addr, state, power=None, powers=(), cp=None, r=None, u=None, pos=(0.0, 0.0, 0.0),
               factions=(), conflict=(), population=1000):
    m = {
        "timestamp": ts, "StarSystem": name, "SystemAddress": addr, "Body": name, "BodyID": 0,
        "Population": population, "PowerplayState": state, "Powers": list(powers),
        "SystemAllegiance": "$faction_Federation;", "SystemEconomy": "$economy_HighTech;",
        "SystemGovernment": "$government_Democracy;", "SystemSecondEconomy": "$economy_UNKNOWN_x;",
        "SystemSecurity": "$SYSTEM_SECURITY_high;", "StarPos": list(pos),
        "Factions": list(factions), "SystemFaction": {"Name": "F1", "FactionState": "Boom"},
        "PowerplayConflictProgress": [{"Power": p, "ConflictProgress": v} for p, v in conflict],
    }
    if power is not None:
        m["ControllingPower"] = power
    if cp is not None:
        m["PowerplayStateControlProgress"] = cp
    if r is not None:
        m["PowerplayStateReinforcement"] = r
    if u is not None:
        m["PowerplayStateUndermining"] = u
    return m


def write_lines(folder: str, name: str, lines: list[str], gz: bool = False) -> str:
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name + (".gz" if gz else ""))
    data = ("\n".join(lines) + "\n").encode()
    with (gzip.open(path, "wb") if gz else open(path, "wb")) as f:
        f.write(data)
    return path


def build_feed(spark, d):
    """Ingest a small hand-made feed; returns the ingested tables."""
    from orrery.sources import ndjson

    infra = faction("Fac A", active=["InfrastructureFailure"])
    jumps = [
        system_msg("2025-09-03T10:00:00Z", "Alpha", 1, "Stronghold", power="Li Yong-Rui", cp=0.5, r=10, u=1,
                   pos=(0, 0, 0), factions=[infra]),
        system_msg("2025-09-03T12:00:00Z", "Alpha", 1, "Stronghold", power="Li Yong-Rui", cp=None, r=20, u=2,
                   pos=(0, 0, 0), factions=[infra]),
        system_msg("2025-09-03T10:00:00Z", "Beta", 2, "Unoccupied", powers=["Li Yong-Rui", "Yuri Grom"],
                   pos=(25, 0, 0), r=0, u=0),
        system_msg("2025-09-03T10:00:00Z", "Gamma", 3, "Exploited", power="Li Yong-Rui",
                   powers=["Li Yong-Rui"], cp=12271.9, pos=(0, 31, 0), r=5, u=5),
    ]
    write_lines(d, "FSDJump-2025-09-03.jsonl", [envelope(m) for m in jumps], gz=True)
    loc_docked = dict(system_msg("2025-09-03T09:00:00Z", "Alpha", 1, "Stronghold", power="Li Yong-Rui"),
                      Docked=True, StationName="Port A", StationType="Coriolis", MarketID=100,
                      StationFaction={"Name": "Fac A"}, StationEconomy="$economy_Industrial;",
                      StationGovernment="$government_Democracy;")
    loc_undocked = dict(system_msg("2025-09-03T08:00:00Z", "Delta", 4, "Fortified", power="Yuri Grom", cp=0.1),
                        Docked=False)
    write_lines(d, "Location-2025-09-03.jsonl", [envelope(loc_docked), envelope(loc_undocked)])
    docked = [
        {"timestamp": "2025-09-03T11:00:00Z", "StarSystem": "Alpha", "SystemAddress": 1, "StationName": "Port A",
         "StationType": "Coriolis", "MarketID": 100, "StationFaction": {"Name": "Fac A"},
         "LandingPads": {"Large": 2, "Medium": 4, "Small": 8}, "StationEconomy": "$economy_Industrial;"},
        {"timestamp": "2025-09-03T11:30:00Z", "StarSystem": "Alpha", "SystemAddress": 1, "StationName": "Camp",
         "StationType": "OnFootSettlement", "MarketID": 101, "StationFaction": {"Name": "Fac B"},
         "StationEconomy": "$economy_Agri;", "LandingPads": {"Large": 0, "Medium": 1, "Small": 2}},
        {"timestamp": "2025-09-03T11:30:00Z", "StarSystem": "Alpha", "SystemAddress": 1,
         "StationName": "Stronghold Carrier", "StationType": "MegaShip", "MarketID": 102},
    ]
    write_lines(d, "Docked-2025-09-03.jsonl", [envelope(m) for m in docked])
    approach = [{"timestamp": "2025-09-03T11:20:00Z", "StarSystem": "Alpha", "SystemAddress": 1, "Name": "Camp",
                 "BodyName": "Alpha 1 a", "MarketID": 101}]
    write_lines(d, "ApproachSettlement-2025-09-03.jsonl", [envelope(m) for m in approach])
    market = {"timestamp": "2025-09-03T11:40:00Z", "systemName": "Alpha", "stationName": "Port A", "marketId": 100,
              "stationType": None, "commodities": [
                  {"name": "gold", "buyPrice": 9000, "stock": 5, "stockBracket": 2, "demandBracket": ""},
                  {"name": "silver", "buyPrice": 5000, "stock": 0, "stockBracket": 0, "demandBracket": 0},
                  {"name": "water", "buyPrice": 1, "stock": 9, "stockBracket": 3, "demandBracket": 1,
                   "statusFlags": ["rare", "High demand"]}]}
    write_lines(d, "Commodity-2025-09-03.jsonl", [envelope(market, gameversion="CAPI-Live-market")])
    dump = [{"id64": i, "name": n, "coords": {"x": p[0], "y": p[1], "z": p[2]}, "bodies": []}
            for i, n, p in [(1, "Alpha", (0, 0, 0)), (2, "Beta", (25, 0, 0)), (3, "Gamma", (0, 31, 0))]]
    with open(os.path.join(d, "systemsPopulated.json"), "w") as f:
        json.dump(dump, f)
    with open(os.path.join(d, "enclave.csv"), "w") as f:
        f.write("Name\nAlpha\nGamma\n")

    def load(glob):
        return ndjson.gate(ndjson.read_lines(spark, d, glob=glob))

    return {
        "jumps": ndjson.jumps(load("FSDJump*")),
        "location": ndjson.location(load("Location*")),
        "docked": ndjson.docked(load("Docked*")),
        "approach": ndjson.approach_settlement(load("ApproachSettlement*")),
        "commodities": ndjson.commodities(load("Commodity*")),
        "populated": ndjson.systems_dump(spark, os.path.join(d, "systemsPopulated.json")),
        "names": spark.read.option("header", True).csv(os.path.join(d, "enclave.csv")),
    }
