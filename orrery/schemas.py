"""Domain schemas and enum domains of the telemetry feed (§1 of the survey).

Target schemas are fixed; raw messages are parsed into these types at
ingest, never inferred.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Allowed values of each enumerated field, as accepted at import.
POWER = [
    "Aisling Duval",
    "Archon Delaine",
    "A. Lavigny-Duval",
    "Denton Patreus",
    "Edmund Mahon",
    "Felicia Winters",
    "Li Yong-Rui",
    "Pranav Antal",
    "Yuri Grom",
    "Zemina Torval",
    "Nakato Kaine",
    "Jerome Archer",
    "Zachary Hudson",
]
# Accepted in old messages, but no longer a power.
FORMER_POWERS = ["Zachary Hudson"]
POWERPLAYSTATE = [
    "Unoccupied", "Exploited", "Fortified", "Stronghold",
    "Contested", "Controlled", "HomeSystem", "InPrepareRadius", "Prepared", "Turmoil",
]
ALLEGIANCE = ["Alliance", "Thargoid", "Empire", "PilotsFederation", "Federation", "Independent", "Guardian", "None"]
ECONOMY = [
    "Service", "HighTech", "Tourism", "Military", "Industrial", "Extraction", "Colony", "None", "Refinery",
    "Agri", "Terraforming", "Undefined", "Carrier", "Rescue", "Prison", "Engineer", "Repair", "Damaged", "Unknown",
]
GOVERNMENT = [
    "Cooperative", "Communism", "PrisonColony", "Patronage", "None", "Feudal", "Democracy", "Confederacy",
    "Dictatorship", "Anarchy", "Theocracy", "Corporate", "Prison", "Engineer", "Carrier", "Megaconstruction",
    "Undefined",
]
SECURITY = ["Low", "Medium", "High", "Anarchy", "Lawless", "Unknown"]
BODY_TYPE = ["Station", "AsteroidCluster", "Planet", "Star", "StellarRing", "Null", "PlanetaryRing"]
STATION_TYPE = [
    "Outpost", "Coriolis", "CraterPort", "CraterOutpost", "DockablePlanetStation", "PlanetaryConstructionDepot",
    "Ocellus", "SpaceConstructionDepot", "FleetCarrier", "OnFootSettlement", "SurfaceStation", "Orbis",
    "AsteroidBase", "MegaShip", "Bernal", "Empty", "Dodec", "GameplayPOI",
]
CARRIER_DOCKING_ACCESS = ["all", "none", "friends", "squadron", "squadronfriends"]
SIGNAL_TYPE = [
    "Biological", "Geological", "Rhodplumsite", "LowTemperatureDiamond", "Serendibite", "Benitoite",
    "Grandidierite", "Guardian", "Other", "Tritium", "Human", "PlanetAnomaly", "Bromellite", "Musgravite", "Opal",
    "Monazite", "Painite", "Thargoid", "Platinum", "Alexandrite",
]
FACTION_STATE = [
    "CivilLiberty", "Terrorism", "PirateAttack", "Boom", "Outbreak", "CivilWar", "Election", "NaturalDisaster",
    "War", "Lockdown", "Drought", "Expansion", "Blight", "PublicHoliday", "Investment", "InfrastructureFailure",
    "Retreat", "CivilUnrest", "Bust", "Famine", "None",
]
HAPPINESS = ["Elated", "Happy", "Discontented", "Unhappy", "Despondent", "Unknown"]
COMMODITY_BRACKET = ["None", "Low", "Med", "High"]
CONFLICT_STATUS = ["active", "pending", ""]
CONFLICT_WAR_TYPE = ["civilwar", "war", "election"]
RESERVE_LEVEL = ["Pristine", "Depleted", "Common", "Low", "Major"]
BELT_OR_RING_TYPE = ["Icy", "Rocky", "Metal Rich", "Metallic"]
FSS_SIGNAL_TYPE = [
    "FleetCarrier", "NavBeacon", "StationONeilOrbis", "Generic", "Titan", "Settlement", "StationMegaShip",
    "Codex", "System", "StationCoriolis", "Megaship", "Outpost", "TouristBeacon", "ResourceExtraction",
    "StationAsteroid", "Combat", "POI", "USS", "StationBernalSphere", "StationONeilCylinder", "Installation",
    "ConstructionDepot", "Empty", "SquadronCarrier", "Port", "StationDodec",
]

# Game versions of server-side sources accepted whatever their number.
SERVER_SOURCES = ["CAPI-journal", "CAPI-Live-market", "CAPI-market"]
MIN_CLIENT_MAJOR = 4

# Localised names of the stronghold carrier station.
STRONGHOLD_CARRIER_NAMES = [
    "Stronghold Carrier", "Porte-vaisseaux de forteresse", "Transportadora da potência",
    "Носитель-база", "Portanaves bastión", "Hochburg-Carrier",
]

S, L, I, D, B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
TS = T.TimestampNTZType()


def _st(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


STATE_TREND = _st(("State", S), ("Trend", T.ShortType()))
FACTION_DETAIL = _st(
    ("Name", S), ("Allegiance", S), ("FactionState", S), ("Government", S), ("Influence", D),
    ("Happiness", S), ("ActiveStates", T.ArrayType(S)),
    ("RecoveringStates", T.ArrayType(STATE_TREND)), ("PendingStates", T.ArrayType(STATE_TREND)),
)
FACTION_REF = _st(("Name", S), ("FactionState", S))
CONFLICT_SIDE = _st(("Name", S), ("Stake", S), ("WonDays", I))
CONFLICT = _st(("Faction1", CONFLICT_SIDE), ("Faction2", CONFLICT_SIDE), ("Status", S), ("WarType", S))
CONFLICT_PROGRESS = _st(("Power", S), ("ConflictProgress", D))
ECONOMY_SHARE = _st(("Name", S), ("Proportion", D))
LANDING_PADS = _st(("Large", I), ("Medium", I), ("Small", I))
BELT_OR_RING = _st(("name", S), ("type", S))
BODY = _st(
    ("id64", L), ("bodyId", I), ("name", S), ("type", S), ("subType", S), ("distanceToArrival", D),
    ("belts", T.ArrayType(BELT_OR_RING)), ("rings", T.ArrayType(BELT_OR_RING)), ("reserveLevel", S),
)
COMMODITY = _st(
    ("Name", S), ("BuyPrice", I), ("SellPrice", I), ("MeanPrice", I), ("Stock", I), ("StockBracket", S),
    ("Demand", I), ("DemandBracket", S), ("StatusFlags", T.ArrayType(S)),
)
SIGNAL_COUNT = _st(("Count", I), ("Type", S))
FSS_SIGNAL = _st(("IsStation", B), ("SignalName", S), ("SignalType", S))

# Columns shared by the jump log and the undocked part of the location log.
JUMP_COLUMNS = [
    ("timestamp", TS), ("StarSystem", S), ("SystemAddress", L), ("Body", S), ("BodyId", I), ("Population", L),
    ("PowerplayState", S), ("ControllingPower", S), ("Powers", T.ArrayType(S)),
    ("PowerplayConflictProgress", T.ArrayType(CONFLICT_PROGRESS)), ("PowerplayStateControlProgress", D),
    ("PowerplayStateReinforcement", I), ("PowerplayStateUndermining", I), ("Factions", T.ArrayType(FACTION_DETAIL)),
    ("SystemFaction", FACTION_REF), ("SystemAllegiance", S), ("SystemEconomy", S), ("SystemGovernment", S),
    ("SystemSecondEconomy", S), ("SystemSecurity", S), ("StarPos", T.ArrayType(D)),
    ("Conflicts", T.ArrayType(CONFLICT)),
]
JUMPS = _st(*JUMP_COLUMNS)

STATION_COLUMNS = [
    ("timestamp", TS), ("StarSystem", S), ("SystemAddress", L), ("StationName", S), ("StationType", S),
    ("MarketId", L), ("DistFromStarLS", D), ("StarPos", T.ArrayType(D)), ("StationAllegiance", S),
    ("StationEconomies", T.ArrayType(ECONOMY_SHARE)), ("StationEconomy", S), ("StationFaction", FACTION_REF),
    ("StationGovernment", S), ("StationServices", T.ArrayType(S)), ("LandingPads", LANDING_PADS),
]
STATION = _st(*STATION_COLUMNS)
