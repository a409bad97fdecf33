"""Action classifier and rule join (J14, Q-S, Q-T, A16, O5, X21).

The rule catalogue is a fixed 29-row dimension.  Its size does not grow
with the data, so it is broadcast; systems join it on the action name (an
equi-join after expanding each rule into the actions it is flagged for),
never through a cross join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The activity catalogue, one tuple per rule in catalogue order:
# (activity, category, acquisition, reinforcement, undermining, legal,
#  allowed when undermining a stronghold-carrier system, requirement,
#  bonus powers when acquiring, bonus powers when reinforcing,
#  bonus powers when undermining, vulnerable powers).
RULES = [
    ("Bounty Hunting", "Combat", True, True, True, True, False, "archon_if_undermine",
     ["A. Lavigny-Duval", "Denton Patreus", "Jerome Archer", "Yuri Grom"],
     ["A. Lavigny-Duval", "Denton Patreus", "Jerome Archer", "Yuri Grom"],
     [],
     ["Archon Delaine"]),
    ("Commit Crimes", "Combat", False, False, True, False, False, "always",
     [],
     [],
     ["Archon Delaine"],
     ["A. Lavigny-Duval", "Denton Patreus", "Jerome Archer", "Yuri Grom"]),
    ("Complete Restore/Reactivate Missions", "On Foot", True, True, False, True, False, "always",
     ["Felicia Winters", "Nakato Kaine"],
     ["Aisling Duval", "Edmund Mahon", "Felicia Winters", "Nakato Kaine", "Pranav Antal"],
     ["Edmund Mahon", "Nakato Kaine"],
     []),
    ("Complete Support Missions", "Misc", True, True, True, True, False, "conflict_if_acquire",
     [],
     [],
     [],
     []),
    ("Collect Salvage", "Misc", False, True, False, True, False, "always",
     [],
     ["Archon Delaine", "Denton Patreus", "Felicia Winters", "Jerome Archer", "Pranav Antal", "Yuri Grom",
      "Zemina Torval"],
     [],
     []),
    ("Collect Salvage", "Misc", False, False, True, True, False, "always",
     [],
     [],
     ["Felicia Winters", "Pranav Antal"],
     []),
    ("Exobiology", "Misc", False, True, False, True, False, "always",
     [],
     ["Edmund Mahon", "Li Yong-Rui", "Nakato Kaine", "Pranav Antal"],
     [],
     []),
    ("Exploration Data", "Misc", False, True, False, True, False, "always",
     [],
     ["Aisling Duval", "Edmund Mahon", "Li Yong-Rui", "Nakato Kaine", "Pranav Antal", "Zemina Torval"],
     [],
     []),
    ("Flood markets with low value goods", "Hauling", True, False, False, True, False, "conflict_if_acquire",
     [],
     [],
     [],
     []),
    ("Flood markets with low value goods", "Hauling", False, False, True, True, False, "always",
     [],
     [],
     ["Li Yong-Rui", "Zemina Torval"],
     ["Edmund Mahon", "Felicia Winters", "Li Yong-Rui", "Nakato Kaine", "Pranav Antal"]),
    ("Holoscreen Hacking", "Misc", True, True, True, False, True, "always",
     ["Aisling Duval", "A. Lavigny-Duval", "Denton Patreus", "Felicia Winters", "Jerome Archer", "Li Yong-Rui",
      "Nakato Kaine"],
     ["Aisling Duval", "Denton Patreus", "Jerome Archer"],
     ["Aisling Duval", "A. Lavigny-Duval", "Jerome Archer", "Li Yong-Rui"],
     ["Aisling Duval", "Edmund Mahon", "Nakato Kaine"]),
    ("Power Kills", "Combat", True, True, True, False, True, "always",
     [],
     ["Archon Delaine", "A. Lavigny-Duval", "Denton Patreus", "Jerome Archer", "Yuri Grom"],
     ["Archon Delaine", "A. Lavigny-Duval", "Denton Patreus", "Jerome Archer", "Yuri Grom"],
     ["Archon Delaine"]),
    ("Retrieve Power Goods", "On Foot", True, False, False, False, False, "always",
     [],
     [],
     [],
     []),
    ("Retrieve Power Goods", "On Foot", False, False, True, False, False, "always",
     [],
     [],
     [],
     []),
    ("Scan Datalinks", "Misc", True, True, True, True, False, "always",
     ["Archon Delaine", "Jerome Archer", "Pranav Antal", "Yuri Grom", "Zemina Torval"],
     ["Archon Delaine", "A. Lavigny-Duval"],
     ["Denton Patreus", "Felicia Winters", "Jerome Archer", "Yuri Grom"],
     ["A. Lavigny-Duval", "Denton Patreus"]),
    ("Scan ships and wakes", "Misc", True, True, False, True, False, "conflict_if_acquire",
     [],
     ["Archon Delaine", "A. Lavigny-Duval", "Denton Patreus", "Felicia Winters", "Jerome Archer", "Nakato Kaine",
      "Pranav Antal", "Yuri Grom"],
     [],
     []),
    ("Sell for large profits", "Hauling", True, False, False, True, False, "always",
     ["Denton Patreus", "Edmund Mahon", "Li Yong-Rui", "Zemina Torval"],
     [],
     [],
     []),
    ("Sell for large profits", "Hauling", False, True, False, True, False, "always",
     [],
     ["Aisling Duval", "Edmund Mahon", "Li Yong-Rui", "Zemina Torval"],
     [],
     []),
    ("Sell mined resources", "Mining", True, False, False, True, False, "always",
     ["Edmund Mahon", "Nakato Kaine", "Zemina Torval"],
     [],
     [],
     []),
    ("Sell mined resources", "Mining", False, True, True, True, False, "always",
     [],
     ["Edmund Mahon", "Felicia Winters", "Zemina Torval"],
     [],
     ["Zemina Torval"]),
    ("Sell rare goods", "Hauling", True, True, False, False, False, "always",
     ["Aisling Duval", "Denton Patreus", "Edmund Mahon", "Li Yong-Rui"],
     ["Archon Delaine", "Li Yong-Rui"],
     [],
     []),
    ("Transport Power Commodity: Sirius Franchise Package", "Hauling", True, False, False, True, False, "always",
     ["Aisling Duval", "Archon Delaine", "A. Lavigny-Duval", "Denton Patreus", "Edmund Mahon", "Felicia Winters",
      "Jerome Archer", "Li Yong-Rui", "Nakato Kaine", "Pranav Antal", "Yuri Grom", "Zemina Torval"],
     [],
     [],
     []),
    ("Transport Power Commodity: Sirius Industrial Equipment", "Hauling", False, True, False, True, False, "always",
     [],
     ["Aisling Duval", "Archon Delaine", "A. Lavigny-Duval", "Denton Patreus", "Edmund Mahon", "Felicia Winters",
      "Jerome Archer", "Li Yong-Rui", "Nakato Kaine", "Pranav Antal", "Yuri Grom", "Zemina Torval"],
     [],
     []),
    ("Transport Power Commodity: Sirius Corporate Contracts", "Hauling", False, False, True, True, False, "always",
     [],
     [],
     ["Aisling Duval", "Archon Delaine", "A. Lavigny-Duval", "Denton Patreus", "Edmund Mahon", "Felicia Winters",
      "Jerome Archer", "Li Yong-Rui", "Nakato Kaine", "Pranav Antal", "Zemina Torval"],
     []),
    ("Transfer Power Data", "On Foot", True, False, False, False, False, "always",
     ["Aisling Duval", "Archon Delaine", "A. Lavigny-Duval", "Denton Patreus", "Edmund Mahon", "Felicia Winters",
      "Jerome Archer", "Li Yong-Rui", "Nakato Kaine", "Pranav Antal", "Yuri Grom", "Zemina Torval"],
     [],
     [],
     []),
    ("Transfer Power Data", "On Foot", False, True, False, False, False, "always",
     [],
     ["Aisling Duval", "Archon Delaine", "A. Lavigny-Duval", "Denton Patreus", "Edmund Mahon", "Felicia Winters",
      "Jerome Archer", "Li Yong-Rui", "Nakato Kaine", "Pranav Antal", "Yuri Grom", "Zemina Torval"],
     [],
     []),
    ("Transfer Power Data", "On Foot", False, False, True, False, False, "always",
     [],
     [],
     ["Aisling Duval", "Archon Delaine", "A. Lavigny-Duval", "Denton Patreus", "Edmund Mahon", "Felicia Winters",
      "Jerome Archer", "Li Yong-Rui", "Nakato Kaine", "Zemina Torval"],
     []),
    ("Upload Power Malware", "On Foot", True, False, False, False, False, "always",
     ["Archon Delaine"],
     [],
     [],
     ["Li Yong-Rui", "Yuri Grom"]),
    ("Upload Power Malware", "On Foot", False, False, True, False, False, "always",
     [],
     [],
     [],
     ["Li Yong-Rui", "Yuri Grom"]),
]

# Display order of rule categories.
CATEGORY_ORDER = ["Hauling", "Mining", "Combat", "On Foot", "Misc"]

# Thresholds.
CONFLICT_THRESHOLD = 36000
ACQUISITION_THRESHOLD = 120000
EXPLOITED_THRESHOLD = 350000
FORTIFIED_THRESHOLD = 650000
STRONGHOLD_THRESHOLD = 1000000

RULE_SCHEMA = T.StructType(
    [T.StructField("rule_id", T.IntegerType(), False)]
    + [T.StructField(n, T.StringType(), False) for n in ("activity", "category")]
    + [T.StructField(n, T.BooleanType(), False)
       for n in ("acquisition", "reinforcement", "undermining", "legal", "carrier_ok")]
    + [T.StructField("requirement", T.StringType(), False)]
    + [T.StructField(n, T.ArrayType(T.StringType()), False)
       for n in ("bonus_acquisition", "bonus_reinforcement", "bonus_undermining", "vulnerable")]
)

ACTION_FLAG = {"Acquire": "acquisition", "Reinforce": "reinforcement", "Undermine": "undermining"}


#: A rule table up to this many rows is broadcast; a larger one is joined by its action.
MAX_BROADCAST_RULES = 10_000


def rules_df(spark: SparkSession) -> DataFrame:
    """The catalogue as a DataFrame."""
    return spark.createDataFrame([(i, *r) for i, r in enumerate(RULES, 1)], RULE_SCHEMA)


def rules_by_action(rules: DataFrame) -> DataFrame:
    """One row per (action, rule) the rule is flagged for."""
    parts = [rules.filter(F.col(flag)).withColumn("action", F.lit(a)) for a, flag in ACTION_FLAG.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def classify_action(controlling_power: Column, state: Column, powers: Column, power: str) -> Column:
    """Q-S: Reinforce / Acquire / Out of Range / Undermine for ``power``."""
    st = F.coalesce(state, F.lit("Unoccupied"))
    in_range = F.coalesce(F.array_contains(powers, power), F.lit(False))
    return (
        F.when(controlling_power == power, "Reinforce")
        .when((st == "Unoccupied") & in_range, "Acquire")
        .when(st == "Unoccupied", "Out of Range")
        .otherwise("Undermine")
    )


def control_score(progress: Column, state: Column) -> Column:
    """X21/Q-U: floor(progress x threshold of the state); NULL progress is 0."""
    thr = (
        F.when(state == "Fortified", FORTIFIED_THRESHOLD)
        .when(state == "Stronghold", STRONGHOLD_THRESHOLD)
        .otherwise(EXPLOITED_THRESHOLD)
    )
    return F.floor(F.coalesce(progress, F.lit(0.0)) * thr)


def rule_join(
    systems: DataFrame,
    rules: DataFrame,
    power: str,
    system_cols=("system_id",),
    by_name: bool = False,
) -> DataFrame:
    """Q-T: the rules available to ``power`` in each system.

    ``systems`` needs ``action``, ``controlling_power``, ``in_conflict`` and
    ``has_carrier``.  A rule applies when it is flagged for the action and
    its requirement holds; undermining a carrier system keeps only
    carrier-allowed rules.  ``bonus``: ``power`` is in the rule's bonus list
    for the action (acquire only for unoccupied, reinforce for own, undermine
    for other systems); ``vulnerable``: the controller is listed when
    undermining.  ``by_name=True`` takes bonus/vulnerable lists from the last
    rule of the same name (quirk Q16).
    """
    rba = rules_by_action(rules)
    if by_name:
        last = rules.withColumn("__last", F.max("rule_id").over(Window.partitionBy("activity"))) \
            .filter(F.col("rule_id") == F.col("__last"))
        lists = last.select("activity", *[F.col(c).alias("__" + c) for c in
                                          ("bonus_acquisition", "bonus_reinforcement", "bonus_undermining",
                                           "vulnerable")])
        rba = rba.join(lists, "activity").drop(
            "bonus_acquisition", "bonus_reinforcement", "bonus_undermining", "vulnerable")
        for c in ("bonus_acquisition", "bonus_reinforcement", "bonus_undermining", "vulnerable"):
            rba = rba.withColumnRenamed("__" + c, c)
    small = rules.limit(MAX_BROADCAST_RULES + 1).count() <= MAX_BROADCAST_RULES
    j = systems.join(F.broadcast(rba) if small else rba, "action")
    act, cp = F.col("action"), F.col("controlling_power")
    req = (
        F.when(F.col("requirement") == "archon_if_undermine",
               (act != "Undermine") | F.coalesce(cp == "Archon Delaine", F.lit(False)))
        .when(F.col("requirement") == "conflict_if_acquire", (act != "Acquire") | F.col("in_conflict"))
        .otherwise(True)
    )
    carrier = ~((act == "Undermine") & F.col("has_carrier")) | F.col("carrier_ok")
    unocc, own = cp.isNull(), F.coalesce(cp == power, F.lit(False))
    other = cp.isNotNull() & ~own
    bonus = (
        F.when(unocc & (act == "Acquire"), F.array_contains("bonus_acquisition", power))
        .when(own & (act == "Reinforce"), F.array_contains("bonus_reinforcement", power))
        .when(other & (act == "Undermine"), F.array_contains("bonus_undermining", power))
        .otherwise(False)
    )
    vulnerable = F.when(other & (act == "Undermine"), F.array_contains("vulnerable", cp)).otherwise(False)
    order = F.array(*[F.lit(c) for c in CATEGORY_ORDER])
    return j.filter(req & carrier).select(
        *system_cols,
        "action",
        "rule_id",
        "activity",
        "category",
        F.array_position(order, F.col("category")).cast("int").alias("category_rank"),
        "legal",
        bonus.alias("bonus"),
        vulnerable.alias("vulnerable"),
    )


def group_by_category(applied: DataFrame, system_cols=("system_id",)) -> DataFrame:
    """Per system and category, the rule names in catalogue order."""
    items = F.array_sort(F.collect_list(F.struct("rule_id", "activity")))
    return applied.groupBy(*system_cols, "action", "category", "category_rank").agg(
        F.array_join(F.transform(items, lambda x: x["activity"]), "|").alias("activities"),
        F.count(F.lit(1)).alias("n_rules"),
        F.max(F.col("bonus").cast("int")).cast("boolean").alias("any_bonus"),
    )
