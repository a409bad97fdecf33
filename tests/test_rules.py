from pyspark.sql import functions as F

from orrery.operators.rules import RULES, classify_action, rule_join, rules_df

P = "Li Yong-Rui"
SYS = ("system_id int, controlling_power string, state string, powers array<string>, "
       "in_conflict boolean, has_carrier boolean")


def _systems(spark, rows):
    df = spark.createDataFrame(rows, SYS)
    return df.withColumn("action", classify_action(F.col("controlling_power"), F.col("state"), F.col("powers"), P))


def test_catalogue_size_and_duplicates():
    names = [r[0] for r in RULES]
    assert len(RULES) == 29
    assert sum(1 for n in set(names) if names.count(n) > 1) == 7   # seven names occur more than once


def test_classifier(spark):
    s = _systems(spark, [
        (1, P, "Fortified", [], False, False),
        (2, None, "Unoccupied", [P], False, False),
        (3, None, None, ["Yuri Grom"], False, False),
        (4, "Yuri Grom", "Exploited", [], False, False),
    ])
    assert {r.system_id: r.action for r in s.collect()} == {1: "Reinforce", 2: "Acquire", 3: "Out of Range",
                                                            4: "Undermine"}


def test_requirements_and_carrier(spark):
    s = _systems(spark, [
        (1, None, "Unoccupied", [P], False, False),              # acquire, no conflict
        (2, None, "Unoccupied", [P], True, False),               # acquire, conflict
        (3, "Archon Delaine", "Exploited", [], False, False),    # undermine Archon
        (4, "Yuri Grom", "Exploited", [], False, True),          # undermine carrier system
        (5, None, "Unoccupied", [], False, False),               # out of range: nothing
    ])
    out = rule_join(s, rules_df(spark), P).collect()
    by = {}
    for r in out:
        by.setdefault(r.system_id, set()).add(r.activity)
    assert "Complete Support Missions" not in by[1] and "Complete Support Missions" in by[2]
    assert "Bounty Hunting" in by[3]
    assert by[4] == {"Holoscreen Hacking", "Power Kills"}
    assert 5 not in by
    bonus = {(r.system_id, r.activity): r.bonus for r in out}
    assert bonus[(1, "Sell for large profits")] is True     # LYR bonus when acquiring
    vul = {(r.system_id, r.activity): r.vulnerable for r in out}
    assert vul[(3, "Bounty Hunting")] is True


def test_bonus_by_name_uses_last_variant(spark):
    s = _systems(spark, [(1, P, "Fortified", [], False, False)])
    own = {r.activity: r.bonus for r in rule_join(s, rules_df(spark), P).collect()}
    by_name = {r.activity: r.bonus for r in rule_join(s, rules_df(spark), P, by_name=True).collect()}
    # "Sell for large profits" (R) has LYR in its reinforcement bonus; the last
    # same-named rule is that one too, but "Sell rare goods" is unique.
    assert own["Sell for large profits"] is True and by_name["Sell for large profits"] is True
    # "Sell mined resources" R variant is the last one; unchanged.
    assert own.keys() == by_name.keys()
