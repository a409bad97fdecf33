import pytest
from pyspark.sql import functions as F

from orrery import schemas as S
from orrery.functions import normalize as N
from orrery.functions.validate import enum_reason, validate_enum, validate_enum_list


def _one(spark, expr, values, typ="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {typ}")
    return [r.y for r in df.select(expr(F.col("x")).alias("y")).collect()]


def test_economy(spark):
    got = _one(spark, N.economy, ["$economy_HighTech;", "$economy_UNKNOWN_foo", "$economy_;", None, "junk"])
    assert got == ["HighTech", "Unknown", "", "Unknown", "Unknown"]


def test_security_odd_case_literal(spark):
    got = _one(spark, N.security, ["$SYSTEM_SECURITY_high;", "$GAlAXY_MAP_INFO_state_anarchy;",
                                   "$GALAXY_MAP_INFO_state_anarchy;", "$GALAXY_MAP_INFO_state_lawless;", None])
    assert got == ["High", "Anarchy", "Unknown", "Lawless", "Unknown"]


def test_allegiance_government_station_type(spark):
    assert _one(spark, N.allegiance, ["", "$faction_Empire;", "Federation"]) == ["None", "Empire", "Federation"]
    assert _one(spark, N.government, ["$government_Democracy;", "Feudal"]) == ["Democracy", "Feudal"]
    assert _one(spark, N.station_type, ["", "Megaship", "Orbis"]) == ["Empty", "MegaShip", "Orbis"]


def test_brackets(spark):
    assert _one(spark, N.bracket, ["0", "", "1", "2", "3", "9", None]) == ["None", "None", "Low", "Med", "High",
                                                                          None, None]


def test_validate_policies(spark):
    vals = [None, "", "Boom", "Nonsense"]
    assert _one(spark, lambda c: validate_enum(c, S.FACTION_STATE, "S", "null"), vals) == [None, None, "Boom", None]
    assert _one(spark, lambda c: validate_enum(c, S.FACTION_STATE, "S", "keep"), vals) == [None, None, "Boom",
                                                                                            "Nonsense"]
    assert _one(spark, lambda c: enum_reason(c, S.FACTION_STATE), vals) == [None, None, None, "unknown"]
    with pytest.raises(Exception, match="Invalid S: Nonsense"):
        _one(spark, lambda c: validate_enum(c, S.FACTION_STATE, "S", "fail"), vals)


def test_validate_list_keeps_empty_string_rule(spark):
    df = spark.createDataFrame([(["Li Yong-Rui", None],)], "x array<string>")
    assert df.select(validate_enum_list("x", S.POWER, "Powers", "null").alias("y")).first().y == ["Li Yong-Rui", None]
    df = spark.createDataFrame([([""],)], "x array<string>")
    with pytest.raises(Exception, match="Invalid Powers array element"):
        df.select(validate_enum_list("x", S.POWER, "Powers", "fail")).collect()


def test_signal_counts_and_happiness(spark):
    df = spark.createDataFrame([([("3", "$SAA_SignalType_Biological;"), ("1", "tritium")],)],
                               "x array<struct<Count string, Type string>>")
    got = df.select(N.signal_counts("x").alias("y")).first().y
    assert [(s.Count, s.Type) for s in got] == [(3, "Biological"), (1, "Tritium")]
    assert _one(spark, N.happiness, ["$Faction_HappinessBand1;", "$Faction_HappinessBand5;", "x"]) == [
        "Elated", "Despondent", "Unknown"]


def test_constraint_checks(spark):
    from orrery.functions.validate import assert_not_null, duplicate_keys

    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, None)], "k int, v string")
    assert [r.k for r in duplicate_keys(df, ["k"]).collect()] == [1]
    assert [r.k for r in assert_not_null(df, ["k", "v"]).collect()] == [2]
