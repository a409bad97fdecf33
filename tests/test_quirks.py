"""Reference quirks in parity and default modes."""

import datetime as dt

import pytest
from orrery.operators.upsert import cutoff_report, watermark_cutoff
from orrery.plans import marts
from orrery.sources import ndjson
from tests.feed import envelope, system_msg, write_lines

T = dt.datetime


def _load(spark, d, glob):
    return ndjson.gate(ndjson.read_lines(spark, d, glob=glob))


def _station_feed(spark, d):
    docked = [{"timestamp": "2025-09-03T10:00:00Z", "StarSystem": "A", "SystemAddress": 1, "StationName": "Camp",
               "StationType": "OnFootSettlement", "MarketID": 7, "DistFromStarLS": 12.5,
               "StationAllegiance": "Federation", "LandingPads": {"Large": 0, "Medium": 1, "Small": 2}}]
    approach = [{"timestamp": "2025-09-03T11:00:00Z", "StarSystem": "A", "SystemAddress": 1, "Name": "Camp",
                 "BodyName": "A 1", "MarketID": 7}]
    loc = [dict(system_msg("2025-09-03T12:00:00Z", "A", 1, "Exploited"), Docked=True, StationName="Camp",
                StationType="OnFootSettlement", MarketID=7)]
    write_lines(d, "Docked-2025-09-03.jsonl", [envelope(m) for m in docked])
    write_lines(d, "ApproachSettlement-2025-09-03.jsonl", [envelope(m) for m in approach])
    write_lines(d, "Location-2025-09-03.jsonl", [envelope(m) for m in loc])
    return (ndjson.docked(_load(spark, d, "Docked*")), ndjson.approach_settlement(_load(spark, d, "Approach*")),
            ndjson.location(_load(spark, d, "Location*")))


def test_q4_q5_station_merge_parity_vs_default(spark, tmpdir_path):
    docked, approach, location = _station_feed(spark, tmpdir_path)
    par = marts.station_latest(None, docked, approach, location, parity=True).first()
    ours = marts.station_latest(None, docked, approach, location).first()
    # Newer approach/location rows: the reference resets type, distance and allegiance.
    assert par.timestamp == T(2025, 9, 3, 12) and ours.timestamp == T(2025, 9, 3, 12)
    assert par.StationAllegiance is None and ours.StationAllegiance == "Federation"    # Q4 + Q12
    assert par.DistFromStarLS is None and ours.DistFromStarLS == 12.5                  # Q4
    assert par.LandingPads.Small == 2 and ours.LandingPads.Small == 2                  # pads kept (coalesce)


def test_q6_cutoff_drops_are_counted(spark, tmpdir_path):
    docked, approach, location = _station_feed(spark, tmpdir_path)
    snap = marts.station_latest(None, docked, approach, location)
    cutoff = watermark_cutoff(snap, "timestamp")             # 12:00 - 1 h = 11:00
    rep = {r.source: (r.dropped, r.rows) for r in cutoff_report(
        {"docked": docked, "approach": approach, "location": location}, "timestamp", cutoff).collect()}
    assert rep == {"docked": (1, 1), "approach": (1, 1), "location": (0, 1)}


def test_q13_field_spellings_and_q14_star_pos(spark, tmpdir_path):
    a = system_msg("2025-09-03T10:00:00Z", "A", 1, "Exploited", pos=(1.0, 2.0, 3.0))   # uses BodyID
    b = dict(system_msg("2025-09-03T10:00:00Z", "B", 2, "Exploited"), BodyId=5)
    b.pop("BodyID")
    c = dict(system_msg("2025-09-03T10:00:00Z", "C", 3, "Exploited"), StarPos=[1.0, 2.0])
    write_lines(tmpdir_path, "FSDJump-2025-09-03.jsonl", [envelope(a), envelope(b), envelope(c)])
    g = _load(spark, tmpdir_path, "FSDJump*")
    rows = {r.SystemAddress: r for r in ndjson.jumps(g, policy="null").collect()}
    assert rows[1].BodyId == 0 and rows[2].BodyId == 5                                # Q13: both spellings
    assert rows[1].StarPos == [1.0, 2.0, 3.0] and rows[3].StarPos is None              # Q14 'null' policy
    with pytest.raises(Exception, match="StarPos must have 3 elements"):
        ndjson.jumps(g).collect()                                                        # Q14 'fail' (reference)


def test_q7_q9_first_row_and_dedup(spark):
    from orrery.operators.timeseries import clean_counter_series
    rows = [("S", T(2024, 1, 3, 10), "Exploited", 5, 5, None, 0.2),
            ("S", T(2024, 1, 3, 10, 30), "Exploited", 5, 5, None, 0.2),   # duplicate within 1 h
            ("S", T(2024, 1, 3, 11), "Exploited", 6, 5, None, 0.2)]       # only R changed, 30 min later
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, st string, r int, u int, "
                                     "p array<struct<Power string, ConflictProgress double>>, cp double")
    ours = [r.r for r in clean_counter_series(df, "k", "ts", "st", "r", "u", "p", "cp").orderBy("ts").collect()]
    par = [r.r for r in clean_counter_series(df, "k", "ts", "st", "r", "u", "p", "cp",
                                             parity=True).orderBy("ts").collect()]
    assert ours == [5, 6]     # first row kept, duplicate dropped, "either changed" kept
    assert par == []          # reference: first row has NULL deltas, and R-only change is not "both grew"
