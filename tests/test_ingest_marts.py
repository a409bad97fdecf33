import datetime as dt

import pytest

from orrery.plans import marts
from orrery.sources import ledger, ndjson
from tests.feed import envelope, system_msg, write_lines

T = dt.datetime
TS = "2025-09-03T10:00:00Z"


def test_gate_cases(spark, tmpdir_path):
    base = {"timestamp": TS, "StarSystem": "Sol", "SystemAddress": 1}
    lines = [
        envelope(base),                                                     # current client: keep
        envelope(base, gameversion="3.8.0.407"),                            # old client
        envelope(base, gameversion="Fleet Carriers Update"),                # named version
        envelope(base, gameversion="CAPI-Live-market"),                     # server side: keep
        envelope(base, gateway="2025-09-03T11:00:00Z"),                     # exactly 1 h late: keep
        envelope(base, gateway="2025-09-03T11:00:01Z"),                     # too late
        envelope(dict(base, timestamp="not-a-time")),                       # bad time
        "{this is not json",                                                # malformed
    ]
    write_lines(tmpdir_path, "FSDJump-2025-09-03.jsonl", lines)
    g = ndjson.gate(ndjson.with_line_numbers(ndjson.read_lines(spark, tmpdir_path)))
    got = {r.line_no: r.reject_reason for r in g.collect()}
    assert got == {1: None, 2: "version", 3: "version", 4: None, 5: None, 6: "late", 7: "bad_timestamp",
                   8: "malformed"}


def test_enum_failure_aborts_and_null_policy(spark, tmpdir_path):
    m = system_msg(TS, "Sol", 1, "Exploited", power="Nobody")
    write_lines(tmpdir_path, "FSDJump-2025-09-03.jsonl", [envelope(m)])
    g = ndjson.gate(ndjson.read_lines(spark, tmpdir_path))
    with pytest.raises(Exception, match="Invalid ControllingPower"):
        ndjson.jumps(g).collect()
    assert ndjson.jumps(g, policy="null").first().ControllingPower is None


def test_ledger_resume(spark, tmpdir_path):
    write_lines(tmpdir_path, "Docked-2025-09-03.jsonl", ["{}", "{}", "{}"])
    write_lines(tmpdir_path, "Docked-2025-08-01.jsonl", ["{}"])
    write_lines(tmpdir_path, "notes.txt", ["x"])
    listing = ledger.list_files(spark, tmpdir_path).filter(ledger.import_candidate("file", "Docked", "2025-09-01"))
    led = spark.createDataFrame([("Docked-2025-09-03.jsonl", 2, 1, None)], ledger.LEDGER_SCHEMA)
    plan = ledger.plan_import(listing, led)
    assert [(r.file, r.resume_after) for r in plan.collect()] == [("Docked-2025-09-03.jsonl", 2)]
    lines = ndjson.with_line_numbers(ndjson.read_lines(spark, tmpdir_path, glob="*.jsonl"))
    assert [r.line_no for r in ledger.rows_to_import(lines, plan).collect()] == [3]
    new = ledger.update_ledger(led, ndjson.line_counts(lines))
    assert {r.file: r.last_line for r in new.collect()} == {"Docked-2025-09-03.jsonl": 3, "Docked-2025-08-01.jsonl": 1}


def test_marts_end_to_end(spark, feed):
    jl = marts.jumps_location(feed["jumps"], feed["location"])
    assert jl.count() == 5  # 4 jumps + 1 undocked location
    sl = marts.system_latest(jl)
    alpha = sl.filter("SystemAddress = 1").first()
    assert alpha.PowerplayStateControlProgress == 0.5            # newest non-NULL counter
    assert alpha.PowerplayStateReinforcement == 20
    assert alpha.PowerplayTimestamp == T(2025, 9, 3, 10)
    assert alpha.SystemEconomy == "HighTech" and alpha.SystemSecondEconomy == "Unknown"
    assert alpha.Factions[0].Happiness == "Happy" and alpha.Factions[0].Allegiance == "Federation"

    st = marts.station_latest(None, feed["docked"], feed["approach"], feed["location"])
    port = st.filter("StationName = 'Port A'").first()
    assert port.timestamp == T(2025, 9, 3, 11) and port.LandingPads.Large == 2
    camp = st.filter("StationName = 'Camp'").first()
    assert camp.StationType == "OnFootSettlement"                # approach row is older: kept
    assert st.count() == 3

    sysm = marts.systems(feed["populated"], sl, st)
    rows = {r.SystemAddress: r for r in sysm.collect()}
    assert rows[1].PowerplayHasStrongholdCarrier is True and rows[2].PowerplayHasStrongholdCarrier is False
    assert abs(rows[3].PowerplayStateControlProgress - (12271.9 - 4294967296 / 349999)) < 1e-9
    assert rows[2].PowerplayState == "Unoccupied" and 4 not in rows

    sup = {(r.SupportingSystemAddress, r.SupportedSystemAddress) for r in marts.powerplay_support(sl).collect()}
    assert sup == {(1, 2)}                                       # 25 <= 30; Gamma is exploited but 31 away

    inf = marts.infra_failures(sl, st, feed["commodities"], sysm).collect()
    assert len(inf) == 1 and inf[0].StationName == "Port A" and list(inf[0].Commodities[0]) == ["gold", "9000", "5"]

    ea = marts.enclave_activity(jl, feed["names"]).collect()
    assert {r.StarSystem for r in ea} == {"Alpha", "Gamma"}

    se = marts.settlements(feed["docked"], feed["approach"]).collect()
    assert [(r.StationName, r.BodyName, r.FactionName) for r in se] == [("Camp", "Alpha 1 a", "Fac B")]

    fa = marts.factions(jl)
    assert fa.count() == 2 and len(fa.columns) == 19

    comm = feed["commodities"].first().Commodities
    assert [c.StockBracket for c in comm] == ["Med", "None", "High"]
    assert [c.DemandBracket for c in comm] == ["None", "None", "Low"]
    assert comm[2].StatusFlags == ["Rare", "High Demand"]
