import datetime as dt

from pyspark.sql import functions as F

from orrery.functions.timefns import js_round, literal_tick, next_tick
from orrery.operators.timeseries import (
    clean_counter_series,
    fix_control_progress,
    lookback_rate,
    state_sessions,
)

T = dt.datetime


def test_ticks_thursday_0700(spark):
    # 2024-01-04 is a Thursday.
    rows = [(T(2024, 1, 4, 6, 59),), (T(2024, 1, 4, 7, 0),), (T(2024, 1, 4, 8, 0),), (T(2024, 1, 5, 8, 0),)]
    df = spark.createDataFrame(rows, "p timestamp_ntz")
    got = df.select(next_tick("p").alias("n"), literal_tick(F.col("p")).alias("l")).collect()
    assert [r.n for r in got] == [T(2024, 1, 4, 7), T(2024, 1, 11, 7), T(2024, 1, 11, 7), T(2024, 1, 11, 7)]
    # The literal formula returns a past tick for samples in the first day of a cycle (Q10).
    assert got[2].l == T(2024, 1, 4, 7)
    assert got[3].l == T(2024, 1, 11, 7)


def test_js_round_half_up(spark):
    df = spark.createDataFrame([(-2.5,), (2.5,), (-2.6,)], "x double")
    assert [r.r for r in df.select(js_round(F.col("x")).alias("r")).collect()] == [-2, 3, -3]


def test_control_progress_fix(spark):
    df = spark.createDataFrame(
        [(0.5, "Exploited"), (1000.0, "Fortified"), (12271.9, "Exploited"), (12271.9, "Stronghold"),
         (12271.9, "Unoccupied")], "p double, s string")
    got = [r.f for r in df.select(fix_control_progress("p", "s").alias("f")).collect()]
    assert got[0] == 0.5 and got[1] == 1000.0
    assert abs(got[2] - (12271.9 - 4294967296 / 349999)) < 1e-9
    assert abs(got[3] - (12271.9 - 4294967296 / 1000000)) < 1e-9
    assert got[4] is None


def _series(spark, rows):
    return spark.createDataFrame(
        rows, "sys string, ts timestamp_ntz, state string, r int, u int, "
              "prog array<struct<Power string, ConflictProgress double>>, cp double")


def test_stale_row_dropped_unless_tick(spark):
    rows = [
        ("A", T(2024, 1, 3, 10), "Exploited", 100, 50, None, 0.1),
        ("A", T(2024, 1, 3, 11), "Exploited", 90, 60, None, 0.1),   # late delivery: R fell
        ("A", T(2024, 1, 3, 13), "Exploited", 120, 70, None, 0.1),
        ("A", T(2024, 1, 4, 8), "Exploited", 5, 1, None, 0.1),      # reset after Thu 07:00 tick
    ]
    df = _series(spark, rows)
    out = clean_counter_series(df, "sys", "ts", "state", "r", "u", progress="prog", control="cp")
    assert [r.r for r in out.orderBy("ts").collect()] == [100, 120, 5]
    # Literal reference predicate: occupied rows are never filtered as stale (Q7),
    # and an occupied first row is dropped by the dedup (Q9).
    par = clean_counter_series(df, "sys", "ts", "state", "r", "u", progress="prog", control="cp", parity=True)
    assert [r.r for r in par.orderBy("ts").collect()] == [120, 5]


def test_occupied_without_progress_is_dropped_first(spark):
    rows = [
        ("B", T(2024, 1, 3, 10), "Fortified", 1, 1, None, None),
        ("B", T(2024, 1, 3, 12), None, 2, 2, None, None),  # NULL state -> Unoccupied, kept
    ]
    out = clean_counter_series(_series(spark, rows), "sys", "ts", "state", "r", "u", progress="prog", control="cp")
    assert [(r.state, r.r) for r in out.collect()] == [("Unoccupied", 2)]


def test_rate_rules(spark):
    rows = [
        ("A", T(2024, 1, 1, 0), 1, 10), ("A", T(2024, 1, 1, 0), 2, 0),    # two rows, one timestamp
        ("A", T(2024, 1, 1, 2), 3, 5),                                     # (5 - 10) / 2 h = -2.5
        ("A", T(2024, 1, 1, 8), 4, None),                                  # gap exactly 8 h, NULL -> 0
        ("A", T(2024, 1, 1, 17), 5, 0),                                    # > 8 h after the previous row
    ]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, id int, v int")
    got = {r.id: r.rate for r in lookback_rate(df, ["k"], "ts", "v", tiebreak="id", name="rate").collect()}
    assert got[1] is None and got[2] is None   # earliest row in range shares the timestamp
    assert got[3] == -2                        # Math.round(-2.5) = -2
    assert got[4] == -1                        # (0 - 10) / 8 = -1.25
    assert got[5] is None


def test_sessions(spark):
    rows = [
        ("A", T(2024, 1, 1, 0), False, 1.0, "x"),
        ("A", T(2024, 1, 1, 1), True, 2.0, "a"),
        ("A", T(2024, 1, 1, 2), True, 4.0, "b"),
        ("A", T(2024, 1, 1, 3), False, 6.0, "c"),   # closes session 1 (counted)
        ("A", T(2024, 1, 1, 4), True, 8.0, "d"),    # session 2, ongoing
        ("B", T(2024, 1, 1, 0), False, 1.0, "x"),   # never in state
    ]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, s boolean, m double, lab string")
    out = {r.session_id: r for r in state_sessions(df, ["k"], "ts", F.col("s"), "m", "lab").collect()}
    assert set(out) == {1, 2}
    s1, s2 = out[1], out[2]
    assert (s1.start_ts, s1.end_ts, s1.n_rows, s1.labels) == (T(2024, 1, 1, 1), T(2024, 1, 1, 2), 3, "a,b,c")
    assert s1.avg_measure == 4.0 and s1.duration_s == 3600.0
    assert s2.end_ts is None and s2.n_rows == 1
