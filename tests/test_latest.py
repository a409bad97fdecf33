import datetime as dt

from pyspark.sql import functions as F

from orrery.operators.latest import latest_row, latest_state, newest_nonnull, oldest_nonnull

T = dt.datetime


def test_latest_row_keeps_nulls_and_breaks_ties(spark):
    df = spark.createDataFrame(
        [(1, T(2024, 1, 1), 1, "a"), (1, T(2024, 1, 2), 2, None), (1, T(2024, 1, 2), 3, "tie"),
         (2, T(2024, 1, 1), 4, "single")],
        "k int, ts timestamp_ntz, id int, v string",
    )
    out = {r.k: (r.id, r.v) for r in latest_row(df, ["k"], ["ts", "id"]).collect()}
    assert out == {1: (3, "tie"), 2: (4, "single")}


def test_newest_nonnull_skips_null_values(spark):
    df = spark.createDataFrame(
        [(1, T(2024, 1, 1), 10.0), (1, T(2024, 1, 3), None), (1, T(2024, 1, 2), 20.0),
         (2, T(2024, 1, 1), None)],
        "k int, ts timestamp_ntz, v double",
    )
    out = {r.k: (r.v, r.first) for r in df.groupBy("k").agg(
        newest_nonnull("v", ["ts"]).alias("v"), oldest_nonnull("v", ["ts"]).alias("first")).collect()}
    assert out == {1: (20.0, 10.0), 2: (None, None)}


def test_latest_state_mixes_columns_and_filtered_max(spark):
    df = spark.createDataFrame(
        [(1, T(2024, 1, 1), "x", 5), (1, T(2024, 1, 2), None, None), (1, T(2024, 1, 3), "z", None)],
        "k int, ts timestamp_ntz, name string, cnt int",
    )
    r = latest_state(df, ["k"], "ts", nonnull_cols=["cnt"],
                     filtered_ts={"cnt_ts": F.col("cnt").isNotNull()}).collect()[0]
    assert (r.name, r.cnt, r.ts, r.cnt_ts) == ("z", 5, T(2024, 1, 3), T(2024, 1, 1))
