import datetime as dt

from orrery.operators.upsert import Stage, keyed_replace, merge_latest

T = dt.datetime
SCHEMA = "k int, ts timestamp_ntz, a string, pads int"


def _merge(spark, target, source, **opts):
    t = spark.createDataFrame(target, SCHEMA)
    s = spark.createDataFrame(source, SCHEMA)
    out = merge_latest(t, [Stage(s, **opts)], ["k"], "ts", ["a", "pads"])
    return {r.k: (r.ts, r.a, r.pads) for r in out.collect()}


def test_merge_clauses(spark):
    target = [(1, T(2024, 1, 2), "old", None), (2, T(2024, 1, 2), "old", 5), (3, T(2024, 1, 2), "keep", 1)]
    source = [
        (1, T(2024, 1, 1), "older", 7),     # not newer: only fills NULL pads
        (2, T(2024, 1, 3), "newer", None),  # newer: replaces, pads per option
        (4, T(2024, 1, 1), "new", 2),       # only in source: insert
    ]
    got = _merge(spark, target, source, fill_if_null=["pads"])
    assert got[1] == (T(2024, 1, 2), "old", 7)
    assert got[2] == (T(2024, 1, 3), "newer", None)      # parity: NULL overwrites (Q5)
    assert got[3] == (T(2024, 1, 2), "keep", 1)          # only in target
    assert got[4] == (T(2024, 1, 1), "new", 2)
    got = _merge(spark, target, source, prefer_new=["pads"], fill_if_null=["pads"])
    assert got[2] == (T(2024, 1, 3), "newer", 5)         # default: keep the known pads


def test_merge_equal_timestamp_is_not_newer(spark):
    got = _merge(spark, [(1, T(2024, 1, 2), "t", 1)], [(1, T(2024, 1, 2), "s", 2)])
    assert got[1] == (T(2024, 1, 2), "t", 1)


def test_merge_source_reduced_per_column_newest_nonnull(spark):
    source = [(1, T(2024, 1, 1), "a1", 1), (1, T(2024, 1, 2), None, None)]
    got = _merge(spark, [], source)
    assert got[1] == (T(2024, 1, 2), "a1", 1)  # arg_max skips NULLs column by column (Q3)


def test_merge_replay_is_idempotent(spark):
    t = spark.createDataFrame([(1, T(2024, 1, 1), "x", None)], SCHEMA)
    s = spark.createDataFrame([(1, T(2024, 1, 2), "y", 3), (2, T(2024, 1, 2), "z", None)], SCHEMA)
    once = merge_latest(t, [Stage(s)], ["k"], "ts", ["a", "pads"])
    twice = merge_latest(once, [Stage(s)], ["k"], "ts", ["a", "pads"])
    assert sorted(once.collect()) == sorted(twice.collect())


def test_keyed_replace_last_batch_vs_newest(spark):
    t = spark.createDataFrame([(1, T(2024, 1, 5), "t", 0)], SCHEMA)
    b = spark.createDataFrame([(1, T(2024, 1, 1), "b", 0), (2, T(2024, 1, 1), "n", 0)], SCHEMA)
    last = {r.k: r.a for r in keyed_replace(t, b, ["k"], ["ts"], newest_wins=False).collect()}
    newest = {r.k: r.a for r in keyed_replace(t, b, ["k"], ["ts"], newest_wins=True).collect()}
    assert last == {1: "b", 2: "n"}      # Q2: later batch wins although older
    assert newest == {1: "t", 2: "n"}


def test_incremental_merge_equals_full(spark):
    t = spark.createDataFrame([(k, T(2024, 1, 1), f"t{k}", k) for k in range(10)], SCHEMA)
    s1 = spark.createDataFrame([(1, T(2024, 1, 2), "s1", None), (11, T(2024, 1, 2), "new", 3),
                                (2, T(2023, 12, 1), "old", 9)], SCHEMA)
    s2 = spark.createDataFrame([(1, T(2024, 1, 3), None, 4), (3, T(2024, 1, 5), "s2", None)], SCHEMA)
    stages = [Stage(s1, fill_if_null=["pads"]), Stage(s2, keep_old=["a"])]
    full = merge_latest(t, stages, ["k"], "ts", ["a", "pads"])
    inc = merge_latest(t, stages, ["k"], "ts", ["a", "pads"], incremental=True)
    assert sorted(full.collect()) == sorted(inc.collect())
    assert inc.count() == 11
