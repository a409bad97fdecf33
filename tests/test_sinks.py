import datetime as dt
import os
import shutil

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.sinks import publish, retention
from orrery.sources.coverage import coverage, landing_gap


def test_publish_manifest_and_prune(spark, tmpdir_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    root = os.path.join(tmpdir_path, "marts")
    publish.publish(spark, root, {"t": df}, generated_at=dt.datetime(2025, 1, 1))
    publish.publish(spark, root, {"t": df.filter("k = 1")}, generated_at=dt.datetime(2025, 1, 2))
    assert publish.read_manifest(spark, root)["version"] == "v=20250102_000000"
    assert publish.read_published(spark, root, "t").count() == 1
    assert publish.prune_versions(spark, root, keep=1) == ["v=20250101_000000"]


def test_csv_export_nested_as_json(spark, tmpdir_path):
    df = spark.createDataFrame([(1, ["x", "y"])], "k int, l array<string>")
    out = os.path.join(tmpdir_path, "csv")
    publish.export_csv(df, out)
    assert any(f.endswith(".csv.bz2") for f in os.listdir(out))
    back = spark.read.option("header", True).csv(out).first()
    assert back.l == '["x","y"]'


def test_migrate_adds_and_casts(spark):
    df = spark.createDataFrame([(1, "2")], "a int, b string")
    new = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.IntegerType()),
                        T.StructField("c", T.StringType())])
    out = publish.migrate(df, new)
    assert out.schema == new and tuple(out.first()) == (1, 2, None)


def test_retention_and_coverage(spark):
    rows = [("view", dt.datetime(2025, 1, 1)), ("view", dt.datetime(2025, 1, 9)), ("dump", dt.datetime(2020, 1, 1))]
    df = spark.createDataFrame(rows, "t string, ts timestamp_ntz")
    as_of = spark.createDataFrame([(dt.datetime(2025, 1, 10),)], "a timestamp_ntz").agg({"a": "max"}).scalar()
    kept = retention.retain(df, "t", "ts", {"view": 7}, as_of)   # no limit for other types
    assert sorted(r.ts.day for r in kept.collect()) == [1, 9]
    cov = {r.t: r.n_days for r in coverage(df, "t", "ts").collect()}
    assert cov == {"view": 2, "dump": 1}


def test_landing_gap(spark):
    files = spark.createDataFrame([("Docked-2025-01-05.jsonl",), ("x.txt",)], "f string")
    today = spark.createDataFrame([(dt.date(2025, 1, 9),)], "d date").agg({"d": "max"}).scalar()
    r = landing_gap(files, "f", today).first()
    assert (r.latest_day, r.lookback_days) == (dt.date(2025, 1, 5), 4)
    none = landing_gap(files.filter("f = 'x.txt'"), "f", today).first()
    assert none.lookback_days == 1


def test_append_compact_and_land(spark, tmpdir_path):
    df = spark.createDataFrame([(1, dt.datetime(2025, 1, 1, 5)), (2, dt.datetime(2025, 1, 2, 6))],
                               "k int, timestamp timestamp_ntz")
    tbl = os.path.join(tmpdir_path, "log")
    publish.append(df, tbl)
    publish.append(df, tbl)
    back = spark.read.parquet(tbl)
    assert back.count() == 4
    assert {d for d in os.listdir(tbl) if d.startswith("event_date=")} == {"event_date=2025-01-01",
                                                                          "event_date=2025-01-02"}
    assert back.filter("event_date = '2025-01-02'").count() == 2       # partition pruning column
    out = os.path.join(tmpdir_path, "compact")
    publish.compact(spark, tbl, out, target_files=1, sort_by=["k"])
    assert len([f for f in os.listdir(out) if f.endswith(".parquet")]) == 1
    raw = os.path.join(tmpdir_path, "raw")
    os.makedirs(raw)
    with open(os.path.join(raw, "Docked-2025-01-03.jsonl"), "w") as f:
        f.write('{"a": 1}\n{"a": 2}\n')
    landed = os.path.join(tmpdir_path, "landed")
    publish.land_raw(spark, raw, landed)
    rows = spark.read.parquet(landed).collect()
    assert len(rows) == 2 and str(rows[0].event_date) == "2025-01-03"


def test_build_release_end_to_end(spark, tmpdir_path):
    from orrery.plans import release
    from tests.feed import build_feed

    landed = os.path.join(tmpdir_path, "landed")
    build_feed(spark, landed)
    wh = os.path.join(tmpdir_path, "wh")
    base = release.build_release(spark, landed, wh, os.path.join(landed, "systemsPopulated.json"),
                                 os.path.join(landed, "enclave.csv"), generated_at=dt.datetime(2025, 9, 4))
    assert base.endswith("v=20250904_000000")
    root = os.path.join(wh, "release")
    assert publish.read_manifest(spark, root)["tables"][0] == "systems"
    assert publish.read_published(spark, root, "systems").count() == 3
    assert publish.read_published(spark, root, "powerplay_support").count() == 1
    assert publish.read_published(spark, root, "infra_failures").count() == 1
    assert spark.read.parquet(os.path.join(wh, "logs", "jumps")).count() == 4
    release.ingest(spark, landed, wh)  # nothing new: no load
    assert [d for d in os.listdir(os.path.join(wh, "loads")) if "=" in d] == ["load=00000000"]
    jl = spark.read.parquet(os.path.join(wh, "logs", "jumps"))
    out = os.path.join(tmpdir_path, "factions_csv")
    release.faction_export(jl.drop("event_date", "load"), out)
    assert spark.read.option("header", True).csv(out).count() == 2


def _release_rows(spark, root):
    out = {}
    for name in publish.read_manifest(spark, root)["tables"]:
        df = publish.read_published(spark, root, name)
        out[name] = sorted(df.select(F.to_json(F.struct(*sorted(df.columns))).alias("j")).toPandas().j)
    return out


def test_release_accumulates(spark, tmpdir_path):
    """Two runs over one folder equal one; new files in a second run equal one run over all."""
    from orrery.plans import release
    from tests.feed import build_feed

    landed = os.path.join(tmpdir_path, "landed")
    build_feed(spark, landed)
    dump, names = os.path.join(landed, "systemsPopulated.json"), os.path.join(landed, "enclave.csv")

    def run(folder, wh, day):
        release.build_release(spark, folder, wh, dump, names, generated_at=dt.datetime(2025, 9, day))
        return _release_rows(spark, os.path.join(wh, "release"))

    whole = run(landed, os.path.join(tmpdir_path, "one"), 4)
    assert whole["systems"] and run(landed, os.path.join(tmpdir_path, "one"), 5) == whole

    part, wh = os.path.join(tmpdir_path, "part"), os.path.join(tmpdir_path, "two")
    os.makedirs(part)
    files = sorted(f for f in os.listdir(landed) if ".jsonl" in f)
    for n, batch in enumerate((files[::2], files[1::2])):
        for f in batch:
            shutil.copy(os.path.join(landed, f), part)
        got = run(part, wh, 6 + n)
    assert got == whole


def test_keep_recent_days(spark):
    """Today and the days before it; a future or missing day goes."""
    days = [dt.date(2025, 1, d) for d in (1, 3, 4, 5, 6)] + [None]
    df = spark.createDataFrame([(d,) for d in days], "day date")
    got = df.filter(retention.keep_recent_days("day", F.lit(dt.date(2025, 1, 5)), days=1)).collect()
    assert sorted(r.day for r in got) == [dt.date(2025, 1, 4), dt.date(2025, 1, 5)]


def test_retention_bytes(spark):
    rows = [("a", dt.datetime(2025, 1, 9), 5), ("a", dt.datetime(2025, 1, 1), 7), ("b", dt.datetime(2020, 1, 1), 9)]
    df = spark.createDataFrame(rows, "t string, ts timestamp_ntz, n int")
    out = retention.retention_report(df, "t", "ts", {"a": 3}, F.lit(dt.datetime(2025, 1, 10)).cast("timestamp_ntz"), size=F.col("n"))
    assert {(r.t, r.kept, r.dropped, r.kept_bytes, r.dropped_bytes) for r in out.collect()} == {("a", 1, 1, 5, 7), ("b", 1, 0, 9, 0)}


def test_migrate_release_swaps_and_keeps_a_backup(spark, tmpdir_path):
    root = os.path.join(tmpdir_path, "release")
    a = spark.createDataFrame([(1, "5")], "k int, v string")
    old = publish.publish(spark, root, {"a": a, "b": a}, dt.datetime(2025, 9, 1))
    shape = T.StructType.fromDDL("k bigint, v int, extra string")
    publish.migrate_release(spark, root, {"a": shape}, dt.datetime(2025, 9, 2))
    assert publish.read_published(spark, root, "a").schema == shape
    assert publish.read_published(spark, root, "a").first() == (1, 5, None) and publish.read_published(spark, root, "b").schema == a.schema
    assert spark.read.parquet(f"{old}/a").schema["v"].dataType == T.StringType()  # the backup
    with pytest.raises(Exception):  # a value that does not fit: nothing changes
        bad = spark.createDataFrame([(1, "x")], "k int, v string")
        publish.publish(spark, root, {"a": bad}, dt.datetime(2025, 9, 3))
        publish.migrate_release(spark, root, {"a": shape}, dt.datetime(2025, 9, 4))
    assert publish.read_manifest(spark, root)["version"] == "v=20250903_000000"
