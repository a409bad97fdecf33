"""Stateful streams in event-time order: any batch split, late rows, bounded state."""

import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from orrery.operators.timeseries import clean_counter_series, lookback_rates, state_sessions
from orrery.streaming import ordered

START = dt.datetime(2025, 9, 1)
HOUR = 3_600_000


def log(n=240, keys=3, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        ts = START + dt.timedelta(minutes=rng.randrange(0, 60 * 24 * 9))
        rows.append((f"k{rng.randrange(keys)}", ts, i, rng.choice([None, "Fortified", "Unoccupied", "Exploited"]), rng.choice([None, *range(6)]),
                     rng.choice([None, *range(6)]), rng.choice([True, False, None]), rng.choice(["a", "b", None])))
    return rows


SCHEMA = "key string, ts timestamp_ntz, n bigint, state string, r int, u int, inside boolean, label string"


def run(spark, folder, batches, stream_of, name):
    """Feed the batches one by one; rows and late rows that came out."""
    src = os.path.join(folder, "in")
    os.makedirs(src)
    out = []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(SCHEMA).parquet(src)
        ordered.write_with_late(stream_of(stream), os.path.join(folder, "rows"), os.path.join(folder, "late"), os.path.join(folder, "ckpt"), name).awaitTermination()
    schema = stream_of(stream).schema
    keep = [f for f in schema.fields if f.name not in ("late", "late_row")]
    out = spark.read.schema(type(schema)(keep)).parquet(os.path.join(folder, "rows")).drop("batch").collect()
    late = spark.read.schema(schema).parquet(os.path.join(folder, "late")).collect()
    return out, late


def end(days=100):
    return ("zz", START + dt.timedelta(days=days), -1, None, None, None, None, None)


def test_sessions_for_any_split_and_late_rows(spark, tmpdir_path):
    rows = log()
    rng = random.Random(1)
    rng.shuffle(rows)  # batches overlap in time: within the watermark nothing is late
    too_late = ("k0", START, 9999, None, None, 3, True, "a")
    batches = [rows[:70], rows[70:200], [*rows[200:], end()], [too_late, end(101)]]

    def stream_of(df):
        return ordered.sessions(df, "key", "ts", F.col("inside"), "r", "label", ["n"], watermark="10 days", bucket_ms=6 * HOUR)

    got, late = run(spark, tmpdir_path, batches, stream_of, "sessions_test")
    want = state_sessions(spark.createDataFrame(rows, SCHEMA), ["key"], "ts", F.col("inside"), "r", "label", tiebreak=["n"]).where("end_ts IS NOT NULL").collect()
    assert len(want) > 20
    assert sorted((r.key, r.start_ts, r.end_ts, r.n_rows, r.avg_measure and round(r.avg_measure, 9), r.labels, r.duration_s) for r in got) == sorted(
        (r.key, r.start_ts, r.end_ts, r.n_rows, r.avg_measure and round(r.avg_measure, 9), r.labels, r.duration_s) for r in want)
    assert [(r.key, r.start_ts, json.loads(r.late_row)) for r in late] == [("k0", START, {"inside": True, "label": "a"})]


def test_rates_for_any_split(spark, tmpdir_path):
    rows = log(n=300, keys=2, seed=8)
    batches = [rows[1::2], [*rows[::2], end()]]

    def stream_of(df):
        return ordered.lookback_rates(df, "key", "ts", {"r_rate": "r", "u_rate": "u"}, "n", watermark="10 days", bucket_ms=HOUR)

    got, late = run(spark, tmpdir_path, batches, stream_of, "rates_test")
    want = lookback_rates(spark.createDataFrame(rows, SCHEMA), ["key"], "ts", {"r_rate": "r", "u_rate": "u"}, "n").collect()
    assert not late and sorted(map(str, ((r.key, r.ts, r.n, r.r_rate, r.u_rate) for r in got))) == sorted(
        map(str, ((r.key, r.ts, r.n, r.r_rate, r.u_rate) for r in want)))


def test_cleaning_step_equals_batch(spark):
    """The step on ordered rows, without a stream."""
    rows = sorted(log(n=600, keys=1, seed=2), key=lambda r: (r[1], r[2]))
    df = spark.createDataFrame(rows, SCHEMA).withColumn("prog", F.array(F.struct(F.col("label").alias("k"), F.col("r").cast("double").alias("v"))))
    df = df.where("label IS NOT NULL")
    want = clean_counter_series(df, "key", "ts", "state", "r", "u", progress="prog", tiebreak=["n"]).orderBy("ts", "n").collect()
    keep = [x for x in rows if x[7] is not None]
    run_, out = {}, []
    for i in range(0, len(keep), 7):  # state travels as JSON between buckets
        part = [(int((x[1] - dt.datetime(1970, 1, 1)).total_seconds() * 1e6), [x[2]],
                 {k: v for k, v in (("state", x[3]), ("r", x[4]), ("u", x[5])) if v is not None} | {"prog": [{"k": x[7], "v": x[4]}]}) for x in keep[i : i + 7]]
        out += list(ordered.Clean().rows(run_, part))
        run_ = json.loads(json.dumps(run_))
    assert [(s, r, u) for _, s, r, u in out] == [(w.state, w.r, w.u) for w in want]


class Store(dict):
    """Stands for a map state."""

    def getValue(self, key):
        return self[key]

    def updateValue(self, key, value):
        self[key] = value

    def removeKey(self, key):
        del self[key]


@pytest.mark.parametrize("bucket_h", [1, 24])
def test_rates_keep_no_row_beyond_the_lookback(bucket_h):
    """One hot key: buckets that are out of reach go, whatever the number of rows."""
    step, store, run_, most = ordered.Rates(["v"], 8 * HOUR * 1000), Store(), {}, 0
    for i in range(400):
        us = i * 30 * 60 * 1_000_000
        bucket = us // 1000 // (bucket_h * HOUR) * bucket_h * HOUR
        old = [tuple(x) for x in json.loads(store[(bucket,)][0])] if (bucket,) in store else []
        if old:
            continue  # a bucket is processed once
        rows = [(us + k * 60_000_000, [k], {"v": float(k)}) for k in range(20)]
        list(step.rows(run_, rows, store, bucket))
        most = max(most, len(store))
    assert most <= 8 // bucket_h + 2


def test_state_rows_do_not_grow_with_the_keys(spark, tmpdir_path, monkeypatch):
    """Keys share their group's state rows and calls, and still do not mix."""
    monkeypatch.setattr(ordered, "SLOTS", 4, raising=False)
    rows = [(f"k{k}" if k else None, START + dt.timedelta(minutes=10 * i + k % 7), 1000 * k + i, "Exploited", k % 5 + i, i, i % 3 > 0, "a")
            for k in range(150) for i in range(6)]
    spark.createDataFrame([*rows, end()], SCHEMA).coalesce(1).write.parquet(os.path.join(tmpdir_path, "in"))
    made = {"rates": lambda df: ordered.lookback_rates(df, "key", "ts", {"r_rate": "r", "u_rate": "u"}, "n", watermark="10 days", bucket_ms=24 * HOUR),
            "sessions": lambda df: ordered.sessions(df, "key", "ts", F.col("inside"), "r", "label", ["n"], watermark="10 days", bucket_ms=24 * HOUR)}
    for name, stream_of in made.items():
        folder = os.path.join(tmpdir_path, name)
        query = ordered.write_with_late(stream_of(spark.readStream.schema(SCHEMA).parquet(os.path.join(tmpdir_path, "in"))), f"{folder}/rows", f"{folder}/late", f"{folder}/ckpt", name)
        query.awaitTermination()
        assert 0 < max(p.stateOperators[0].numRowsTotal for p in query.recentProgress) < 100
    df = spark.createDataFrame(rows, SCHEMA)
    got = spark.read.parquet(f"{tmpdir_path}/rates/rows").select("key", "n", "r_rate", "u_rate").collect()
    want = lookback_rates(df, ["key"], "ts", {"r_rate": "r", "u_rate": "u"}, "n").select("key", "n", "r_rate", "u_rate").collect()
    assert len(got) == 900 and sorted(map(str, got)) == sorted(map(str, want))
    got = spark.read.parquet(f"{tmpdir_path}/sessions/rows").select("key", "n_rows", "labels").collect()
    want = state_sessions(df, ["key"], "ts", F.col("inside"), "r", "label", tiebreak=["n"]).where("end_ts IS NOT NULL").select("key", "n_rows", "labels").collect()
    assert len(got) > 149 and sorted(map(str, got)) == sorted(map(str, want))
