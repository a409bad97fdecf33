"""Growing files, mergeable and bucketed state, quarantine, array documents."""

import gzip
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from orrery.operators import state
from orrery.operators.latest import latest_row, latest_state
from orrery.plans import marts, release
from orrery.sinks.buckets import Buckets
from orrery.sources import growing, jsonarray, ndjson
from tests.feed import build_feed, envelope, system_msg


def add(path, text, mode="ab"):
    with open(path, mode) as f:
        f.write(text.encode())


def lines(df):
    return sorted((r.file.removesuffix(".gz"), r.at, r.value) for r in df.collect())


def test_batch_read_of_any_split(spark, tmpdir_path):
    """Parts of any size give each whole line once; an unfinished line waits."""
    rng = random.Random(1)
    text = "".join("x" * rng.choice([0, 1, 5, 40]) + f"é{i}" + rng.choice(["\n", "\r\n"]) for i in range(200))
    add(os.path.join(tmpdir_path, "a.jsonl"), text + "unfinished")
    want, at = [], 0
    for line in text.encode().split(b"\n")[:-1]:
        want.append(("a.jsonl", at, line.removesuffix(b"\r").decode()))
        at += len(line) + 1
    for size in (7, 64, 1 << 20):
        assert lines(growing.read(spark, tmpdir_path, splitBytes=str(size))) == want
    assert lines(growing.read(spark, tmpdir_path, settleSeconds="0"))[-1] == ("a.jsonl", at, "unfinished")


def test_stream_reads_appended_lines_once(spark, tmpdir_path):
    folder, ckpt = os.path.join(tmpdir_path, "in"), os.path.join(tmpdir_path, "ckpt")
    os.makedirs(os.path.join(folder, "sub"))
    got = []

    def step():
        batches = []
        q = (growing.read_stream(spark, folder).writeStream.foreachBatch(lambda df, i: batches.append(lines(df)))
             .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
        q.awaitTermination()
        got.append([v for b in batches for _, _, v in b])

    a, b = os.path.join(folder, "a.jsonl"), os.path.join(folder, "sub", "b.jsonl")
    add(a, "1\n2\n3")
    step()
    add(a, "3\n4\n")
    add(b, "x\n")
    step()
    step()
    with open(b, "rb") as f:  # compressed after it was read, with one more line
        packed = gzip.compress(f.read() + b"y\n")
    with open(b + ".gz", "wb") as f:
        f.write(packed)
    os.remove(b)
    step()
    with open(b + ".gz", "wb") as f:
        f.write(gzip.compress(b"x\ny\nz\n"))
    step()
    assert got == [["1", "2"], ["33", "4", "x"], [], ["y"], ["z"]]


def test_replaced_and_odd_files(spark, tmpdir_path):
    files = growing._Files({"path": tmpdir_path})
    with pytest.raises(ValueError, match="was replaced"):
        files.parts({"a.jsonl": [9, 9]}, {"a.jsonl": [5, 5]})
    add(os.path.join(tmpdir_path, "m.jsonl.gz"), "")
    with open(os.path.join(tmpdir_path, "m.jsonl.gz"), "wb") as f:
        f.write(gzip.compress(b"1\n2\n") + gzip.compress(b"3\n"))
    with pytest.raises(Exception, match="several members"):
        growing.read(spark, tmpdir_path).collect()
    assert growing.read(spark, os.path.join(tmpdir_path, "none")).count() == 0


def test_states_of_batches_equal_whole_log(spark):
    """Any split, any order, batches merged twice: latest rows, non-NULL values and stages."""
    rng = random.Random(3)
    rows = [(rng.randrange(8), rng.randrange(20), rng.choice([None, rng.randrange(50)]), rng.choice([None, "a", "b"])) for _ in range(400)]
    df = spark.createDataFrame(rows, "k int, ts int, v int, s string").withColumn("n", F.monotonically_increasing_id())
    tie = F.xxhash64("v", "s", "n")
    parts = state.latest_parts(df.columns, ["k"], "ts", ["v"], {"s_ts": F.col("s").isNotNull()})
    cut = [df.where(F.pmod("n", F.lit(3)) == i) for i in (2, 0, 1, 0)]
    merged = state.merge([state.reduce_rows(d, ["k"], [F.col("ts"), tie], parts) for d in cut], ["k"])
    got = state.latest_rows(merged, ["k"], "ts", ["v"], ["s_ts"])
    want = latest_state(df, ["k"], "ts", ["v"], {"s_ts": F.col("s").isNotNull()}, [tie])
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_station_state_equals_merge(spark, tmpdir_path):
    t = build_feed(spark, os.path.join(tmpdir_path, "feed"))
    want = marts.station_latest(None, t["docked"], t["approach"], t["location"])
    none = [t[n].limit(0) for n in ("docked", "approach", "location")]
    a = marts.station_state(t["docked"], none[1], none[2])
    b = marts.station_state(none[0], t["approach"], t["location"])
    got = marts.station_from_state(state.merge([b, a, b], marts.STATION_KEYS))
    js = F.to_json(F.struct(*want.columns))
    assert sorted(r.j for r in got.select(js.alias("j")).collect()) == sorted(r.j for r in want.select(js.alias("j")).collect())


def test_buckets_rewrite_only_what_is_touched(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "state")
    table = Buckets(spark, path, ["k"], buckets=8)
    assert table.read() is None

    def delta(rows):
        df = spark.createDataFrame(rows, "k int, ts int, v string")
        return state.reduce_rows(df, ["k"], [F.col("ts")], [state.Part("row", F.struct("ts", "v"))])

    def rows():
        return sorted((r.k, r.row.v.ts, r.row.v.v) for r in table.read().collect())

    def files():
        return {os.path.join(d, n) for d, _, ns in os.walk(path) for n in ns if n.endswith(".parquet")}

    assert len(table.update(delta([(k, 1, "a") for k in range(40)]), state.merge)) == 8
    before = files()
    touched = table.update(delta([(3, 2, "b"), (3, 0, "z"), (99, 1, "n")]), state.merge)
    new = files() - before
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in new} == set(touched) and len(touched) <= 2
    assert before <= files()  # the slots that readers used are still there
    want = sorted([(k, 1, "a") for k in range(40) if k != 3] + [(3, 2, "b"), (99, 1, "n")])
    assert rows() == want
    table.update(delta([(3, 2, "b"), (3, 0, "z"), (99, 1, "n")]), state.merge)  # a replay
    assert rows() == want
    for i in range(2, 6):
        table.update(delta([(3, i + 1, f"c{i}")]), state.merge)
    assert rows() == sorted([(k, 1, "a") for k in range(40) if k != 3] + [(3, 6, "c5"), (99, 1, "n")])
    assert table.update(delta([]), state.merge) == []


def test_a_killed_update_leaves_the_state(spark, tmpdir_path):
    """The slot in use is never written: without the other one all is as before."""
    import shutil

    path = os.path.join(tmpdir_path, "state")
    table = Buckets(spark, path, ["k"], buckets=2)
    part = [state.Part("row", F.struct("ts", "v"))]

    def delta(ts):
        return state.reduce_rows(spark.createDataFrame([(k, ts, f"v{ts}") for k in range(6)], "k int, ts int, v string"), ["k"], [F.col("ts")], part)

    table.update(delta(0), state.merge)
    table.update(delta(1), state.merge)
    for d, _, _ in list(os.walk(path)):  # as if batch 2 had deleted the old slot and died
        if d.endswith("slot=0"):
            shutil.rmtree(d)
    assert {r.row.v.v for r in table.read().collect()} == {"v1"}
    table.update(delta(2), state.merge)
    assert {r.row.v.v for r in table.read().collect()} == {"v2"}


def _published(spark, wh):
    from tests.test_sinks import _release_rows

    return _release_rows(spark, os.path.join(wh, "release"))


def test_release_over_growing_files_equals_one_run(spark, tmpdir_path, monkeypatch):
    """Files grow between runs, one run dies halfway, a file is compressed: the
    rows equal one run over all lines."""
    import datetime as dt

    landed = os.path.join(tmpdir_path, "landed")
    build_feed(spark, landed)
    dump, names = os.path.join(landed, "systemsPopulated.json"), os.path.join(landed, "enclave.csv")

    def run(folder, wh, day):
        release.build_release(spark, folder, wh, dump, names, generated_at=dt.datetime(2025, 9, day))

    one, two = os.path.join(tmpdir_path, "one"), os.path.join(tmpdir_path, "two")
    run(landed, one, 4)
    part = os.path.join(tmpdir_path, "part")
    os.makedirs(part)
    texts = {}
    for name in sorted(os.listdir(landed)):
        if ".jsonl" in name:
            with (gzip.open if name.endswith(".gz") else open)(os.path.join(landed, name), "rb") as f:
                texts[name.removesuffix(".gz")] = f.read()
    for name, text in texts.items():
        add(os.path.join(part, name), text[: len(text) // 2].decode())
    release.ingest(spark, part, two)
    for name, text in texts.items():
        add(os.path.join(part, name), text[len(text) // 2 :].decode())
    jumps = os.path.join(part, "FSDJump-2025-09-03.jsonl")
    with open(jumps, "rb") as f, gzip.open(jumps + ".gz", "wb") as g:
        g.write(f.read())
    os.remove(jumps)

    def die(*args):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(release, "states_of", die)  # after the logs were written, before the states
        with pytest.raises(Exception, match="killed"):
            release.ingest(spark, part, two)
    run(part, two, 7)
    assert _published(spark, two) == _published(spark, one)
    assert sorted(d for d in os.listdir(os.path.join(two, "loads")) if "=" in d) == ["load=00000000", "load=00000001"]


def test_grown_file_gives_each_row_once(spark, tmpdir_path):
    folder, wh = os.path.join(tmpdir_path, "in"), os.path.join(tmpdir_path, "wh")
    os.makedirs(folder)
    path = os.path.join(folder, "FSDJump-2025-09-03.jsonl")
    add(path, envelope(system_msg("2025-09-03T10:00:00Z", "S1", 1, "Exploited", cp=0.1)) + "\n")
    release.ingest(spark, folder, wh)
    add(path, envelope(system_msg("2025-09-03T11:00:00Z", "S2", 2, "Exploited", cp=0.1)) + "\n")
    release.ingest(spark, folder, wh)
    assert sorted(r.StarSystem for r in release.read_log(spark, wh, "jumps").collect()) == ["S1", "S2"]
    assert sorted(r.SystemAddress for r in release.read_state(spark, wh, "system").collect()) == [1, 2]
    assert release.read_log(spark, wh, "docked").count() == 0 and release.read_state(spark, os.path.join(tmpdir_path, "no"), "station").count() == 0


def test_quarantine(spark, tmpdir_path):
    """Bad lines go to a table with their reason; the rest loads."""
    folder, wh = os.path.join(tmpdir_path, "in"), os.path.join(tmpdir_path, "wh")
    os.makedirs(folder)
    good = system_msg("2025-09-03T10:00:00Z", "Sol", 1, "Exploited", cp=0.1)
    feed = [envelope(good), "{broken", envelope(good, gameversion="3.8"), envelope(dict(good, ControllingPower="Nobody", PowerplayState="Odd")),
            envelope(dict(good, Powers=["Nobody"]))]
    add(os.path.join(folder, "FSDJump-2025-09-03.jsonl"), "\n".join(feed) + "\n")
    add(os.path.join(folder, "Docked-2025-09-03.jsonl"), envelope({"timestamp": "2025-09-03T10:00:00Z", "SystemAddress": 1}) + "\n")
    release.ingest(spark, folder, wh)
    assert release.read_log(spark, wh, "jumps").count() == 1
    assert [r.reason for r in release.read_rejects(spark, wh, "docked").collect()] == ["missing: StationName"]
    bad = release.read_rejects(spark, wh, "jumps").orderBy("at").collect()
    assert [r.reason for r in bad] == ["malformed", "version", "value: PowerplayState, ControllingPower", "value: Powers"]
    assert [r.value for r in bad] == feed[1:]
    kept = {r.kind: (r.kept, r.rejected) for r in spark.read.parquet(os.path.join(wh, "loads")).collect()}
    assert kept == {"jumps": (1, 4), "docked": (0, 1)}
    with pytest.raises(Exception, match="Invalid"):
        release.ingest(spark, folder, os.path.join(tmpdir_path, "strict"), policy="fail")


def test_array_elements():
    doc = ' [ {"a": "x]},\\"\\\\"}, {"b":[1,{"c":2}]} , 5, "s,", [], "é" ]\n'.encode()
    want = [json.dumps(x) for x in json.loads(doc)]
    for n in (1, 2, 3, 7, 100):
        got = list(jsonarray.elements(doc[i : i + n] for i in range(0, len(doc), n)))
        assert [json.dumps(json.loads(x)) for x in got] == want
    assert list(jsonarray.elements([b" [ ] "])) == []
    for bad in (b'{"a": 1}', b"[1, 2", b'["a'):
        with pytest.raises(ValueError):
            list(jsonarray.elements([bad]))


def test_systems_dump_is_streamed_and_landed_once(spark, tmpdir_path):
    path, folder = os.path.join(tmpdir_path, "d.json.gz"), os.path.join(tmpdir_path, "populated")
    one = {"id64": 1, "name": "A", "coords": {"x": 1, "y": 2.5, "z": 3}, "bodies": [], "more": {"y": [1]}}
    with gzip.open(path, "wt") as f:
        json.dump([one, one, {"id64": 2, "name": "B", "coords": None}], f)
    rows = sorted((r.Id64, r.Name, r.StarPos) for r in ndjson.land_systems(spark, path, folder).collect())
    assert rows == [(1, "A", [1.0, 2.5, 3.0]), (2, "B", None)]
    at = os.path.getmtime(os.path.join(folder, os.listdir(folder)[0]))
    ndjson.land_systems(spark, path, folder)
    assert os.path.getmtime(os.path.join(folder, os.listdir(folder)[0])) == at and len(os.listdir(folder)) == 1


def test_latest_row_state(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (1, 4, "c"), (2, None, "d")], "k int, timestamp int, v string")
    got = marts.row_from_state(state.merge([marts.row_state(df.where(x), ["k"], ["timestamp", "v"]) for x in ("v < 'b'", "v >= 'b'")], ["k"]), ["k"])
    assert sorted(map(str, got.collect())) == sorted(map(str, latest_row(df, ["k"], ["timestamp"]).collect()))


def test_distances_by_sql_names(spark, tmpdir_path):
    from orrery.plans import sqlnames

    path = os.path.join(tmpdir_path, "systems")
    rows = [(1, "Sol", [0.0, 0.0, 0.0]), (2, "Near", [3.0, 4.0, 0.0]), (3, "Far", [0.0, 0.0, 90.0])]
    spark.createDataFrame(rows, "SystemAddress bigint, StarSystem string, StarPos array<double>").write.parquet(path)
    sqlnames.install(spark, {"systems": path}, "names_test")
    one = spark.sql("SELECT names_test.system_distance('Sol', 'Near'), names_test.system_distance('Sol', 'None'), names_test.distance_from(3, array(0D, 0D, 1D))")
    assert tuple(one.first()) == (5.0, None, 89.0)
    got = spark.sql("SELECT StarSystem, distance FROM systems_within(array(0D, 0D, 0D), 5D) ORDER BY distance").collect()
    assert [tuple(r) for r in got] == [("Sol", 0.0), ("Near", 5.0)]
