"""Stateful streams that see each key's rows in event-time order.

Cleaning, sessions and look-back rates depend on the order of a key's rows, but
rows arrive late and out of order.  ``transformWithState`` keeps the keys in
``SLOTS`` groups, by a hash, so that one call to the state store serves all rows
of a group, not one row or one key.  Per group:

* ``buffer``: rows that the watermark has not passed yet, by time bucket, one
  value per bucket and arriving frame; ``parts`` counts them.  A timer at the
  bucket's end fires once the watermark is there; then the rows of all buckets
  that it has passed are put in order key by key and processed, bucket by bucket,
  and dropped.  Arrival order and batch split are of no account.
* ``run``: what processing carries from row to row of each key (the last row, an
  open session, the look-back's head), of a size that the log does not grow.
* ``seen``: of look-back rates, the processed rows that are in reach, by bucket.

A group's rows of a micro batch come as an iterator of frames and go to their
buckets; no frame ever holds a whole group, only one bucket of it is taken up at
once.  A row whose bucket the watermark has passed comes out with ``late`` set and
its content as JSON: :func:`write_with_late` puts such rows into a table of their
own.  The number of groups belongs to a stream's checkpoint like the number of
shuffle partitions.

The results equal the batch operators' on the rows that are not late:
``clean_counter_series``, ``state_sessions`` (its closed sessions) and
``lookback_rates``.  State is in RocksDB (:func:`use_rocksdb`).
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

HOUR_US = 3_600_000_000
WEEK_US = 168 * HOUR_US
TICK_US = 7 * HOUR_US  # the epoch is a Thursday; cycles start on Thursdays at 07:00 UTC
MINUTE_MS = 60_000
SLOTS = 512  # groups of keys
ROWS = 10_000  # about as many rows come out in one frame


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that ``transformWithState`` needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


# ------------------------------------------------------------- steps

class Clean:
    """Both passes of the counter cleaning, row by row (default semantics)."""

    fields = "ts_us bigint, state string, r bigint, u bigint"

    def __init__(self, unoccupied: str = "Unoccupied"):
        self.unoccupied = unoccupied

    def rows(self, run: dict, rows: list[tuple[int, list, dict]]) -> Iterator[tuple]:
        for us, _, x in rows:
            state = x.get("state") or self.unoccupied
            r, u = x.get("r"), x.get("u")
            prog = {}
            for e in x.get("prog") or []:
                prog.setdefault(e["k"], e.get("v"))
            now = {"us": us, "state": state, "r": r, "u": u, "prog": prog if x.get("prog") is not None else None}
            before, run["row"] = run.get("row"), now
            if before is not None and not self._fresh(before, now):
                continue
            last, run["kept"] = run.get("kept"), {"us": us, "r": r, "u": u}
            if state == self.unoccupied or last is None or self._differs(last, now):
                yield us, state, r, u

    @staticmethod
    def _tick(a: int, b: int) -> bool:
        """A weekly reset lies between two times."""
        return (a - TICK_US) // WEEK_US != (b - TICK_US) // WEEK_US

    def _fresh(self, a: dict, b: dict) -> bool:
        """Pass 1: no late delivery."""
        if self._tick(a["us"], b["us"]):
            return True
        if a["state"] == self.unoccupied and b["state"] == self.unoccupied:
            old, new = a["prog"] or {}, b["prog"] or {}
            return any(old.get(k) is not None and v is not None and v > old[k] for k, v in new.items())
        known = None not in (a["r"], a["u"], b["r"], b["u"])
        return not known or (b["r"] >= a["r"] and b["u"] >= a["u"])

    def _differs(self, a: dict, b: dict) -> bool:
        """Pass 2: no near-duplicate."""
        known = None not in (a["r"], a["u"], b["r"], b["u"])
        return not known or a["r"] != b["r"] or a["u"] != b["u"] or self._tick(a["us"], b["us"]) or b["us"] - a["us"] > HOUR_US


class Sessions:
    """Closed sessions of a state; the row that closes one is part of its mean and labels."""

    fields = "start_us bigint, end_us bigint, n_rows bigint, avg_measure double, labels string"

    def rows(self, run: dict, rows: list[tuple[int, list, dict]]) -> Iterator[tuple]:
        for us, _, x in rows:
            inside, open_ = bool(x.get("inside")), run.get("open")
            if open_ is None:
                if not inside:
                    continue
                open_ = run["open"] = {"start": us, "n": 0, "sum": 0.0, "known": 0, "labels": []}
            open_["n"] += 1
            if x.get("measure") is not None:
                open_["sum"] += x["measure"]
                open_["known"] += 1
            if x.get("label") is not None and x["label"] not in open_["labels"]:
                open_["labels"].append(x["label"])
            if inside:
                open_["end"] = us
            else:
                mean = open_["sum"] / open_["known"] if open_["known"] else None
                yield open_["start"], open_["end"], open_["n"], mean, ",".join(sorted(open_["labels"]))
                del run["open"]


class Rates:
    """(value now - value at the earliest row within the look-back) / hours.

    The rows in reach stay in buckets of their own; ``head`` is the place of the
    earliest one, so a row costs no more with many rows in reach.
    """

    def __init__(self, names: Sequence[str], window_us: int):
        self.names, self.window_us = list(names), window_us
        self.fields = "ts_us bigint, row string, " + ", ".join(f"`{n}` bigint" for n in self.names)

    def rows(self, run: dict, rows: list[tuple[int, list, dict]], seen, bucket: int) -> Iterator[tuple]:
        buckets, at = run.setdefault("buckets", []), run.get("head", 0)
        if not buckets or buckets[-1] != bucket:
            buckets.append(bucket)
        mine = [[us, *[x.get(n) or 0.0 for n in self.names]] for us, _, x in rows]
        seen.updateValue((bucket,), (json.dumps(mine),))
        head = mine if buckets[0] == bucket else json.loads(seen.getValue((buckets[0],))[0])
        for (us, _, x), now in zip(rows, mine):
            while at >= len(head) or head[at][0] < us - self.window_us:
                if at < len(head):
                    at += 1
                    continue
                seen.removeKey((buckets.pop(0),))
                at, head = 0, mine if buckets[0] == bucket else json.loads(seen.getValue((buckets[0],))[0])
            hours = (us - head[at][0]) / HOUR_US
            rates = [None if hours == 0 else math.floor((a - b) / hours + 0.5) for a, b in zip(now[1:], head[at][1:])]  # halves go up
            yield us, json.dumps(x.get("row")), *rates
        run["head"] = at


# ------------------------------------------------------------- processor

class Seen:
    """Processed rows of a group in reach of the look-back: texts by bucket and key."""

    def __init__(self, state, buckets: list[int]):
        self.state, self.buckets, self.texts, self.changed = state, set(buckets), {}, set()

    def of(self, bucket: int) -> dict[str, str]:
        if bucket not in self.texts:
            self.texts[bucket] = json.loads(self.state.getValue((bucket,))[0]) if bucket in self.buckets else {}
        return self.texts[bucket]

    def forget(self, until: int) -> None:
        """Drop the buckets that end at ``until`` or before."""
        for b in [b for b in {*self.texts, *self.buckets} if b <= until]:
            self.texts.pop(b, None)
            self.changed.discard(b)
            if b in self.buckets:
                self.buckets.remove(b)
                self.state.removeKey((b,))

    def store(self) -> list[int]:
        for b in sorted(self.changed):
            self.state.updateValue((b,), (json.dumps(self.texts[b]),))
            self.buckets.add(b)
        return sorted(self.buckets)


class SeenOfKey:
    """One key's part of :class:`Seen`, as a map state.  Rows out of reach go with
    their whole bucket."""

    def __init__(self, seen: Seen, key: str):
        self.seen, self.key = seen, key

    def getValue(self, bucket: tuple[int]) -> tuple[str]:
        return (self.seen.of(bucket[0]).get(self.key, "[]"),)

    def updateValue(self, bucket: tuple[int], text: tuple[str]) -> None:
        self.seen.of(bucket[0])[self.key] = text[0]
        self.seen.changed.add(bucket[0])

    def removeKey(self, bucket: tuple[int]) -> None:
        pass


class Ordered(StatefulProcessor):
    """Runs a step over each key's rows in order (see the module's text)."""

    def __init__(self, step, names: Sequence[str], bucket_ms: int):
        self.step, self.names, self.bucket_ms = step, list(names), bucket_ms
        self.keeps = isinstance(step, Rates)  # processed rows stay for the look-back
        self.fired = {}

    def init(self, handle: StatefulProcessorHandle) -> None:
        def fields(**types) -> T.StructType:
            return T.StructType([T.StructField(n, t()) for n, t in types.items()])

        self.handle = handle
        self.parts = handle.getMapState("parts", fields(bucket=T.LongType), fields(n=T.LongType))
        self.buffer = handle.getMapState("buffer", fields(bucket=T.LongType, part=T.LongType), fields(text=T.StringType))
        self.run = handle.getValueState("run", fields(text=T.StringType))
        self.seen = handle.getMapState("seen", fields(bucket=T.LongType), fields(text=T.StringType)) if self.keeps else None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed, known = timerValues.getCurrentWatermarkInMs(), {}
        for frame in rows:
            if frame["bucket"].isnull().any():
                raise ValueError("a row has no event time")
            parts = {}
            for end, line in zip(frame["bucket"].tolist(), frame["line"].tolist()):
                parts.setdefault(int(end), []).append(line)
            late = []
            for end, lines in parts.items():
                if end <= passed:
                    late += [(_name(name), *[None] * (len(self.names) - 4), True, int(us), row) for us, _, name, row in (x.split("\t", 3) for x in lines)]
                    continue
                if end not in known:
                    known[end] = self.parts.getValue((end,))[0] if self.parts.containsKey((end,)) else 0
                    if not known[end]:
                        self.handle.registerTimer(end)
                self.buffer.updateValue((end, known[end]), ("\n".join(lines),))
                known[end] += 1
            if late:
                yield self._frame(late)
        for end, n in known.items():
            self.parts.updateValue((end,), (n,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        if self.fired.get(key[0]) == passed:  # another timer of the group has done all
            return
        self.fired[key[0]] = passed
        state = json.loads(self.run.get()[0]) if self.run.exists() else {"runs": {}, "seen": []}
        runs, seen, out = state["runs"], Seen(self.seen, state["seen"]), []
        ends = sorted(end for end, in self.parts.keys() if end <= passed)
        for end in ends:
            lines = []
            for part in range(self.parts.getValue((end,))[0]):
                lines += self.buffer.getValue((end, part))[0].split("\n")
                self.buffer.removeKey((end, part))
            self.parts.removeKey((end,))
            if self.keeps:  # what no row of this bucket can reach
                seen.forget(end - self.bucket_ms - self.step.window_us // 1000)
            for x in self._processed(end, lines, runs, seen):
                out.append(x)
                if len(out) >= ROWS:
                    yield self._frame(out)
                    out = []
        if out:
            yield self._frame(out)
        if self.keeps:  # forget a key when none of its rows can be in reach any more
            stay = self.step.window_us // 1000 + self.bucket_ms
            seen.forget(passed - stay)
            for name in [name for name, run in runs.items() if run["last"] + stay <= passed]:
                del runs[name]
            if runs and ends and ends[-1] + stay > passed:
                self.handle.registerTimer(ends[-1] + stay)
            state["seen"] = seen.store()
        if runs:
            self.run.update((json.dumps(state),))
        else:
            self.run.clear()

    def _processed(self, end: int, lines: list[str], runs: dict, seen: Seen) -> Iterator[tuple]:
        """What comes out of one bucket's rows."""
        keys = {}
        for us, ties, name, row in (x.split("\t", 3) for x in lines):
            keys.setdefault(name, []).append((int(us), [int(t) for t in ties.split(",")], row))
        for name, rows in keys.items():
            rows.sort()
            read = json.loads("[" + ",".join([row for _, _, row in rows]) + "]")
            rows = [(us, ties, x) for (us, ties, _), x in zip(rows, read)]
            run, key = runs.setdefault(name, {}), _name(name)
            if self.keeps:
                run["last"] = end
            for x in self.step.rows(run, rows, SeenOfKey(seen, name), end) if self.keeps else self.step.rows(run, rows):
                yield (key, *x, False, None, None)

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=self.names, dtype=object)

    def close(self) -> None:
        pass


def _name(text: str) -> str | None:
    """The key of a row's text."""
    return json.loads(text).get("key")


def _run(df: DataFrame, key: str, ts: str, ties: Sequence[Column], row: Column, step, watermark: str, bucket_ms: int) -> DataFrame:
    """Columns: key, the step's fields, late, and of late rows late_us and late_row."""
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # Python workers need no copy of this package
    us, name = F.unix_micros(F.col(ts).cast("timestamp")), F.col(key).cast("string")
    timed = df.withColumn("__event_time", F.col(ts).cast("timestamp")).withWatermark("__event_time", watermark)
    # The watermarked column itself does not go on: Spark would drop late rows silently.
    # JSON texts hold no tab and no line end.
    line = F.concat_ws("\t", us, F.concat_ws(",", *[F.coalesce(t.cast("bigint"), F.lit(-(1 << 63))) for t in ties]), F.to_json(F.struct(name.alias("key"))), F.to_json(row))
    bucket = ((us - F.pmod(us, F.lit(1000 * bucket_ms))) / 1000).cast("bigint") + bucket_ms
    rows = timed.select(F.pmod(F.xxhash64(name), F.lit(SLOTS)).alias("slot"), bucket.alias("bucket"), line.alias("line"))
    schema = T.StructType.fromDDL(f"key string, {step.fields}, late boolean, late_us bigint, late_row string")
    return rows.groupBy("slot").transformWithStateInPandas(
        statefulProcessor=Ordered(step, schema.names, bucket_ms), outputStructType=schema, outputMode="Append", timeMode="EventTime")


def _when(us: str) -> Column:
    return F.timestamp_micros(us)


# --------------------------------------------------------------- streams

def clean_counters(df: DataFrame, key: str, ts: str, state: str, r: str, u: str, progress: str | None = None, control: str | None = None,
                   needs_control: Sequence[str] = ("Fortified", "Exploited", "Stronghold"), watermark: str = "1 hour",
                   bucket_ms: int = 10 * MINUTE_MS) -> DataFrame:
    """Stream of ``clean_counter_series``: key, ts, state, r, u, late, late_row."""
    if control is not None:
        st = F.coalesce(F.col(state), F.lit("Unoccupied"))
        df = df.filter(~st.isin(*needs_control) | F.col(control).isNotNull())
    fields = [F.col(state).alias("state"), F.col(r).cast("bigint").alias("r"), F.col(u).cast("bigint").alias("u")]
    if progress:
        names = df.schema[progress].dataType.elementType.names
        fields.append(F.transform(progress, lambda e: F.struct(e[names[0]].alias("k"), e[names[1]].alias("v"))).alias("prog"))
    out = _run(df, key, ts, [F.xxhash64(*df.columns)], F.struct(*fields), Clean(), watermark, bucket_ms)
    return out.select("key", _when(F.coalesce("ts_us", "late_us")).alias("ts"), "state", "r", "u", "late", "late_row")


def sessions(df: DataFrame, key: str, ts: str, in_state: Column, measure: str, label: str, tiebreak: Sequence[str] = (),
             watermark: str = "1 hour", bucket_ms: int = 10 * MINUTE_MS) -> DataFrame:
    """Stream of the closed ``state_sessions``, each emitted once: key, start_ts,
    end_ts, duration_s, n_rows, avg_measure, labels, late, late_row."""
    inside = F.coalesce(in_state, F.lit(False))
    ties = [*[F.col(c) for c in tiebreak], F.xxhash64(F.col(measure), F.col(label), inside)]
    row = F.struct(inside.alias("inside"), F.col(measure).cast("double").alias("measure"), F.col(label).alias("label"))
    out = _run(df, key, ts, ties, row, Sessions(), watermark, bucket_ms)
    return out.select("key", _when(F.coalesce("start_us", "late_us")).alias("start_ts"), _when("end_us").alias("end_ts"),
                      ((F.col("end_us") - F.col("start_us")) / 1_000_000).alias("duration_s"), "n_rows", "avg_measure", "labels", "late", "late_row")


def lookback_rates(df: DataFrame, key: str, ts: str, values: dict[str, str], tiebreak: str, window_us: int = 8 * HOUR_US,
                   watermark: str = "1 hour", bucket_ms: int = 10 * MINUTE_MS) -> DataFrame:
    """Stream of ``lookback_rates`` (``name: value column``): key, ts, the tie-break
    column, one rate per name, late, late_row.  A key's state holds no row older
    than the look-back and goes when the last one is."""
    row = F.struct(F.col(tiebreak).cast("bigint").alias("row"), *[F.col(v).cast("double").alias(n) for n, v in values.items()])
    out = _run(df, key, ts, [F.col(tiebreak)], row, Rates(list(values), window_us), watermark, bucket_ms)
    return out.select("key", _when(F.coalesce("ts_us", "late_us")).alias("ts"), F.col("row").cast("bigint").alias(tiebreak), *values, "late", "late_row")


def write_with_late(stream: DataFrame, path: str, late_path: str, checkpoint: str, name: str, trigger_once: bool = True) -> StreamingQuery:
    """Results to ``path``, late rows to ``late_path`` (Parquet, one folder per
    batch, overwritten by a replay)."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            batch.where(~F.col("late")).drop("late", "late_row").write.mode("overwrite").parquet(f"{path}/batch={batch_id:08d}")
            batch.where("late").write.mode("overwrite").parquet(f"{late_path}/batch={batch_id:08d}")
        finally:
            batch.unpersist()

    use_rocksdb(stream.sparkSession)
    w = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).queryName(name)
    return (w.trigger(availableNow=True) if trigger_once else w.trigger(processingTime="1 minute")).start()
