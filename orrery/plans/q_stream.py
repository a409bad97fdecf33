"""Streams over the driver's events (T5, T6, T9, T10), run to the end of their
input and compared with the batch queries' oracles.

``events`` is read as a stream of micro batches (one file each, at most); a last
empty-handed row beyond all others moves the watermark past the end, so every
real row has been processed when the query returns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from orrery.plans.catalog import ORACLES, register
from orrery.plans.q_series import series_log
from orrery.session import scratch_path
from orrery.sources.tables import table
from orrery.streaming import ordered

DAY_MS = 86_400_000


def _as_stream(spark, log, ts="ts"):
    """The rows of a batch frame as a stream, out of order, in several batches."""
    path = scratch_path(spark, f"orrery-stream-{uuid.uuid4().hex}")
    # Rows are dealt by a hash, so each file spans the whole time and the next one is late.
    part = F.pmod(F.xxhash64(*log.columns), F.lit(3))
    log.withColumn("__part", part).repartition(3, "__part").drop("__part").write.parquet(path)
    end = log.agg((F.max(ts) + F.expr("INTERVAL 400 DAYS")).alias(ts))
    last = end.select(*[F.col(ts) if c == ts else F.lit(None).cast(log.schema[c].dataType).alias(c) for c in log.columns])
    last.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 2).parquet(path)


def _finished(spark, stream, name, user_type):
    """The rows that a stream has written when all its input has been read."""
    root = scratch_path(spark, f"orrery-{name}-{uuid.uuid4().hex}")
    query = ordered.write_with_late(stream, f"{root}/rows", f"{root}/late", f"{root}/checkpoint", name)
    query.awaitTermination()
    rows = spark.read.schema(stream.drop("late", "late_row").schema).parquet(f"{root}/rows").drop("batch")
    times = {c: F.col(c).cast("timestamp_ntz") for c in ("ts", "start_ts", "end_ts") if c in rows.columns}
    return rows.withColumns(times).withColumn("user_id", F.col("key").cast(user_type)).drop("key")


@register("clean_series_stream", oracle=f"SELECT user_id, ts, state, reinforcement, undermining FROM ({ORACLES['clean_series']})")
def clean_series_stream(spark, sf):
    """The counter cleaning as a stream with event-time timers."""
    log = series_log(spark, sf)
    out = ordered.clean_counters(_as_stream(spark, log), "user_id", "ts", "state", "r", "u", progress="progress", control="control",
                                 watermark="60 days", bucket_ms=DAY_MS)
    return _finished(spark, out, "clean_series_stream", log.schema["user_id"].dataType).select(
        "user_id", "ts", "state", F.col("r").alias("reinforcement"), F.col("u").alias("undermining"))


@register("state_sessions_stream", oracle=f"SELECT * EXCLUDE (session_id) FROM ({ORACLES['state_sessions']}) WHERE end_ts IS NOT NULL")
def state_sessions_stream(spark, sf):
    """Sessions kept open in keyed state, each emitted once when it closes."""
    ev = table(spark, sf, "events").select("user_id", "ts", "value", "event_type")
    out = ordered.sessions(_as_stream(spark, ev), "user_id", "ts", F.col("event_type") == "error", "value", "event_type",
                           watermark="60 days", bucket_ms=DAY_MS)
    rows = _finished(spark, out, "state_sessions_stream", ev.schema["user_id"].dataType)
    return rows.withColumn("avg_measure", F.round("avg_measure", 6))


@register("rolling_8h_rate_stream", oracle=f"SELECT user_id, ts, event_id, r_rate, u_rate FROM ({ORACLES['rolling_8h_rate']})")
def rolling_8h_rate_stream(spark, sf):
    """Look-back rates with eight hours of rows in keyed state."""
    log = series_log(spark, sf).select("user_id", "ts", "event_id", "r", "u")
    out = ordered.lookback_rates(_as_stream(spark, log), "user_id", "ts", {"r_rate": "r", "u_rate": "u"}, "event_id",
                                 watermark="60 days", bucket_ms=DAY_MS)
    return _finished(spark, out, "rolling_8h_rate_stream", log.schema["user_id"].dataType)
