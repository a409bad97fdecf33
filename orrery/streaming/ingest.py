"""Structured Streaming ingestion and latest-state maintenance.

* ``read_feed`` reads files that land whole (Spark's file source);
  ``read_growing`` reads files that grow, each appended line once.  In both the
  checkpoint replaces the reference's per-file ledger.
* Lines are parsed and gated with the same column expressions as the batch
  path (``orrery.sources.ndjson``), so stream and batch agree row for row.
* The latest-state tables are maintained in ``foreachBatch``: each micro batch
  becomes a state (``operators.state``) that is merged into the touched buckets
  of a bucketed table (``sinks.buckets``).
* ``latest_per_key_stream`` is the pure streaming form of A2: a streaming
  ``max_by`` aggregation with state in the state store, output in update mode.

Checkpoints go under the shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from orrery.functions import json as J
from orrery.operators.state import merge
from orrery.session import scratch_path
from orrery.sinks.buckets import Buckets
from orrery.sources import growing, ndjson


def read_feed(spark: SparkSession, folder: str, glob: str | None = None, max_files: int = 1000) -> DataFrame:
    """Stream of gated lines from newly landed files."""
    reader = spark.readStream.format("text").option("maxFilesPerTrigger", max_files)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    raw = reader.load(folder)
    lines = raw.select(F.col("_metadata.file_name").alias("file"), J.parse_once("value").alias("doc"))
    return ndjson.gate(lines)


def read_growing(spark: SparkSession, folder: str, glob: str = "*.jsonl*", settle_seconds: float = 3600) -> DataFrame:
    """T1 for files that grow: stream of gated lines, each appended line once."""
    raw = growing.read_stream(spark, folder, glob=glob, settleSeconds=settle_seconds)
    return ndjson.gate(raw.select("file", "path", "at", J.parse_once("value").alias("doc")))


def with_event_time(df: DataFrame, ts: str = "timestamp", watermark: str = "1 hour") -> DataFrame:
    """Event-time column for watermarking (streams need TIMESTAMP,
    not TIMESTAMP_NTZ; under a UTC session the cast is the identity)."""
    return df.withColumn("__event_time", F.col(ts).cast("timestamp")).withWatermark("__event_time", watermark)


def latest_per_key_stream(df: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """A2 on a stream: newest row per key, kept in the state store; a hash of the
    row breaks ties, not the order of arrival."""
    cols = [c for c in df.columns if c not in keys]
    order = F.struct(F.col(ts), F.xxhash64(*cols))
    return df.groupBy(*keys).agg(F.max_by(F.struct(*cols), order).alias("__row")).select(*keys, "__row.*")


def upsert_each_batch(
    spark: SparkSession,
    stream: DataFrame,
    state_of: Callable[[DataFrame], DataFrame],
    keys: Sequence[str],
    path: str,
    name: str,
    trigger_once: bool = True,
    buckets: int = 64,
) -> StreamingQuery:
    """T4: per micro batch, merge ``state_of(batch)`` (an ``operators.state``
    state by ``keys``) into the bucketed table at ``path``.

    Only touched buckets are read and rewritten.  Merging a batch twice changes
    nothing, so a replay after a failure gives the same table.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        Buckets(spark, path, keys, buckets).update(state_of(batch), merge)

    # One checkpoint per (query name, sink): a restart of the same stream
    # resumes, a stream into another table starts fresh.
    ident = hashlib.sha1(path.rstrip("/").encode()).hexdigest()[:12]
    ckpt = scratch_path(spark, f"stream-{name}-{ident}")
    w = stream.writeStream.foreachBatch(run).option("checkpointLocation", ckpt)
    w = w.trigger(availableNow=True) if trigger_once else w.trigger(processingTime="1 minute")
    return w.queryName(name).start()


def station_latest_stream(spark: SparkSession, feed_dir: str, path: str, name: str = "station_latest",
                          trigger_once: bool = True, settle_seconds: float = 3600) -> StreamingQuery:
    """T1-T4 end to end: lines appended to Docked / ApproachSettlement / Location
    files -> gate -> typed projections -> three-stage merge into the bucketed
    station state."""
    from orrery.plans import marts  # local import: marts depends on operators only

    stream = read_growing(spark, feed_dir, settle_seconds=settle_seconds)

    def state_of(batch: DataFrame) -> DataFrame:
        def of(kind: str) -> DataFrame:
            return batch.filter(F.col("file").contains(kind))

        return marts.station_state(ndjson.docked(of("Docked")), ndjson.approach_settlement(of("ApproachSettlement")),
                                   ndjson.location(of("Location")))

    return upsert_each_batch(spark, stream, state_of, marts.STATION_KEYS, path, name, trigger_once)


def station_snapshot(spark: SparkSession, path: str) -> DataFrame | None:
    """The station table kept by :func:`station_latest_stream`."""
    from orrery.plans import marts

    state = Buckets(spark, path, marts.STATION_KEYS).read()
    return None if state is None else marts.station_from_state(state)
