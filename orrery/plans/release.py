"""The scheduled job end to end: landed feed files -> tables -> marts -> release.

One call does what the reference's driver script does after its downloads:
read the lines that were appended to the feed files, ingest every event type
through the gate, append the logs (date partitioned), merge the new rows into
the latest-state tables, build the marts in dependency order and publish them
as one versioned release behind a manifest.  Every step is a Spark job over
DataFrames.
"""

from __future__ import annotations

import datetime as dt
import os

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.functions import json as J
from orrery.operators.state import merge
from orrery.plans import marts
from orrery.sinks import publish
from orrery.sinks.buckets import Buckets
from orrery.sources import growing, ndjson

# Feed file-name substrings per event type.
FEEDS = {
    "jumps": "Jump",
    "location": "Location",
    "docked": "Docked",
    "approach_settlement": "ApproachSettlement",
    "commodities": "Commodity",
    "saasignalsfound": "SAASignalsFound",
    "fss_signals": "FSSSignalDiscovered",
}


STATES = {  # latest tables kept as mergeable states: keys of each
    "system": marts.SYSTEM_KEYS,
    "station": marts.STATION_KEYS,
    "commodities": ["MarketId"],
    "fss_signals": ["SystemAddress"],
}
FED_BY = {"system": {"jumps", "location"}, "station": {"docked", "approach_settlement", "location"},
          "commodities": {"commodities"}, "fss_signals": {"fss_signals"}}
KEPT = "kind string, kept bigint, rejected bigint"


def _event(file: str) -> Column:
    """The event type that a feed file's name tells; NULL for others."""
    return F.coalesce(*[F.when(F.col(file).contains(sub), name) for name, sub in FEEDS.items()])


def states_of(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The latest-table states of one load's rows, by name in ``STATES``."""
    def rows(df: DataFrame, keys: list[str]) -> DataFrame:
        return marts.row_state(df, keys, [c for c in df.columns if c not in keys])

    return {
        "system": marts.system_state(marts.jumps_location(t["jumps"], t["location"])),
        "station": marts.station_state(t["docked"], t["approach_settlement"], t["location"]),
        "commodities": rows(t["commodities"], STATES["commodities"]),
        "fss_signals": rows(t["fss_signals"], STATES["fss_signals"]),
    }


def load_batch(lines: DataFrame, batch_id: int, warehouse: str, policy: str = "quarantine") -> None:
    """One load: lines (path, file, at, value) -> raw lines, logs, rejects, states.

    Every folder is named after the load and overwritten, and merging a load
    into a state twice changes nothing, so a load that died halfway is repeated
    without a trace.
    """
    spark, load = lines.sparkSession, f"load={batch_id:08d}"

    def path(kind: str) -> str:
        return os.path.join(warehouse, kind, load)

    # The new lines as Parquet, by event type; everything else reads this.
    kinds = lines.select("*", _event("file").alias("event")).where("event IS NOT NULL")
    kinds.write.mode("overwrite").partitionBy("event").parquet(path("raw"))
    raw = spark.read.schema("path string, file string, at bigint, value string, event string").parquet(path("raw"))
    present = {r.event for r in raw.select("event").distinct().collect()}  # at most one row per event type
    counts, tables = [], {name: spark.createDataFrame([], _row_schema(name)) for name in FEEDS}
    for name in [n for n in FEEDS if n in present]:
        mine = raw.where(F.col("event") == name).select("path", "file", "at", "value", J.parse_once("value").alias("doc"))
        # Each line is parsed once: both writes and the counts read the kept result.
        seen = ndjson.checked(ndjson.gate(mine), name) if policy == "quarantine" else _unchecked(ndjson.gate(mine), name, policy)
        seen, watch = seen.persist(StorageLevel.MEMORY_AND_DISK), Observation()
        try:
            good = seen.observe(watch, F.count_if(F.col("reason").isNull()).alias("kept"), F.count("reason").alias("rejected"))
            by_day = good.where("reason IS NULL").select("row.*").withColumn("event_date", F.to_date("timestamp"))
            # One shuffle by day, so that a day is a few files and not one per task; a
            # day with much of the rows is split.
            by_day.hint("rebalance", F.col("event_date")).write.mode("overwrite").partitionBy("event_date").parquet(
                os.path.join(warehouse, "logs", name, load))
            bad = seen.where("reason IS NOT NULL").select("path", "file", "at", "reason", "value")
            bad.write.mode("overwrite").parquet(os.path.join(warehouse, "rejects", name, load))
        finally:
            seen.unpersist()
        counts.append((name, watch.get["kept"], watch.get["rejected"]))
        tables[name] = spark.read.schema(_row_schema(name)).parquet(os.path.join(warehouse, "logs", name, load))
    for name, state in states_of(tables).items():
        if FED_BY[name] & present:
            Buckets(spark, os.path.join(warehouse, "state", name), STATES[name]).update(state, merge)
    spark.createDataFrame(counts, KEPT).coalesce(1).write.mode("overwrite").parquet(path("loads"))


def _unchecked(gated: DataFrame, name: str, policy: str) -> DataFrame:
    """``checked`` for the policies fail, null and keep: only the gate and the
    columns that must be there reject."""
    columns, required = ndjson.EVENT_TYPES[name]
    d = gated.select("path", "file", "at", "value", F.col("reject_reason").alias("__gate"),
                     F.when(F.col("reject_reason").isNull(), F.struct(*columns(policy))).alias("row"))
    missing = [F.when(F.col("__gate").isNull() & F.col(f"row.{c}").isNull(), F.lit(f"missing: {c}")) for c in required]
    return d.withColumn("reason", F.coalesce("__gate", *missing)).drop("__gate")


def ingest(spark: SparkSession, landed: str, warehouse: str, policy: str = "quarantine", settle_seconds: float = 3600) -> None:
    """All lines that were appended under ``landed`` since the last run, as one load.

    The stream's checkpoint holds how far each file has been read (S7, S8); a
    run that was killed is repeated with the same lines under the same number.
    """
    stream = growing.read_stream(spark, landed, settleSeconds=settle_seconds)

    def run(lines: DataFrame, batch_id: int) -> None:
        load_batch(lines, batch_id, warehouse, policy)

    query = (stream.writeStream.foreachBatch(run).option("checkpointLocation", os.path.join(warehouse, "_ingested"))
             .trigger(availableNow=True).start())
    query.awaitTermination()


def _row_schema(name: str) -> T.StructType:
    """The columns that one event type's lines give."""
    if name not in _SCHEMAS:
        columns, _ = ndjson.EVENT_TYPES[name]
        empty = SparkSession.active().range(0).select(J.parse_once(F.lit("{}")).alias("doc"))
        _SCHEMAS[name] = empty.select(*columns("null")).schema
    return _SCHEMAS[name]


_SCHEMAS: dict[str, T.StructType] = {}


def _log_schema(name: str) -> T.StructType:
    return T.StructType([*_row_schema(name).fields, T.StructField("load", T.StringType()), T.StructField("event_date", T.DateType())])


def read_log(spark: SparkSession, warehouse: str, name: str) -> DataFrame:
    """One event's log over all loads: one read, whatever their number;
    ``event_date`` and ``load`` prune partitions."""
    return _read(spark, os.path.join(warehouse, "logs", name), _log_schema(name))


def read_rejects(spark: SparkSession, warehouse: str, name: str) -> DataFrame:
    """The lines of one event type that gave no row, with the reason."""
    return _read(spark, os.path.join(warehouse, "rejects", name), T.StructType.fromDDL("path string, file string, at bigint, reason string, value string, load string"))


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)  # nothing has been loaded yet


def read_state(spark: SparkSession, warehouse: str, name: str) -> DataFrame:
    """One state; an empty one before the first load."""
    state = Buckets(spark, os.path.join(warehouse, "state", name), STATES[name]).read()
    if state is None:
        logs = {n: read_log(spark, warehouse, n).drop("load", "event_date") for n in FEEDS}
        state = states_of(logs)[name].limit(0)
    return state


def build_release(spark: SparkSession, landed: str, warehouse: str, systems_dump: str, names_csv: str,
                  generated_at: dt.datetime | None = None, power: str | None = "Li Yong-Rui", policy: str = "quarantine",
                  settle_seconds: float = 3600) -> str:
    """New lines -> logs and states -> latest tables and marts -> versioned publish.

    ``warehouse`` receives ``raw`` (landed lines), ``logs/<event>`` (one folder
    per load, partitioned by day), ``rejects/<event>``, ``loads`` (counts),
    ``state/<table>`` (bucketed), ``latest/<table>`` and ``release/v=<ts>/<mart>``
    plus the manifest.  Raw lines are parsed once.  The latest tables come from
    the states, which only new rows are merged into, so their cost follows the
    new load and the number of keys; marts over the whole history read the logs.
    Two runs over one folder equal one, and runs over growing files equal one run
    over all lines.  Returns the release folder.
    """
    ingest(spark, landed, warehouse, policy, settle_seconds)
    t = {name: read_log(spark, warehouse, name).drop("event_date", "load") for name in FEEDS}

    def latest(name: str, df: DataFrame, key: str) -> DataFrame:
        path = os.path.join(warehouse, "latest", name)
        publish.overwrite(df, path, sort_by=[key])
        return spark.read.schema(df.schema).parquet(path)

    def rows(name: str) -> DataFrame:
        return marts.row_from_state(read_state(spark, warehouse, name), STATES[name])

    # Keyed latest tables (K2): newest message per market / per system, stored once.
    commodities = latest("commodities", rows("commodities"), "MarketId")
    latest("fsssignaldiscovered", rows("fss_signals"), "SystemAddress")
    jl = marts.jumps_location(t["jumps"], t["location"])
    sys_latest = latest("system", marts.system_from_state(read_state(spark, warehouse, "system")), "SystemAddress")
    stations = latest("station", marts.station_from_state(read_state(spark, warehouse, "station")), "SystemAddress")
    populated = ndjson.land_systems(spark, systems_dump, os.path.join(warehouse, "populated"))
    names = spark.read.option("header", True).csv(names_csv)
    systems = latest("systems", marts.systems(populated, sys_latest, stations), "SystemAddress")
    tables = {
        "systems": systems,
        "powerplay_support": marts.powerplay_support(sys_latest, power),
        "infra_failures": marts.infra_failures(sys_latest, stations, commodities, systems),
        "enclave_activity": marts.enclave_activity(jl, names),
        "settlements": marts.settlements(t["docked"], t["approach_settlement"]),
        "station_latest": stations,
        "factions": marts.factions(jl),
    }
    base = publish.publish(
        spark, os.path.join(warehouse, "release"), tables, generated_at,
        sort_by={"systems": ["SystemAddress"], "settlements": ["SystemAddress", "StationName"],
                 "enclave_activity": ["StarSystem", "timestamp"], "station_latest": ["SystemAddress"]},
    )
    faction_export(jl, f"{base}/factions_csv")
    publish.prune_versions(spark, os.path.join(warehouse, "release"), keep=2)
    return base


def faction_export(jl: DataFrame, path: str, since: str | None = None) -> None:
    """Q-H + K10: the flat faction table as bzip2 CSV (nested columns as JSON)."""
    publish.export_csv(marts.factions(jl, since).withColumn("timestamp", F.col("timestamp").cast("string")), path)
