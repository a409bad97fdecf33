"""Table writes and versioned publication.

Parquet has no transactions, so a release is a new folder per version and a
line in the manifest, added last; readers resolve the manifest, so they see the
old or the new release, never half of one.  Everything here writes with
Spark's distributed writers; the manifest is one tiny JSON file written by
Spark as well (no driver-local file I/O), so any Hadoop-compatible shared
store works.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def append(df: DataFrame, path: str, partition_by: Sequence[str] = ("event_date",),
           ts_col: str | None = "timestamp") -> None:
    """K1: append rows to a date-partitioned Parquet table.

    ``event_date`` is derived from ``ts_col`` when missing, so retention and
    incremental reads prune whole partitions.
    """
    if "event_date" in partition_by and "event_date" not in df.columns and ts_col:
        df = df.withColumn("event_date", F.to_date(ts_col))
    # Rows of a day together: else every task writes a small file for every day.
    # A day with much of the rows is split.
    df.hint("rebalance", *[F.col(c) for c in partition_by]).write.mode("append").partitionBy(*partition_by).parquet(path)


def overwrite(df: DataFrame, path: str, sort_by: Sequence[str] = (), partition_by: Sequence[str] = ()) -> None:
    """K7/K9: create-or-replace a table.  ``sort_by`` clusters rows within
    files so point lookups skip row groups by min/max statistics."""
    out = df.sortWithinPartitions(*sort_by) if sort_by else df
    w = out.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def version_name(generated_at: dt.datetime) -> str:
    return "v=" + generated_at.strftime("%Y%m%d_%H%M%S")


def publish(spark: SparkSession, root: str, tables: Mapping[str, DataFrame],
            generated_at: dt.datetime | None = None, sort_by: Mapping[str, Sequence[str]] | None = None) -> str:
    """Write every mart under ``root/v=<ts>/<name>`` then the manifest.

    Tables are written in the given order (dependency order).  Returns the
    version folder.  Old versions are removed by :func:`prune_versions`
    after readers moved on.
    """
    generated_at = generated_at or dt.datetime.now(dt.timezone.utc)
    vname = version_name(generated_at)
    base = f"{root.rstrip('/')}/{vname}"
    for name, df in tables.items():
        overwrite(df, f"{base}/{name}", sort_by=(sort_by or {}).get(name, ()))
    manifest = {"generated_at": generated_at.isoformat(), "version": vname, "tables": list(tables)}
    write_manifest(spark, root, manifest)
    return base


def write_manifest(spark: SparkSession, root: str, manifest: Mapping) -> None:
    """Add one line to the manifest folder, as a file of its own.

    Nothing is replaced: a reader between two releases sees the older one, and
    a file counts only when Spark's commit has moved it into place.
    """
    text = json.dumps(manifest, sort_keys=True)
    (spark.createDataFrame([(text,)], T.StructType([T.StructField("value", T.StringType())]))
     .coalesce(1).write.mode("append").text(f"{root.rstrip('/')}/_manifest"))


def read_manifest(spark: SparkSession, root: str) -> dict:
    """The newest release's line (by version name; there is one line per release)."""
    rows = spark.read.text(f"{root.rstrip('/')}/_manifest")
    return json.loads(rows.orderBy(F.get_json_object("value", "$.version").desc(), F.col("value").desc()).first().value)


def read_published(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Resolve the current version through the manifest and read one table."""
    m = read_manifest(spark, root)
    return spark.read.parquet(f"{root.rstrip('/')}/{m['version']}/{name}")


def prune_versions(spark: SparkSession, root: str, keep: int = 1) -> list[str]:
    """Delete all but the newest ``keep`` version folders (and never the current)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(conf)
    current = read_manifest(spark, root)["version"]
    versions = sorted(s.getPath().getName() for s in fs.listStatus(path) if s.getPath().getName().startswith("v="))
    doomed = [v for v in versions[:-keep] if v != current] if keep > 0 else []
    for v in doomed:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{v}"), True)
    return doomed


def export_csv(df: DataFrame, path: str, compression: str = "bzip2") -> None:
    """CSV with header, bzip2 by default.  Nested columns are written as
    JSON text (Spark's CSV writer rejects arrays/structs)."""
    cols = [
        F.to_json(F.col(f.name)).alias(f.name)
        if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) else F.col(f.name)
        for f in df.schema.fields
    ]
    df.select(*cols).write.mode("overwrite").option("header", True).option("compression", compression).csv(path)


def compact(spark: SparkSession, src: str, dst: str, target_files: int | None = None,
            sort_by: Sequence[str] = ()) -> None:
    """Rewrite a table into fewer, sorted files under a new path.

    ``target_files`` repartitions by range on ``sort_by`` (one shuffle) so the
    output is globally clustered; without it AQE sizes the partitions.
    """
    df = spark.read.parquet(src)
    if target_files and sort_by:
        df = df.repartitionByRange(target_files, *sort_by)
    elif target_files:
        df = df.repartition(target_files)
    overwrite(df, dst, sort_by=sort_by)


def land_raw(spark: SparkSession, src: str, dst: str, glob: str = "*.jsonl*") -> None:
    """K13 (re-aimed): land raw bz2/gz/plain NDJSON as date-partitioned Parquet
    text lines with their file name; ingest then reads columnar files."""
    lines = spark.read.option("pathGlobFilter", glob).text(src).select(
        F.col("_metadata.file_name").alias("file"), F.col("value").alias("line"))
    day = F.try_to_date(F.regexp_extract("file", r"(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd")
    lines.withColumn("event_date", day).write.mode("append").partitionBy("event_date").parquet(dst)


def migrate(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Re-shape a table to a new schema by name (casts, added NULL
    columns); write it as a new version and switch the manifest."""
    by_name = {f.name: f for f in df.schema.fields}
    cols = [
        (F.col(f.name).cast(f.dataType) if f.name in by_name else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in schema.fields
    ]
    return df.select(*cols)


def migrate_release(spark: SparkSession, root: str, schemas: Mapping[str, T.StructType], generated_at: dt.datetime | None = None) -> str:
    """The current release with some tables re-shaped, as a new release.

    Every table is written anew beside the old ones and the manifest line is
    added last: readers change over at once or, if anything fails, not at all.
    The old version stays as a backup until :func:`prune_versions`.
    """
    names = read_manifest(spark, root)["tables"]
    tables = {name: read_published(spark, root, name) for name in names}
    return publish(spark, root, {n: migrate(t, schemas[n]) if n in schemas else t for n, t in tables.items()}, generated_at)
