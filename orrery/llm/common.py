"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import io
import os
import re
import tempfile
import uuid
import zipfile

import orrery
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

RID = "__orrery_rid"  # the row number that stable() adds
_SHIPPED: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Send this package's code to the executors, once per application, so that
    Python tasks run where it isn't installed."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    top = os.path.dirname(os.path.abspath(orrery.__file__))
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for d, _, names in sorted(os.walk(top)):
            for n in sorted(names):
                if n.endswith(".py"):
                    z.write(os.path.join(d, n), os.path.relpath(os.path.join(d, n), os.path.dirname(top)))
    path = os.path.join(tempfile.mkdtemp(prefix="orrery-code-"), "orrery.zip")  # read by this process only; Spark serves it
    with open(path, "wb") as f:
        f.write(buffer.getvalue())
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def map_batches(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` with this package's code at hand."""
    ship_code(df.sparkSession)
    return df.mapInArrow(fn, schema)


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """One driver table; ``sf_dir`` may be any path Spark can read."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a local session without the setting gets a scratch folder; on a
    cluster a missing setting is an error.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="orrery-llm-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d.rstrip("/")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the
    lineage, survives lost executors and is computed once.

    A small table becomes a few files of the advisory size, not one per core.
    """
    spark, key = df.sparkSession, "spark.sql.adaptive.coalescePartitions.parallelismFirst"
    path = f"{shared_dir(spark)}/orrery-llm/{uuid.uuid4().hex}-{name}"
    before = spark.conf.get(key, "true")
    spark.conf.set(key, "false")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of stored steps now: it does so when the
    driver's memory is cleaned up, which may otherwise come late."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _columns(df: DataFrame) -> list:
    """The columns of ``df`` but for the row number of ``stable``."""
    return [F.col(f"`{c}`") for c in df.columns if c != RID]


def _by_file(df: DataFrame) -> DataFrame | None:
    """``df`` numbered by file and row in the file, which no split of the files
    changes; None if it is no plain scan of Parquet files, each read once."""
    plan = df._jdf.queryExecution().optimizedPlan()
    nodes = [x.lstrip(" :+-") for x in plan.toString().splitlines() if x.strip()]
    if not plan.deterministic() or not all(re.match(r"Relation\b.* parquet$|Project\b", x) for x in nodes):
        return None
    meta, path, row = df.metadataColumn("_metadata"), "__orrery_path", "__orrery_row"
    rows = df.select(meta["file_path"].alias(path), meta["row_index"].alias(row), *_columns(df))
    files = rows.groupBy(path).agg(F.count_if(F.col(row) == 0).alias("times"))
    files = store(files.select(path, "times", F.row_number().over(Window.orderBy(path)).cast("long").alias("__orrery_file")), "files")
    most = files.agg(F.max("times"), F.max("__orrery_file")).first()
    if (most[0] or 0) > 1 or (most[1] or 0) >= 1 << 23:
        return None
    rid = (F.shiftleft("__orrery_file", 40) + F.col(row)).alias(RID)
    return rows.join(F.broadcast(files.drop("times")), path).select(rid, *_columns(df))


def stable(df: DataFrame) -> DataFrame:
    """``df`` with a row number ``RID`` that is the same in every evaluation.

    Operators that use row numbers in more than one evaluation start with this:
    a shuffle below them may deal rows differently each time, and a scan is
    split by the number of cores there are at that moment.  A plain scan of
    Parquet files takes the number from file and row; other inputs are stored
    with it.
    """
    if RID in df.columns:
        return df
    numbered = _by_file(df)
    return store(df.select(F.monotonically_increasing_id().alias(RID), *_columns(df)), "input") if numbered is None else numbered


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(rid, id, text)``: every input row with an own key ``rid``.

    Only these columns go on, so extra input columns cannot clash.  ``rid`` is
    the number of a ``stable`` table; that of another one holds for a single
    evaluation.
    """
    rid = F.col(RID) if RID in df.columns else F.monotonically_increasing_id()
    return df.select(rid.alias("rid"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))


def without(df: DataFrame, dropped: DataFrame) -> DataFrame:
    """The ``stable`` table ``df``, all columns but its row number, without the
    rows whose number is in ``dropped`` (rid).  The list is stored first, so that
    Spark knows its size and broadcasts it only if it is small."""
    gone = store(dropped.select(F.col("rid").alias(RID)), "dropped")
    return df.join(gone, RID, "left_anti").select(*_columns(df))


def training_row(id_col):
    """True for the rows that models may learn labels from."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(4)) != 2
