"""Batch ingestion ledger (S6, S7, S8, T1 batch form).

The ledger is a small table ``(file, last_line, file_size, imported_at)``.
A run lists the landed files, keeps those whose size changed, reads only
their lines after ``last_line`` and upserts the ledger.  Structured
Streaming's file source replaces all of this with its checkpoint when files
are immutable (see ``orrery.streaming``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators.upsert import keyed_replace
from orrery.sources.coverage import date_from_name

LEDGER_SCHEMA = "file string, last_line bigint, file_size bigint, imported_at timestamp_ntz"


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER_SCHEMA)


def list_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Landed files with sizes, without reading their content (binaryFile
    prunes the content column when it is not selected)."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
            .load(root).select(F.element_at(F.split("path", "/"), -1).alias("file"),
                               F.col("length").alias("file_size")))


def import_candidate(file: str | Column, substring: str | None = None, cutoff: str | None = None) -> Column:
    """Extension .jsonl/.gz, optional event substring, date in the name >= cutoff."""
    f = F.col(file) if isinstance(file, str) else file
    cond = f.endswith(".jsonl") | f.endswith(".gz")
    if substring:
        cond = cond & f.contains(substring)
    if cutoff:
        d = date_from_name(f)
        cond = cond & (d.isNull() | (d >= F.lit(cutoff).cast("date")))
    return cond


def plan_import(listing: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files whose size differs from the ledger's, with the line to resume after.

    The ledger keys names without ``.gz`` so a file compressed after import
    keeps its progress.
    """
    key = F.regexp_replace(F.col("file"), r"\.gz$", "")
    lst = listing.withColumn("__key", key)
    led = ledger.select(F.col("file").alias("__key"), F.col("last_line"), F.col("file_size").alias("__old"))
    j = lst.join(led, "__key", "left")
    return j.filter(F.col("__old").isNull() | (F.col("__old") != F.col("file_size"))).select(
        "file", "file_size", F.coalesce("last_line", F.lit(0)).alias("resume_after"))


def rows_to_import(numbered_lines: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows of planned files after the resume point (raw line numbers, Q1 'ours')."""
    return numbered_lines.join(plan.select("file", "resume_after"), "file").filter(
        F.col("line_no") > F.col("resume_after")).drop("resume_after")


def update_ledger(ledger: DataFrame, counts: DataFrame, now: Column | None = None) -> DataFrame:
    """Upsert ``(file, last_line, file_size)`` into the ledger (last batch wins)."""
    now = now if now is not None else F.localtimestamp()
    batch = counts.select(F.regexp_replace("file", r"\.gz$", "").alias("file"), "last_line", "file_size",
                          now.cast("timestamp_ntz").alias("imported_at"))
    return keyed_replace(ledger, batch, ["file"], ["imported_at"], newest_wins=False)
