"""A keyed state in buckets (K2-K6, T4): a batch rewrites only what it touches.

The table's folder has one partition per (bucket of the key's hash, slot).  An
update reads the buckets that a batch has keys in, merges them and writes them
to the other slot of each by dynamic partition overwrite; readers take the slot
with the newest version.  Spark's partition discovery finds the folders, so there
is no list of our own, and the slot that readers use is never replaced: a job
that dies while it writes leaves the state as it was, and is repeated.

Bytes read and written follow the buckets touched.  ``buckets`` is set when a
table is made and stays.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TECHNICAL = ("bucket", "slot", "version")


class Buckets:
    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path, list(keys), buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _all(self) -> DataFrame | None:
        try:
            return self.spark.read.parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None

    def _slots(self, rows: DataFrame) -> dict[int, tuple[int, int]]:
        """(version, slot) in use of each bucket: at most ``buckets`` rows."""
        newest = rows.groupBy("bucket").agg(F.max(F.struct("version", "slot")).alias("x"))
        return {r.bucket: (r.version, r.slot) for r in newest.select("bucket", "x.*").collect()}

    @staticmethod
    def _in_use(rows: DataFrame, slots: dict[int, tuple[int, int]]) -> DataFrame:
        odd = [b for b, (_, s) in slots.items() if s == 1]
        return rows.where(F.col("slot") == F.when(F.col("bucket").isin(odd), 1).otherwise(0))

    def read(self) -> DataFrame | None:
        """The state; None before the first update."""
        rows = self._all()
        return None if rows is None else self._in_use(rows, self._slots(rows)).drop(*TECHNICAL)

    def update(self, delta: DataFrame, merge: Callable[[Sequence[DataFrame], Sequence[str]], DataFrame]) -> list[int]:
        """Merge ``delta`` (a state) into the touched buckets, which are returned."""
        delta = delta.withColumn("bucket", self._bucket()).persist()
        try:
            touched = [r.bucket for r in delta.select("bucket").distinct().collect()]  # at most ``buckets``
            if not touched:
                return []
            rows, old, slots = self._all(), [], {}
            if rows is not None:
                slots = self._slots(rows)
                old = [self._in_use(rows.where(F.col("bucket").isin(touched)), slots).drop(*TECHNICAL)]
            merged = merge([*old, delta.drop("bucket")], self.keys)
            used = [b for b in touched if b in slots and slots[b][1] == 0]
            version = 1 + max((slots[b][0] for b in touched if b in slots), default=0)
            out = merged.withColumns({"bucket": self._bucket(), "version": F.lit(version).cast("long")})
            out = out.withColumn("slot", F.when(F.col("bucket").isin(used), 1).otherwise(0))
            (out.hint("rebalance", F.col("bucket")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("bucket", "slot").parquet(self.path))
            return sorted(touched)
        finally:
            delta.unpersist()
