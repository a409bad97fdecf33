"""Retention (K14, K15): keep rows younger than a per-type age limit.

Expressed as a filter so it can run as a partition-pruned rewrite of a
date-partitioned table (``event_date`` partitions older than the cutoff are
simply not read) and as a dry-run report of what would be dropped.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _limit_days(type_col: Column, policy: Mapping[str, int], default_days: int | None) -> Column:
    e = None
    for t, d in policy.items():
        e = F.when(type_col == t, F.lit(d)) if e is None else e.when(type_col == t, F.lit(d))
    dflt = F.lit(default_days) if default_days is not None else F.lit(None).cast("int")
    return dflt if e is None else e.otherwise(dflt)


def keep_condition(type_col: str, ts_col: str, policy: Mapping[str, int], as_of: Column,
                   default_days: int | None = None) -> Column:
    """TRUE for rows to keep: no limit for their type, or younger than it."""
    lim = _limit_days(F.col(type_col), policy, default_days)
    age_ok = F.col(ts_col) >= (as_of - F.make_dt_interval(lim))
    return lim.isNull() | age_ok


def retain(df: DataFrame, type_col: str, ts_col: str, policy: Mapping[str, int], as_of: Column,
           default_days: int | None = None) -> DataFrame:
    """The rows that survive the policy."""
    return df.filter(keep_condition(type_col, ts_col, policy, as_of, default_days))


def retention_report(df: DataFrame, type_col: str, ts_col: str, policy: Mapping[str, int], as_of: Column,
                     default_days: int | None = None, size: Column | None = None) -> DataFrame:
    """Dry run: kept and dropped row counts per type, and bytes if ``size``
    gives a row's (a file listing's length, say)."""
    keep = F.col("__keep")
    octets = F.lit(0) if size is None else size
    flagged = df.select(type_col, keep_condition(type_col, ts_col, policy, as_of, default_days).alias("__keep"),
                        octets.cast("long").alias("__bytes"))
    aggs = [F.count(F.when(keep, 1)).alias("kept"), F.count(F.when(~keep, 1)).alias("dropped")]
    if size is not None:
        aggs += [F.coalesce(F.sum(F.when(c, F.col("__bytes"))), F.lit(0)).alias(n)
                 for c, n in ((keep, "kept_bytes"), (~keep, "dropped_bytes"))]
    return flagged.groupBy(type_col).agg(*aggs)


def keep_recent_days(day_col: str, today: Column, days: int = 1) -> Column:
    """Keep only ``today`` and the ``days`` before it."""
    return (F.col(day_col) <= today) & (F.col(day_col) >= F.date_sub(today, days))
