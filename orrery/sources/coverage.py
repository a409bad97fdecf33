"""Coverage and landing-gap reports over landed data.

Both are single aggregations over (possibly file-metadata) columns; they
never list files on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def coverage(df: DataFrame, group: str, ts: str) -> DataFrame:
    """Per group the first and last day (as midnight timestamps) and the
    number of distinct days.

    Distinct days are counted as a two-level aggregation (group, day) then
    group, so no per-group set of days is held anywhere.
    """
    day = F.date_trunc("day", F.col(ts)).cast("timestamp_ntz").alias("__day")
    per_day = df.groupBy(F.col(group), day).agg(F.count(F.lit(1)).alias("__n"))
    return per_day.groupBy(group).agg(
        F.min("__day").alias("first_day"),
        F.max("__day").alias("last_day"),
        F.count(F.lit(1)).alias("n_days"),
        F.sum("__n").alias("n_rows"),
    )


def date_from_name(name: str | Column, pattern: str = r"(\d{4}-\d{2}-\d{2})") -> Column:
    """The first ``YYYY-MM-DD`` in a file name, as a DATE (NULL if none)."""
    n = F.col(name) if isinstance(name, str) else name
    return F.try_to_date(F.nullif(F.regexp_extract(n, pattern, 1), F.lit("")), "yyyy-MM-dd")


def lookback_days(latest_day: Column, today: Column, max_days: int | None = None) -> Column:
    """Days to re-read = today - latest, at least 1; 1 when nothing landed.

    ``max_days=30`` reproduces the usual clamp, which leaves older missing days
    unread after a longer outage; by default there is none.
    """
    gap = F.greatest(F.datediff(today, latest_day), F.lit(1))
    return F.coalesce(gap if max_days is None else F.least(gap, F.lit(max_days)), F.lit(1))


def landing_gap(files: DataFrame, name_col: str, today: Column, max_days: int | None = None) -> DataFrame:
    """S9 over a listing of landed files (e.g. ``_metadata.file_name``): newest
    date in any name and the look-back that follows from it."""
    latest = files.agg(F.max(date_from_name(name_col)).alias("latest_day"))
    return latest.select("latest_day", lookback_days(F.col("latest_day"), today, max_days).alias("lookback_days"))
