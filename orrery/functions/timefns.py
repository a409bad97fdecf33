"""Time arithmetic as JVM-side column expressions.

Timestamps are ``TIMESTAMP_NTZ`` (UTC by convention) in the driver tables;
under a UTC session the NTZ -> TIMESTAMP cast is the identity on the wall
clock, so epoch arithmetic is exact.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The weekly cycle starts Thursday 07:00 UTC.  1970-01-01 was a
# Thursday, so epoch-aligned 7-day buckets with a 7-hour offset start there.
WEEK_US = 7 * 86400 * 1_000_000
TICK_OFFSET_US = 7 * 3600 * 1_000_000
HOUR_US = 3600 * 1_000_000


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def epoch_us(ts: str | Column) -> Column:
    """Microseconds since epoch for TIMESTAMP or TIMESTAMP_NTZ (UTC session)."""
    return F.unix_micros(_c(ts).cast("timestamp"))


def from_epoch_us(us: Column) -> Column:
    """Inverse of :func:`epoch_us`, returning TIMESTAMP_NTZ."""
    return F.timestamp_micros(us).cast("timestamp_ntz")


def cycle_start(ts: str | Column, period_us: int = WEEK_US, offset_us: int = TICK_OFFSET_US) -> Column:
    """Start of the epoch-aligned cycle containing ``ts`` (T7, Q17: floor to last tick)."""
    us = epoch_us(ts)
    return from_epoch_us(us - F.pmod(us - F.lit(offset_us), F.lit(period_us)))


def next_tick(ts: str | Column, period_us: int = WEEK_US, offset_us: int = TICK_OFFSET_US) -> Column:
    """First tick strictly after ``ts``: the end of its tumbling window (Q10 'ours')."""
    us = epoch_us(ts)
    return from_epoch_us(us - F.pmod(us - F.lit(offset_us), F.lit(period_us)) + F.lit(period_us))


def literal_tick(ts: str | Column) -> Column:
    """The reference's tick formula, kept for parity (quirk Q10).

    ``date_trunc('week', ts + 3 days - 7 hours) + 3 days 7 hours``: Monday
    weeks shifted to Thursday 07:00.  For a sample in the first 24 h of a
    cycle it returns a tick at or before the sample.
    """
    shifted = _c(ts) + F.expr("INTERVAL 3 DAYS") - F.expr("INTERVAL 7 HOURS")
    return F.date_trunc("week", shifted).cast("timestamp_ntz") + F.expr("INTERVAL 3 DAYS 7 HOURS")


def crossed_tick(prev_ts: Column, ts: Column, parity: bool = False) -> Column:
    """A reset tick lies in ``(prev_ts, ts]``."""
    if parity:
        t = literal_tick(prev_ts)
        return (ts >= t) & (prev_ts < t)
    return ts >= next_tick(prev_ts)


def js_round(x: Column) -> Column:
    """``Math.round``: half up toward +inf, i.e. ``floor(x + 0.5)`` (-2.5 -> -2)."""
    return F.floor(x + F.lit(0.5))


def seconds_between(start: Column, end: Column) -> Column:
    return (epoch_us(end) - epoch_us(start)) / F.lit(1e6)


# SQL-text forms of the same expressions, for operators that assemble whole
# projections as SQL (one JVM parse instead of many Py4J calls).

def epoch_us_sql(x: str) -> str:
    return f"unix_micros(CAST({x} AS TIMESTAMP))"


def next_tick_sql(x: str, period_us: int = WEEK_US, offset_us: int = TICK_OFFSET_US) -> str:
    us = epoch_us_sql(x)
    return (f"CAST(timestamp_micros({us} - pmod({us} - {offset_us}, {period_us}) + {period_us}) "
            f"AS TIMESTAMP_NTZ)")


def literal_tick_sql(x: str) -> str:
    return (f"(CAST(date_trunc('week', {x} + INTERVAL 3 DAYS - INTERVAL 7 HOURS) AS TIMESTAMP_NTZ) "
            f"+ INTERVAL 3 DAYS 7 HOURS)")


def crossed_tick_sql(prev_ts: str, ts: str, parity: bool = False) -> str:
    if parity:
        t = literal_tick_sql(prev_ts)
        return f"({ts} >= {t} AND {prev_ts} < {t})"
    return f"({ts} >= {next_tick_sql(prev_ts)})"
