"""Skew-safe per-entity windows: split each entity's rows into time chunks.

A window partitioned by the entity key puts all rows of one entity into one
task.  If one entity holds a third of the data, that task holds a third of
the data.  These helpers compute the same results with windows partitioned
by (entity, chunk), where ``chunk`` is a monotone bucket of the ordering
timestamp (e.g. the day).  Work is spread over chunks, and what crosses a chunk
boundary goes through small per-(entity, chunk) tables:

* LAG / LEAD: each chunk's first (last) row takes its value from the previous
  (next) non-empty chunk's last (first) row — a ``carry`` table with one row
  per (entity, chunk), joined back on (entity, chunk);
* running sums: per-chunk totals, prefix-summed over chunks, added as an
  offset;
* value-range frames (look-back): rows within the look-back of the next
  chunk are copied into it as context rows and dropped afterwards (requires
  look-back <= chunk length).

The big side stays partitioned by (entity, chunk) throughout; only the small
tables are re-shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = "__chunk"


def with_chunk(df: DataFrame, chunk: Column) -> DataFrame:
    return df.withColumn(CHUNK, chunk)


def day_chunk(ts: str) -> Column:
    """Default chunking: the UTC day of the timestamp."""
    return F.date_trunc("day", F.col(ts)).cast("timestamp_ntz")


def chunked_lag(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: dict[str, str],
                defaults: dict[str, Column] | None = None) -> DataFrame:
    """``out = LAG(src, 1[, default]) OVER (PARTITION BY keys ORDER BY order)``
    for each ``out: src`` in ``cols``, on a frame that has ``__chunk``.

    Windows run per (keys, chunk); a chunk's first row takes the previous
    chunk's last row (or the default when the entity has no earlier row).
    """
    defaults = defaults or {}
    pk = [*keys, CHUNK]
    w = Window.partitionBy(*pk).orderBy(*order)
    srcs = list(dict.fromkeys(cols.values()))
    d = df.select("*", F.row_number().over(w).alias("__rn"),
                  *[F.lag(src).over(w).alias(f"__l_{out}") for out, src in cols.items()])
    # Boundary rows are aggregated from the window output: it is already
    # partitioned by (keys, chunk), so the aggregation needs no shuffle and
    # both branches read one (reused) exchange of the input.  Aggregating the
    # input instead would add a partial aggregate below a second exchange and
    # compute the whole upstream plan twice.
    last = d.groupBy(*pk).agg(
        F.max_by(F.struct(*[F.col(s).alias(s) for s in srcs]), F.struct(*order)).alias("__last"))
    carry = last.select(*pk, F.lag("__last").over(Window.partitionBy(*keys).orderBy(CHUNK)).alias("__carry"))
    j = d.join(carry, pk, "left")
    fixed = []
    for out, src in cols.items():
        dflt = defaults.get(out, F.lit(None))
        first = F.when(F.col("__carry").isNotNull(), F.col("__carry")[src]).otherwise(dflt)
        fixed.append(F.when(F.col("__rn") == 1, first).otherwise(F.col(f"__l_{out}")).alias(out))
    return j.select(*df.columns, *fixed)


def chunked_lead(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: dict[str, str],
                 defaults: dict[str, Column] | None = None) -> DataFrame:
    """``out = LEAD(src, 1[, default])`` over the entity, per (keys, chunk)."""
    defaults = defaults or {}
    pk = [*keys, CHUNK]
    w = Window.partitionBy(*pk).orderBy(*order)
    srcs = list(dict.fromkeys(cols.values()))
    d = df.select("*", F.lead(F.lit(1)).over(w).isNull().alias("__is_last"),
                  *[F.lead(src).over(w).alias(f"__n_{out}") for out, src in cols.items()])
    first = d.groupBy(*pk).agg(
        F.min_by(F.struct(*[F.col(s).alias(s) for s in srcs]), F.struct(*order)).alias("__first"))
    carry = first.select(*pk, F.lead("__first").over(Window.partitionBy(*keys).orderBy(CHUNK)).alias("__carry"))
    j = d.join(carry, pk, "left")
    fixed = []
    for out, src in cols.items():
        dflt = defaults.get(out, F.lit(None))
        nxt = F.when(F.col("__carry").isNotNull(), F.col("__carry")[src]).otherwise(dflt)
        fixed.append(F.when(F.col("__is_last"), nxt).otherwise(F.col(f"__n_{out}")).alias(out))
    return j.select(*df.columns, *fixed)


def chunked_running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column,
                        out: str) -> DataFrame:
    """``SUM(value) OVER (PARTITION BY keys ORDER BY order)`` (ROWS frame up
    to the current row): per-chunk running sum plus the totals of all
    earlier chunks.  ``order`` must be unique within a key."""
    pk = [*keys, CHUNK]
    w = Window.partitionBy(*pk).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumn("__v", value).withColumn("__local", F.sum("__v").over(w))
    tot = d.groupBy(*pk).agg(F.sum("__v").alias("__tot"))
    wk = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(*pk, F.coalesce(F.sum("__tot").over(wk), F.lit(0)).alias("__off"))
    j = d.join(off, pk, "left")
    return j.select(*df.columns, (F.col("__local") + F.col("__off")).alias(out))


def with_lookback_context(df: DataFrame, ts: str, chunk_of: callable, lookback: Column,
                          step: str = "1 DAY") -> DataFrame:
    """Rows plus copies of the rows within ``lookback`` of later chunks, tagged
    ``__ctx`` (context only).  ``chunk_of(col)`` maps a timestamp to its chunk,
    which starts every ``step``; a look-back over several chunks copies a row
    to each chunk in reach."""
    own = chunk_of(F.col(ts))
    ahead = chunk_of(F.col(ts) + lookback)
    chunks = F.array_distinct(F.concat(F.sequence(own, ahead, F.expr(f"INTERVAL {step}")), F.array(ahead)))
    return df.select("*", F.explode(chunks).alias(CHUNK)).withColumn("__ctx", F.col(CHUNK) != own)
