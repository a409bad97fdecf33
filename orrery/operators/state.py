"""Latest-state as a table that batches are merged into (Q-A, Q-B, A1-A4, K2-K6).

A state has one row per key.  For each *part* it keeps a value and the place in
the order (time, then a hash of the row) of the newest row that gave it: the
newest whole row, the newest non-NULL value of a column, the newest time with a
condition.  Keeping the newer of two is associative, commutative and repeatable,
so the state of a log is the state of its batches merged in any order, and a
batch that is merged twice changes nothing: a job that died halfway is just
repeated.  A release reads the state and the new rows, never the old log.

Building and merging are one aggregation each, with map-side combine: a hot key
is one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.operators.upsert import Stage, fold_stages


@dataclass
class Part:
    """One kept value: ``value`` of the newest row on which ``where`` holds."""

    name: str
    value: Column
    where: Column | None = None


def reduce_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], parts: Sequence[Part]) -> DataFrame:
    """The state of rows: keys and, per part, ``<name>`` = (at, v).  Values that
    contain maps have no order and cannot be kept."""
    at = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]).alias("at")
    kept = [F.struct(at, p.value.alias("v")) for p in parts]
    return df.groupBy(*keys).agg(*[F.max(x if p.where is None else F.when(p.where, x)).alias(p.name) for p, x in zip(parts, kept)])


def merge(states: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """One state of several."""
    both = reduce(DataFrame.unionByName, states)
    return both.groupBy(*keys).agg(*[F.max(c).alias(c) for c in both.columns if c not in keys])


# ------------------------------------------------------------ latest state

def latest_parts(columns: Sequence[str], key: Sequence[str], ts: str, nonnull_cols: Sequence[str] = (),
                 filtered_ts: dict[str, Column] | None = None) -> list[Part]:
    """The parts of :func:`orrery.operators.latest.latest_state`: the newest row,
    newest non-NULL values, and times under conditions."""
    plain = [c for c in columns if c not in {*key, ts, *nonnull_cols}]
    parts = [Part("row", F.struct(F.col(ts).alias(ts), *[F.col(c) for c in plain]))]
    parts += [Part(f"v_{c}", F.col(c), F.col(c).isNotNull()) for c in nonnull_cols]
    return parts + [Part(f"t_{n}", F.col(ts), cond) for n, cond in (filtered_ts or {}).items()]


def latest_rows(state: DataFrame, key: Sequence[str], ts: str, nonnull_cols: Sequence[str] = (), filtered_ts: Sequence[str] = ()) -> DataFrame:
    """The rows of ``latest_state`` from a state with :func:`latest_parts`."""
    plain = [f.name for f in state.schema["row"].dataType["v"].dataType.fields if f.name != ts]
    return state.select(*key, *[F.col(f"row.v.{c}").alias(c) for c in plain], *[F.col(f"v_{c}.v").alias(c) for c in nonnull_cols],
                        F.col(f"row.v.{ts}").alias(ts), *[F.col(f"t_{n}.v").alias(n) for n in filtered_ts])


# ------------------------------------------------------------ merge stages

def stage_state(stages: Sequence[Stage], keys: Sequence[str], ts: str, cols: Sequence[str]) -> DataFrame:
    """Per key and stage the newest time and the newest non-NULL value of each
    column: all that ``merge_latest`` needs of its sources.  One aggregation."""
    rows = reduce(DataFrame.unionByName, [st.source.select(*keys, ts, *cols, F.lit(i).alias("__stage")) for i, st in enumerate(stages, 1)])
    parts = [Part(f"s{i}_{c}", F.col(c), (F.col("__stage") == i) & F.col(c).isNotNull()) for i in range(1, len(stages) + 1) for c in (ts, *cols)]
    return reduce_rows(rows, keys, [F.col(ts), F.xxhash64(*[F.col(c) for c in (ts, *cols)])], parts)


def stage_rows(state: DataFrame, stages: Sequence[Stage], keys: Sequence[str], ts: str, cols: Sequence[str]) -> DataFrame:
    """What ``merge_latest`` gives for an empty target and all rows in the state."""
    types = {c: state.schema[f"s1_{c}"].dataType["v"].dataType for c in (ts, *cols)}
    start = state.select(*keys, *[F.lit(None).cast(t).alias(f"__c_{c}") for c, t in types.items()], F.lit(False).alias("__present"),
                         *[F.col(f"s{i}_{c}.v").alias(f"__s{i}_{c}") for i in range(1, len(stages) + 1) for c in (ts, *cols)])
    return fold_stages(start, stages, keys, ts, cols)
