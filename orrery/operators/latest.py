"""Latest-state per key (A1-A5, A14, W6, Q-A).

All forms are single hash aggregations: Spark runs a partial aggregate on
each map task before the shuffle, so a key holding a third of the rows
still leaves every map task with one row for it.  No window sort is needed
(``row_number() = 1`` would sort every row of every key).

Ties on the ordering are broken by extra ``tiebreak`` columns so that the
result does not depend on task scheduling (quirk Q15).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _order(order: Sequence[str | Column]) -> Column:
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    return cols[0] if len(cols) == 1 else F.struct(*cols)


def newest(col: str | Column, order: Sequence[str | Column]) -> Column:
    """A2: value of ``col`` on the newest row, NULL kept."""
    return F.max_by(col, _order(order))


def newest_nonnull(col: str | Column, order: Sequence[str | Column]) -> Column:
    """A1/A3: newest non-NULL value of ``col``.

    Spark's ``max_by`` returns the value of the max-ordering row even if that
    value is NULL; rows whose ordering is NULL are skipped, so the ordering is
    nulled out where the value is NULL.
    """
    c = F.col(col) if isinstance(col, str) else col
    return F.max_by(c, F.when(c.isNotNull(), _order(order)))


def oldest_nonnull(col: str | Column, order: Sequence[str | Column]) -> Column:
    """A5: earliest non-NULL value of ``col`` (``arg_min`` with a NULL guard)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.min_by(c, F.when(c.isNotNull(), _order(order)))


def max_where(ts: str | Column, cond: Column) -> Column:
    """``max(ts) FILTER (WHERE cond)``."""
    t = F.col(ts) if isinstance(ts, str) else ts
    return F.max(F.when(cond, t))


def latest_row(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    cols: Sequence[str] | None = None,
) -> DataFrame:
    """The newest full row per key (DISTINCT ON ... ORDER BY ts DESC).

    ``order`` lists the ordering columns, most significant first, with a unique
    one as tie-break.  A single column (a timestamp) is not trusted to be
    unique: a hash of the row breaks its ties, whatever the row order.
    Output: keys followed by ``cols``.
    """
    cols = list(cols) if cols is not None else [c for c in df.columns if c not in keys]
    packed = F.struct(*[F.col(c) for c in cols])
    order = [*order, F.xxhash64(*[F.col(c) for c in cols])] if len(order) == 1 and cols else order
    return (
        df.groupBy(*keys)
        .agg(F.max_by(packed, _order(order)).alias("__row"))
        .select(*keys, *[F.col(f"__row.{c}").alias(c) for c in cols])
    )


def latest_state(
    log: DataFrame,
    key: Sequence[str],
    ts: str,
    nonnull_cols: Sequence[str] = (),
    filtered_ts: dict[str, Column] | None = None,
    tiebreak: Sequence[str] = (),
    exclude: Sequence[str] = (),
    extra_aggs: dict[str, Column] | None = None,
) -> DataFrame:
    """Q-A ``system_latest`` shape, generalised.

    Per key: newest row's value (NULL kept) for every column except
    ``nonnull_cols``, which take their newest non-NULL value; ``ts`` becomes
    ``max(ts)``; each ``filtered_ts[name] = cond`` adds ``max(ts) FILTER cond``;
    ``extra_aggs`` ride along in the same aggregation.  One shuffle.
    """
    order = [ts, *tiebreak]
    skip = set(key) | {ts} | set(nonnull_cols) | set(exclude)
    plain = [c for c in log.columns if c not in skip]
    aggs = []
    if plain:
        aggs.append(newest(F.struct(*[F.col(c) for c in plain]), order).alias("__row"))
    aggs += [newest_nonnull(c, order).alias(c) for c in nonnull_cols]
    aggs.append(F.max(ts).alias(ts))
    for name, cond in (filtered_ts or {}).items():
        aggs.append(max_where(ts, cond).alias(name))
    for name, agg in (extra_aggs or {}).items():
        aggs.append(agg.alias(name))
    out = log.groupBy(*key).agg(*aggs)
    sel = [
        *key,
        *[F.col(f"__row.{c}").alias(c) for c in plain],
        *nonnull_cols,
        ts,
        *(filtered_ts or {}),
        *(extra_aggs or {}),
    ]
    return out.select(*sel)
