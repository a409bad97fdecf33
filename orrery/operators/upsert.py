"""Upserts without a table format (K2-K6, K8, T3, T4, Q-B).

Spark's built-in Parquet source has no row-level MERGE, so a merge produces
the next snapshot version as a DataFrame; ``sinks.publish`` writes it and
switches the manifest.

``merge_latest`` folds any number of ordered MERGE stages into **one**
aggregation keyed on the merge key: target rows (stage 0) and raw source
rows (stages 1..n) are tagged, unioned and grouped once.  Per key it keeps
the target row and, for each stage, the newest non-NULL value of every
column (``arg_max`` semantics).  At most 1 + n values per key survive the
map-side partial aggregate, so a hot key never builds a large group, and
the sequential WHEN MATCHED / NOT MATCHED logic is then plain column
expressions.  Three DuckDB MERGE statements become one shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.operators.latest import latest_row


@dataclass
class Stage:
    """One MERGE statement.

    ``source`` has the key columns, ``ts`` and the merged columns (constants
    for columns the source does not carry).  When matched and the source row
    is newer, every column is replaced by the source value, except:
    ``keep_old`` columns take ``coalesce(target, source)`` and ``prefer_new``
    take ``coalesce(source, target)``.  When matched and not newer,
    ``fill_if_null`` columns are filled from the source where the target is
    NULL.  Unmatched source rows are inserted.
    """

    source: DataFrame
    keep_old: Sequence[str] = field(default_factory=tuple)
    prefer_new: Sequence[str] = field(default_factory=tuple)
    fill_if_null: Sequence[str] = field(default_factory=tuple)


def empty_like(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """K8: an empty relation with the schema of ``df.select(cols)``."""
    return df.select(*cols).limit(0)


def watermark_cutoff(target: DataFrame, ts: str, lateness: str = "1 hour") -> Column:
    """``coalesce(max(target.ts) - lateness, 1970-01-01)`` as a scalar subquery."""
    mx = target.agg(F.max(ts).alias("m")).select(
        F.coalesce(F.col("m") - F.expr(f"INTERVAL {lateness}"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    )
    return mx.scalar()


def cutoff_report(sources: dict[str, DataFrame], ts: str, cutoff: Column) -> DataFrame:
    """Q6 'ours': rows each source loses to the overlap cutoff (``ts <= cutoff``),
    which the reference drops silently.  One aggregation per source."""
    out = None
    for name, src in sources.items():
        flagged = src.select((F.col(ts) <= cutoff).alias("__late"))
        r = flagged.agg(F.count(F.when(F.col("__late"), 1)).alias("dropped"),
                        F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("source"), "dropped", "rows")
        out = r if out is None else out.unionByName(r)
    return out


def merge_latest(
    target: DataFrame,
    stages: Sequence[Stage],
    keys: Sequence[str],
    ts: str,
    cols: Sequence[str],
    cutoff: Column | None = None,
    incremental: bool = False,
) -> DataFrame:
    """Apply ``stages`` in order to ``target`` (unique on ``keys``).

    Each stage's source is reduced per key to the newest non-NULL value of
    every column (DuckDB ``arg_max``, which skips NULLs) and ``max(ts)``,
    after the optional ``cutoff`` filter ``ts > cutoff`` (T3).
    Output: ``keys``, ``ts``, ``cols`` — the next snapshot.

    ``incremental=True``: only target rows whose key occurs in a source go
    through the keyed aggregation; the rest pass through a ``left_anti`` join
    (broadcast by AQE when the touched keys are measured small), so a daily
    batch does not shuffle the whole snapshot.  Same result.
    """
    if incremental:
        srcs = [st.source if cutoff is None else st.source.filter(F.col(ts) > cutoff) for st in stages]
        touched = reduce(lambda a, b: a.unionByName(b), [x.select(*keys) for x in srcs]).distinct()
        changed = merge_latest(
            target.join(touched, list(keys), "left_semi"),
            [Stage(x, st.keep_old, st.prefer_new, st.fill_if_null) for x, st in zip(srcs, stages)],
            keys, ts, cols, cutoff=None,
        )
        rest = target.join(touched, list(keys), "left_anti").select(*keys, ts, *cols)
        return rest.unionByName(changed)
    vcols = [ts, *cols]
    parts = [target.select(*keys, F.lit(0).alias("__stage"), *vcols)]
    for i, st in enumerate(stages, 1):
        src = st.source if cutoff is None else st.source.filter(F.col(ts) > cutoff)
        parts.append(src.select(*keys, F.lit(i).alias("__stage"), *vcols))
    u = reduce(lambda a, b: a.unionByName(b), parts)

    # The expressions are written as SQL text: one parse in the JVM per
    # expression instead of one Py4J call per node (the plan is identical).
    q = _q
    t = q(ts)
    # Rows of one time: a hash of the row decides, not the order of arrival.
    u = u.withColumn("__tie", F.xxhash64(*[F.col(c) for c in vcols]))
    aggs = [f"max_by(struct({', '.join(q(c) for c in vcols)}), CASE WHEN __stage = 0 THEN {t} END) AS __t"]
    for i in range(1, len(stages) + 1):
        aggs.append(f"max(CASE WHEN __stage = {i} THEN {t} END) AS {q(f'__s{i}_{ts}')}")
        for c in cols:
            aggs.append(f"max_by({q(c)}, CASE WHEN __stage = {i} AND {q(c)} IS NOT NULL THEN struct({t}, __tie) END) "
                        f"AS {q(f'__s{i}_{c}')}")
    g = u.groupBy(*keys).agg(*[F.expr(a) for a in aggs])

    start = g.selectExpr(
        *[q(k) for k in keys],
        *[f"__t.{q(c)} AS {q('__c_' + c)}" for c in vcols],
        f"__t.{t} IS NOT NULL AS __present",
        *[q(f"__s{i}_{c}") for i in range(1, len(stages) + 1) for c in vcols],
    )
    return fold_stages(start, stages, keys, ts, cols)


def fold_stages(start: DataFrame, stages: Sequence[Stage], keys: Sequence[str], ts: str, cols: Sequence[str]) -> DataFrame:
    """Apply the WHEN rules of ``stages`` in order to one row per key: ``__c_<col>``
    is the target's value (``__present``: there is one), ``__s<i>_<col>`` what
    stage i's source has.

    Each stage is projected into plain columns so the next stage refers to
    columns, not to (repeated) copies of the previous stage's CASE expressions.
    """
    q, vcols = _q, [ts, *cols]
    stage_cols = [f"__s{i}_{c}" for i in range(1, len(stages) + 1) for c in vcols]
    kq, cur = [q(k) for k in keys], start
    for i, st in enumerate(stages, 1):
        sts, cts = q(f"__s{i}_{ts}"), q(f"__c_{ts}")
        has_s = f"({sts} IS NOT NULL)"
        insert = f"(NOT __present AND {has_s})"
        newer = f"(__present AND {has_s} AND {sts} > {cts})"
        matched = f"(__present AND {has_s})"
        nxt = []
        for c in vcols:
            sc, cc = q(f"__s{i}_{c}"), q(f"__c_{c}")
            if c in st.keep_old:
                upd = f"coalesce({cc}, {sc})"
            elif c in st.prefer_new:
                upd = f"coalesce({sc}, {cc})"
            else:
                upd = sc
            fill = (f" WHEN {matched} AND {cc} IS NULL AND {sc} IS NOT NULL THEN {sc}"
                    if c in st.fill_if_null else "")
            nxt.append(f"CASE WHEN {insert} THEN {sc} WHEN {newer} THEN {upd}{fill} ELSE {cc} END AS {cc}")
        rest = [c for c in stage_cols if not c.startswith(f"__s{i}_")]
        stage_cols = rest
        cur = cur.selectExpr(*kq, *nxt, f"__present OR {has_s} AS __present", *[q(c) for c in rest])
    return cur.filter("__present").selectExpr(*kq, *[f"{q('__c_' + c)} AS {q(c)}" for c in vcols])


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def keyed_replace(
    target: DataFrame,
    batch: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    newest_wins: bool = True,
) -> DataFrame:
    """K2/K3: dedupe ``batch`` per key by ``order`` and upsert into ``target``.

    ``newest_wins=True`` keeps whichever of target/batch row is newer (one
    aggregation).  ``False`` is INSERT OR REPLACE: the batch row replaces the
    target row regardless of timestamps (quirk Q2), a ``left_anti`` join plus
    union.
    """
    cols = target.columns
    if newest_wins:
        return latest_row(target.unionByName(batch.select(*cols)), keys, order, [c for c in cols if c not in keys])
    b = latest_row(batch.select(*cols), keys, order, [c for c in cols if c not in keys])
    return target.join(b.select(*keys), list(keys), "left_anti").unionByName(b)
