"""Enum validation (V1, V2, X7) with a choice of policy.

* ``fail``   — raise on the first bad value (the reference's behaviour: the
  whole load aborts, via ``raise_error`` inside the projection);
* ``null``   — replace a bad value by NULL;
* ``keep``   — keep it (use with :func:`enum_reason` to quarantine rows).

NULL and '' always become NULL for scalars; array elements keep ''.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _bad(value: Column, name: str, policy: str, array: bool = False) -> Column:
    if policy == "fail":
        what = f"Invalid {name} array element: " if array else f"Invalid {name}: "
        return F.raise_error(F.concat(F.lit(what), value)).cast("string")
    if policy == "null":
        return F.lit(None).cast("string")
    if policy == "keep":
        return value
    raise ValueError(f"unknown policy {policy}")


def validate_enum(col: str | Column, domain: Sequence[str], name: str, policy: str = "fail") -> Column:
    """V1: NULL/'' -> NULL, allowed -> value, anything else per ``policy``."""
    v = _c(col)
    return (
        F.when(v.isNull(), F.lit(None).cast("string"))
        .when(v == "", F.lit(None).cast("string"))
        .when(v.isin(*domain), v)
        .otherwise(_bad(v, name, policy))
    )


def validate_enum_list(col: str | Column, domain: Sequence[str], name: str, policy: str = "fail") -> Column:
    """V2: the same check on every element of a string array."""
    return F.transform(
        _c(col),
        lambda x: F.when(x.isNull(), F.lit(None).cast("string")).when(x.isin(*domain), x).otherwise(
            _bad(x, name, policy, array=True)
        ),
    )


def enum_reason(col: str | Column, domain: Sequence[str]) -> Column:
    """Why a value would fail V1: NULL when acceptable, else 'unknown'."""
    v = _c(col)
    return F.when(v.isNull() | (v == "") | v.isin(*domain), F.lit(None).cast("string")).otherwise(F.lit("unknown"))


def assert_not_null(df, cols: Sequence[str]):
    """Constraint check: rows violating NOT NULL, as a DataFrame (empty = OK)."""
    cond = None
    for c in cols:
        e = F.col(c).isNull()
        cond = e if cond is None else cond | e
    return df.filter(cond)


def duplicate_keys(df, keys: Sequence[str]):
    """Constraint check: keys occurring more than once (empty = unique)."""
    return df.groupBy(*keys).count().filter(F.col("count") > 1)
