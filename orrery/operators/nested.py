"""Nested data: explode / inline and array, map, struct helpers
(E1-E6, X14-X19, X23, U3, F6, F11, A10, A11).

Generators (``explode``/``inline``) run inside the scan's codegen stage and
never shuffle; all array/map helpers are built-in higher-order functions.
Like the reference's UNNEST, the plain forms drop rows whose array is NULL
or empty.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def inline_rows(df: DataFrame, arr: str, keep: Sequence[str] | None = None) -> DataFrame:
    """E1 ``UNNEST(list_of_struct, recursive := true)``: one row per element,
    struct fields as columns; lists inside the struct stay lists."""
    keep = [c for c in df.columns if c != arr] if keep is None else list(keep)
    return df.select(*keep, F.inline(arr))


def explode_col(df: DataFrame, arr: str, alias: str, keep: Sequence[str] | None = None) -> DataFrame:
    """E2 ``unnest(list)`` as one column."""
    keep = [c for c in df.columns if c != arr] if keep is None else list(keep)
    return df.select(*keep, F.explode(arr).alias(alias))


def struct_columns(df: DataFrame, struct_col: str, keep: Sequence[str] = ()) -> DataFrame:
    """E3 ``unnest(struct)``: struct fields become columns."""
    return df.select(*keep, f"{struct_col}.*")


def explode_with_position(df: DataFrame, arr: str, alias: str, pos: str = "pos",
                          keep: Sequence[str] | None = None) -> DataFrame:
    """E5 ``generate_subscripts(list, 1)`` beside ``unnest``: 1-based position."""
    keep = [c for c in df.columns if c != arr] if keep is None else list(keep)
    return df.select(*keep, F.posexplode(arr).alias("__p", alias)).withColumn(pos, F.col("__p") + 1).drop("__p")


def explode_two_level(df: DataFrame, outer: str, inner: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Explode ``outer`` (list of struct), then each ``inner`` list of the
    element, concatenated (U3), one row per inner element.  Inner struct
    fields that clash with outer fields get a ``_1`` suffix, as DuckDB names
    duplicate columns."""
    lvl1 = df.select(*keep, F.explode(outer).alias("__o"))
    outer_fields = [f.name for f in lvl1.schema["__o"].dataType.fields]
    inner_lists = [F.coalesce(F.col(f"__o.{i}"), F.array().cast(lvl1.schema["__o"].dataType[i].dataType))
                   for i in inner]
    lvl2 = lvl1.select(*keep, "__o", F.explode(F.concat(*inner_lists)).alias("__i"))
    inner_fields = [f.name for f in lvl2.schema["__i"].dataType.fields]
    outer_sel = [F.col(f"__o.{f}").alias(f) for f in outer_fields if f not in inner]
    inner_sel = [F.col(f"__i.{f}").alias(f + "_1" if f in outer_fields else f) for f in inner_fields]
    return lvl2.select(*keep, *outer_sel, *inner_sel)


def has_any(arr: str | Column, values: Sequence) -> Column:
    """X16 ``list_has_any``: FALSE (not NULL) when nothing matches, even if
    the list holds NULLs — DuckDB semantics, unlike ``arrays_overlap``."""
    lit = F.array(*[F.lit(v) for v in values])
    return F.coalesce(F.arrays_overlap(_c(arr), lit), F.lit(False))


def has(arr: str | Column, value) -> Column:
    """X16/F11 ``list_contains``."""
    return F.array_contains(_c(arr), value)


def non_empty(arr: str | Column) -> Column:
    """F11 ``list != []`` (NULL list -> FALSE)."""
    return F.coalesce(F.size(_c(arr)) > 0, F.lit(False))


def exists_in(arr: str | Column, pred) -> Column:
    """F6 ``EXISTS (SELECT 1 FROM UNNEST(arr) ...)`` without exploding."""
    return F.exists(_c(arr), pred)


def concat_lists(a: str | Column, b: str | Column, elem_type: str) -> Column:
    """U3 ``list_concat``: NULL lists count as empty."""
    empty = F.array().cast(f"array<{elem_type}>")
    return F.concat(F.coalesce(_c(a), empty), F.coalesce(_c(b), empty))


def sort_by_first_field(arr: str | Column) -> Column:
    """A list of structs sorted by the struct's first field (then the rest)."""
    return F.array_sort(_c(arr))


def or_empty(arr: str | Column, elem_type: str) -> Column:
    """P10 ``COALESCE(list, [])`` with a typed empty list."""
    return F.coalesce(_c(arr), F.array().cast(f"array<{elem_type}>"))


def distinct_sorted(col: str | Column) -> Column:
    """A11 ``list(DISTINCT x)`` in a deterministic order."""
    return F.sort_array(F.collect_set(_c(col)))


def joined_text(items: Column, sep: str = ";") -> Column:
    """A10 for comparisons: an aggregated list as sorted text."""
    return F.array_join(F.array_sort(items), sep)


def map_of(entries: str | Column, key_field: str = "key") -> Column:
    """X18 ``map_from_entries`` after dropping repeated keys (first wins)
    instead of failing on duplicates (quirk Q14)."""
    e = _c(entries)
    ks = F.transform(e, lambda x: x.getField(key_field))
    firsts = F.filter(e, lambda x, i: F.array_position(ks, x.getField(key_field)) == i + 1)
    return F.map_from_entries(firsts)
