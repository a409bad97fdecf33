"""JSON text extraction (P1, P2, X20) on Spark's VARIANT type.

Parse once with ``try_parse_json`` (malformed text -> NULL, never an error),
then pull typed fields with ``try_variant_get`` (wrong type -> NULL).  Both
run in the JVM inside whole-stage codegen; no Python is involved.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def parse(text: str | Column) -> Column:
    """Text -> VARIANT; malformed input gives NULL."""
    return F.try_parse_json(_c(text))


def parse_once(text: str | Column) -> Column:
    """``parse`` for a document column that many filters and fields read.

    Predicate pushdown rewrites a filter on fields of the document in terms
    of the projection below it, which copies the parse into the filter once
    per field reference (dozens of parses per line).  A trivially true
    nondeterministic guard (``spark_partition_id() >= 0``, which no optimizer
    rule folds, unlike ``rand() >= 0``) makes the defining projection a
    pushdown fence, so every line is parsed exactly once.  It is allowed in
    Structured Streaming too.
    """
    return F.when(F.spark_partition_id() >= 0, F.try_parse_json(_c(text)))


def field(doc: str | Column, path: str, type_: str = "string") -> Column:
    """``doc->>'path'`` with a cast: ``path`` like ``$.a.b`` or ``$.arr[0]``.

    ``doc`` may be VARIANT or JSON text (text is parsed first).
    """
    return F.try_variant_get(_c(doc), path, type_)


def text_field(text: str | Column, path: str, type_: str = "string") -> Column:
    """Shortcut: parse JSON text and extract one typed field."""
    return F.try_variant_get(parse(text), path, type_)


def as_nested(doc: str | Column, ddl: str) -> Column:
    """JSON -> nested struct/array with a fixed schema (DDL string)."""
    return F.try_variant_get(_c(doc), "$", ddl)
