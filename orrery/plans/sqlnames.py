"""The tables and look-up functions under SQL names.

``install`` makes a namespace with external tables over the stored Parquet and
SQL functions in it, so that analysts ask for distances by name:

    SELECT star.system_distance('Sol', 'Achenar');
    SELECT StationName, star.distance_from(SystemAddress, array(0D, 0D, 0D)) FROM star.stations;
    SELECT * FROM systems_within(array(0D, 0D, 0D), 20D);

The functions are SQL text that Catalyst inlines into the caller's plan; there is
no Python in them.  ``systems`` needs SystemAddress, StarSystem and StarPos.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import SparkSession


def install(spark: SparkSession, tables: Mapping[str, str], namespace: str = "star") -> None:
    """Tables (name -> Parquet folder) and functions in ``namespace``, replaced if they are there."""
    spark.sql(f"CREATE NAMESPACE IF NOT EXISTS {namespace}")
    for name, path in tables.items():
        spark.sql(f"DROP TABLE IF EXISTS {namespace}.{name}")
        spark.sql(f"CREATE TABLE {namespace}.{name} USING parquet LOCATION '{path}'")
    for text in FUNCTIONS:
        spark.sql(text.format(ns=namespace))


FUNCTIONS = (
    """CREATE OR REPLACE FUNCTION {ns}.position_distance(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE
       RETURN sqrt(power(a[0] - b[0], 2) + power(a[1] - b[1], 2) + power(a[2] - b[2], 2))""",
    # One position per name or address; NULL if there is none.
    """CREATE OR REPLACE FUNCTION {ns}.position_of(system STRING) RETURNS ARRAY<DOUBLE>
       RETURN (SELECT first(StarPos) FROM {ns}.systems WHERE StarSystem = system)""",
    """CREATE OR REPLACE FUNCTION {ns}.system_distance(a STRING, b STRING) RETURNS DOUBLE
       RETURN {ns}.position_distance({ns}.position_of(a), {ns}.position_of(b))""",
    """CREATE OR REPLACE FUNCTION {ns}.position_at(address BIGINT) RETURNS ARRAY<DOUBLE>
       RETURN (SELECT first(StarPos) FROM {ns}.systems WHERE SystemAddress = address)""",
    """CREATE OR REPLACE FUNCTION {ns}.distance_from(address BIGINT, origin ARRAY<DOUBLE>) RETURNS DOUBLE
       RETURN {ns}.position_distance({ns}.position_at(address), origin)""",
    # A table function is called by a bare name, so it belongs to the session.
    """CREATE OR REPLACE TEMPORARY FUNCTION systems_within(origin ARRAY<DOUBLE>, reach DOUBLE)
       RETURNS TABLE (SystemAddress BIGINT, StarSystem STRING, distance DOUBLE)
       RETURN SELECT s.SystemAddress, s.StarSystem, {ns}.position_distance(s.StarPos, origin) AS distance
              FROM {ns}.systems s WHERE {ns}.position_distance(s.StarPos, origin) <= reach""",
)
