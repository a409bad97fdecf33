"""orrery: Spark-native analytics over nested, out-of-order event logs.

Every operator is a function ``DataFrame -> DataFrame`` (or ``-> Column``)
built from Spark SQL / DataFrame primitives so that Catalyst can push
filters, prune columns and pick the join strategy.  Sub-packages:

* ``sources``   – scans: gated NDJSON ingest, ledgers, coverage, driver tables
* ``functions`` – column expressions: normalisers, enum checks, JSON, time, arrays
* ``operators`` – latest-per-key, merge/upsert, time series, nested, spatial, rules
* ``sinks``     – append, versioned publish, CSV export, retention, compaction
* ``streaming`` – Structured Streaming ingestion and stateful latest-state
* ``plans``     – composite marts and the query catalogue run by the driver
"""

__version__ = "0.1.0"
