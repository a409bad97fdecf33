"""Session helpers.

Jobs never build their own session on a cluster; they take the one they
are given.  ``local_session`` exists for tests, the bench and examples.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Settings every orrery job relies on.  They are session-level SQL confs, so
# they can be applied to an existing session too.
SQL_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def apply_defaults(spark: SparkSession) -> SparkSession:
    for k, v in SQL_DEFAULTS.items():
        spark.conf.set(k, v)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "orrery",
                  checkpoint: str | None = None) -> SparkSession:
    """A local session for tests/bench: UI off, UTC, AQE on."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if checkpoint:
        builder = builder.config("spark.checkpoint.dir", checkpoint)
    for k, v in SQL_DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster it must be set: a folder of one machine would not do.  Only a
    local session without the setting gets a scratch folder of its own.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        if sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir: executors have folders of their own")
        d = tempfile.mkdtemp(prefix="orrery-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-path of the shared checkpoint folder for intermediate tables."""
    return checkpoint_dir(spark).rstrip("/") + "/" + name


def keep(df, name: str = "step"):
    """Write a frame to the shared checkpoint folder and read it back: computed
    once, with a measured size and a short lineage."""
    import uuid

    path = scratch_path(df.sparkSession, f"orrery-{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
