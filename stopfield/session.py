"""Session helpers: runtime settings the operators rely on, and lineage cuts that survive a lost executor."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.session.timeZone": "UTC",
}

SHUFFLE_SETTINGS = {
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "1024",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
}
"""Partitions of a shuffle before adaptive execution merges the small ones, and the size they are merged to. They change no result."""


def tune(spark: SparkSession) -> SparkSession:
    """Set the session-level options (adaptive plans, skew joins, UTC).

    A shuffle starts with many partitions and small ones are merged up to a size, so what one task holds follows that size, not the input. Where
    the cluster sets either figure, or more shuffle partitions, its own stays.
    """
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    first, _ = SHUFFLE_SETTINGS
    for key, value in SHUFFLE_SETTINGS.items():
        if spark.conf.get(key, None) is None and not (key == first and int(spark.conf.get("spark.sql.shuffle.partitions")) > int(value)):
            spark.conf.set(key, value)
    return spark


def local_session(cpus: int | str = "*", app: str = "stopfield") -> SparkSession:
    """A session for tests and the bench on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder for checkpoints: the one the cluster names; a temporary one only for a local master without a setting."""
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor reaches")
        named = tempfile.mkdtemp(prefix="stopfield-checkpoint-")
    context.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and go on from there."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)
