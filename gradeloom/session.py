"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import os
import sys
import tempfile

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

#: Settings that hold at any scale; the number of shuffle partitions is a floor that AQE coalesces.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Checkpoints go when nothing refers to them any more; a cluster's own session needs the same setting.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cores: int | str = 8, shuffle_partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("gradeloom")
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


# Python functions of this package travel by value, so that executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__.partition(".")[0]])


def prepare(spark: SparkSession) -> SparkSession:
    """The session, with functions of this package set to travel by value; importing this module does so too."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__.partition(".")[0]])
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    The setting is read from the session; only where it is unset, as in local
    tests, a temporary folder is taken.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by driver and executors")
    return os.path.join(tempfile.gettempdir(), "gradeloom-checkpoints")


def checkpointed(df: DataFrame, eager: bool = True) -> DataFrame:
    """The rows of df, kept reliably in the shared folder; see shared_folder."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=eager)
