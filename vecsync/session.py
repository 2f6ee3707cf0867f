"""SparkSession helpers.

Cluster settings win: nothing here overrides a value the session already
has.  Local defaults are only filled in where a setting is unset (tests,
bench).
"""
from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

LOCAL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # embedding calls are side effects: never run a task twice on purpose
    "spark.speculation": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "vecsync", extra: dict | None = None) -> SparkSession:
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in LOCAL_DEFAULTS.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    b = b.config("spark.driver.memory", os.environ.get("VECSYNC_DRIVER_MEM", "16g"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names in spark.checkpoint.dir.

    Only a local session without one gets a private scratch folder; on a cluster a
    machine-local folder would lose files, so there the setting is required.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that the driver "
                               f"and all executors of {master} share")
        d = tempfile.mkdtemp(prefix="vecsync-ckpt-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d
