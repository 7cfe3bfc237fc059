"""Where a job may keep files that the driver and all executors see."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir (or SparkContext.setCheckpointDir's folder); an error where neither is set."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = given.get() if given.isDefined() else None
    if not found:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{found.rstrip('/')}/readlake/{name}-{uuid.uuid4().hex}"
