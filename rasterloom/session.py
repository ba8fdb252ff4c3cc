"""A session with the settings that the engine is built for."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.python.filterPushdown.enabled": "true",
}


def session(**more: str) -> SparkSession:
    """The running session or a new one; more settings go by name with underscores for dots."""
    return SparkSession.builder.config(map=SETTINGS | {k.replace("_", "."): v for k, v in more.items()}).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set and all run on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="rasterloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")
