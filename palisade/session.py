"""Session settings that the engine's semantics rely on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with UTC instants and adaptive execution.

    ``master`` and ``shuffle_partitions`` are for local runs; on a cluster the submit settings hold.
    """
    builder = SparkSession.builder.appName("palisade")
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if (master or "").startswith("local"):
        settings |= {"spark.ui.enabled": "false", "spark.driver.memory": os.environ.get("PALISADE_DRIVER_MEMORY", "8g"), "spark.driver.host": "127.0.0.1"}
    return builder.config(map=settings | conf).getOrCreate()
