"""Session settings that the library's semantics rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(name: str = "lodestream", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; a repeated map key takes the last value.

    Shuffle partitions are left to the cluster's settings; size them so that a partition fits an
    executor core's memory.
    """
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    } | conf
    return builder.config(map=settings).getOrCreate()
