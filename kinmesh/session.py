"""A Spark session with the settings that the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, *, app: str = "kinmesh", shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """AQE on (coalescing and skew joins), Arrow on, UTC. On a cluster leave master and shuffle_partitions to the submit command."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    return builder.config(map=settings | conf).getOrCreate()
