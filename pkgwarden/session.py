"""Session settings that the results rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(
    app_name: str = "pkgwarden", master: str | None = None, **settings: str
) -> SparkSession:
    """A session with UTC times, ANSI errors and adaptive execution.

    Sizes such as the number of shuffle partitions are left to the cluster and to adaptive
    execution unless given: ``build_session(**{"spark.sql.shuffle.partitions": "8"})``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    fixed = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
        # Recording the Python line of every expression makes plans slow to build.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    for name, value in {**fixed, **settings}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()
