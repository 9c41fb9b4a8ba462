"""Spark sessions with the settings that the operators expect."""

from pyspark.sql import SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; conf entries use underscores for dots."""
    builder = SparkSession.builder.appName("talus")
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.ui.enabled": "false"}
    return builder.config(map=settings | {k.replace("_", "."): v for k, v in conf.items()}).getOrCreate()
