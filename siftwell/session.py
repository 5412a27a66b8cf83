"""The session with the settings that the operators count on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: A cluster's own settings win; these fill what is unset.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build(name: str = "siftwell", master: str | None = None, **settings: str) -> SparkSession:
    """A session with SETTINGS and ``settings``; the names of the latter have underscores for dots."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("_", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
