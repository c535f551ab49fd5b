"""Session helper."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app_name: str = "mercato", master: str | None = None, **conf: object) -> SparkSession:
    """A session with the settings the operators are written for.

    Every setting can be overridden through ``conf`` (dots written as ``__``).
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        # Splits a hot customer, order or product in every shuffled fact-to-dimension join.
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), str(value))
    return builder.getOrCreate()
