"""Spark session with the settings this engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(name: str = "loomtext", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
