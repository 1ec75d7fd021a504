"""A session with the settings that the library is tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str = "local[*]", shuffle_partitions: int = 8, memory: str = "8g", **more: str) -> SparkSession:
    builder = SparkSession.builder.master(master).config("spark.driver.memory", memory).config("spark.sql.shuffle.partitions", str(shuffle_partitions)).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    for key, value in {**SETTINGS, **more}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
