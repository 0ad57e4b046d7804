"""Session settings used by the tests, the bench and stand-alone runs.

A cluster brings its own session; nothing in the library needs a setting from here to be right.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(app: str = "furrow", cores: int | str = 8, partitions: int | None = None) -> SparkSession:
    """A local session with AQE on. One shuffle partition per core keeps small data quick."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("FURROW_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session
