"""Session settings that the library is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int = 8, memory: str = "8g", name: str = "rasterloom", **more: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller's own session is used."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    settings = SETTINGS | {"spark.driver.memory": memory, "spark.sql.shuffle.partitions": str(cores)} | more
    spark = builder.config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
