"""Session construction shared by tests, the benchmark and command-line use."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cpus: str = "8", name: str = "treeline", **conf: str) -> SparkSession:
    """A local session with adaptive execution; a cluster passes its own session instead."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", conf.pop("shuffle_partitions", "8"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", conf.pop("driver_memory", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
