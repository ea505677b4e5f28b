"""The session that tests, the bench and scripts use; queries take whatever session they are given."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(cores: str | int | None = None, **extra: str) -> SparkSession:
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    conf = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("TIDEWAVE_DRIVER_MEMORY", "8g"),
        "spark.driver.host": "127.0.0.1",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | extra
    spark = SparkSession.builder.master(f"local[{cores}]").appName("tidewave").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
