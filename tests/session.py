"""One local Spark session for all tests."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

SMALL = "/root/testdata/sf0.001"


def make_session(folder: Path) -> SparkSession:
    spark = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", str(folder / "warehouse"))
        .config("spark.checkpoint.dir", str(folder / "shared"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
