"""The session that tests and the bench use; on a cluster the caller brings its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[8]", partitions: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(master).appName("pagelake")
        .config("spark.sql.shuffle.partitions", partitions).config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
