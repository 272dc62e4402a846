"""Session and table helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session with adaptive planning; on a cluster the submitted configuration counts."""
    build = SparkSession.builder.appName("driftline").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.ui.enabled", "false")
    return build.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", str(partitions)).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
