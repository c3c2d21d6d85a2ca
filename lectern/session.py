"""Session with the settings the engine expects, and the loader of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "lectern", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; on a cluster, master and memory come from the submit command."""
    b = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def empty(spark: SparkSession, ddl: str) -> DataFrame:
    return spark.createDataFrame([], ddl)
