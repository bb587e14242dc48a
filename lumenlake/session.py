"""Session settings that every query of this library assumes."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Timestamps are compared as UTC; the rest are Spark's adaptive defaults, stated.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cpus: int | str = "*", app: str = "lumenlake", **more: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster, submit with SETTINGS."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in (SETTINGS | {"spark.sql.shuffle.partitions": "8"} | more).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str):
    """A catalogue table by name; columns are pruned by what the query selects."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
