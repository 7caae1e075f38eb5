"""Spark session and table access."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def local_session(cpus: int | str = "*", app: str = "quernstone", **conf: str) -> SparkSession:
    """A session for one machine: used by tests and the bench, never by operators."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("QUERNSTONE_DRIVER_MEMORY", "8g"),
        "spark.sql.warehouse.dir": "/tmp/quernstone-warehouse",
    } | conf
    spark = SparkSession.builder.master(f"local[{cpus}]").appName(app).config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; filters and projections on it reach the Parquet reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
