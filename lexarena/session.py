"""Session builder and table access shared by every query."""

from __future__ import annotations

import math
import os

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "lexarena", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the engine relies on; a cluster supplies its own."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": os.environ.get("LEXARENA_DRIVER_MEMORY", "8g"),
    } | conf
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory (a file or a directory of part files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str, rows: int) -> DataFrame:
    """df dealt by a key over tasks of about `rows` rows each.

    Parquet is split by bytes, so the tasks that read short rows have very many of them: too many if
    each row is widened or costs much from there on. Counting a table reads its footers only.
    """
    return df.repartition(max(1, math.ceil(df.count() / rows)), key)
