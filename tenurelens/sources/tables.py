"""Table scans over the driver's parquet tables.

Scans are plain ``spark.read.parquet``; every caller selects only the
columns it needs so Catalyst prunes the ReadSchema and pushes filters into
the parquet reader.
"""
from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def scan(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Read one table; ``columns`` prunes the scan to what the plan uses."""
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


def register_views(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Register the tables as temp views for SQL-written operators."""
    for name in names:
        path = table_path(sf_dir, name)
        if os.path.exists(path):
            spark.read.parquet(path).createOrReplaceTempView(name)
