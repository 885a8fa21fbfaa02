"""Sinks: full-refresh parquet tables, partitioned JSON documents, typed-header
CSV exports and the run-metadata record.  Every write is an overwrite of a
deterministic path, so a retried job replaces its own partial output."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def output_dir(spark: SparkSession, name: str) -> str:
    """A folder under the shared checkpoint folder named by the cluster."""
    return ensure_checkpoint_dir(spark).rstrip("/") + "/tables/" + name


def overwrite_parquet(df: DataFrame, path: str, partition_by=None) -> str:
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def export_partitioned_json(nodes: DataFrame, edges: DataFrame, key: str, path: str) -> str:
    """One folder per ``key`` value with its graph as JSON lines: objects with
    ``kind`` and a nested ``node`` or ``edge``.  Nothing is gathered into one
    row: a department of any size is written by many tasks."""
    def lines(rows: DataFrame, kind: str) -> DataFrame:
        inner = F.struct(*[c for c in rows.columns if c != key])
        return rows.select(F.col(key), F.lit(kind).alias("kind"), inner.alias(kind))
    lines(nodes, "node").unionByName(lines(edges, "edge"), allowMissingColumns=True).write.mode("overwrite").partitionBy(key).json(path)
    return path


def read_partitioned_json(spark: SparkSession, path: str, nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """The exported objects read back with the schemas of ``nodes`` and ``edges``."""
    inner = lambda rows: ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in rows.schema if f.name != key)
    return spark.read.schema(f"{key} string, kind string, node struct<{inner(nodes)}>, edge struct<{inner(edges)}>").json(path)


def export_typed_csv(df: DataFrame, header_names: dict, path: str) -> str:
    """CSV with typed header names (``id:ID``, ``isActive:boolean``...)."""
    out = df.select(*[F.col(c).alias(header_names.get(c, c)) for c in df.columns])
    out.write.mode("overwrite").option("header", True).csv(path)
    return path


def run_metadata(spark: SparkSession, training: DataFrame, features: list[str], model_type: str) -> DataFrame:
    """One row: training rows, feature count, model type, run time."""
    return training.agg(F.count(F.lit(1)).alias("dataset_rows")).select(
        "dataset_rows", F.lit(len(features)).cast("bigint").alias("features_count"),
        F.lit(model_type).alias("model_type"), F.lit(spark.version).alias("engine_version"),
        F.current_timestamp().alias("training_timestamp"))
