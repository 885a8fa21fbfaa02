"""Session helpers.

Library code never builds its own session: every operator takes DataFrames
(or a session handed in by the caller).  These helpers exist for tests, the
bench and the entry point, and for the one piece of cluster configuration the
library reads: the shared checkpoint folder.
"""
from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Session settings the engine expects.  AQE re-plans joins (broadcast vs
# sort-merge) from runtime sizes and splits skewed shuffle partitions.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cores: str = "*", shuffle_partitions: int = 8,
                  app_name: str = "tenurelens") -> SparkSession:
    """A local session for tests and the bench (never used by operators)."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app_name)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", os.environ.get("TENURELENS_DRIVER_MEM", "8g")))
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    The cluster's ``spark.checkpoint.dir`` wins; a private folder is only
    created when the setting is absent (local tests).
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = tempfile.mkdtemp(prefix="tenurelens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder.

    Used by iterative fits so that a lost executor recomputes from the
    checkpoint files rather than replaying every earlier round.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
