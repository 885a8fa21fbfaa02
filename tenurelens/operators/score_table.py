"""The stored score table: bucketed by id, read by key, compared with a second
way of scoring."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import output_dir
from .survival import FIXED_COEFFICIENTS, FIXED_INTERCEPT, SCORE_FEATURES

BUCKETS = 64


def write_bucketed(scores: DataFrame, key: str, buckets: int = BUCKETS) -> str:
    """Write ``scores`` as a table bucketed and sorted by ``key`` in a folder of
    its own; returns the table's name.  Lookups read one bucket, joins on the
    key with another table of as many buckets need no exchange."""
    name = f"scores_{uuid.uuid4().hex}"
    path = output_dir(scores.sparkSession, name)
    scores.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return name


def lookup(spark: SparkSession, name: str, key: str, value) -> DataFrame:
    return spark.table(name).where(F.col(key) == value)


def probabilities_by_terms(scaled: DataFrame, curve: DataFrame, horizon: int) -> DataFrame:
    """(emp_key, prob) of the fixed model on a second way: features and values
    as rows, joined to the table of coefficients and summed, and the curve's
    nearest point by rank."""
    spark = scaled.sparkSession
    beta = spark.createDataFrame(list(FIXED_COEFFICIENTS.items()), "feature string, beta double")
    terms = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"f_{f}").alias("x")) for f in SCORE_FEATURES]))
    margin = (scaled.select("emp_key", terms.alias("t")).join(F.broadcast(beta), F.col("t.feature") == beta["feature"])
              .groupBy("emp_key").agg((F.sum(F.col("t.x") * F.col("beta")) + FIXED_INTERCEPT).alias("margin")))
    near = curve.orderBy(F.abs(F.col("t") - horizon), "t").limit(1).first()["s0"]
    clipped = F.least(F.greatest("margin", F.lit(-15.0)), F.lit(15.0))
    return margin.select("emp_key", (1.0 - F.exp(F.exp(clipped) * F.log(F.lit(near)))).alias("prob"))


def reconcile(stored: DataFrame, fresh: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """One row: ids of either side, the largest difference of ``prob`` and how
    many ids differ by more than ``tolerance`` or lack a side."""
    both = stored.select("emp_key", F.col("prob").alias("a")).join(fresh.select("emp_key", F.col("prob").alias("b")), "emp_key", "full")
    diff = F.abs(F.col("a") - F.col("b"))
    return both.agg(F.count(F.lit(1)).alias("n"), F.max(diff).alias("max_abs_diff"),
                    F.count_if(F.coalesce(diff > tolerance, F.lit(True))).alias("n_diff"))
