"""Shared building blocks of the registered queries (all lazy DataFrames)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import HIGH_RISK_PROBABILITY
from ..operators.cohort import cohort
from ..operators.survival import horizon_probabilities, nelson_aalen, score, theme_contributions
from ..session import cut_lineage


def cohort_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort(spark, sf_dir)


def scored_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(cohort(spark, sf_dir))


def curve_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nelson_aalen(cohort(spark, sf_dir))


def materialized_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cohort written once to the shared checkpoint folder: consumers
    that fit statistics and then score read it instead of re-running the
    orders aggregation for every fit step."""
    return cut_lineage(cohort(spark, sf_dir))


def scores_from(c: DataFrame, kind: str = "nearest") -> DataFrame:
    return horizon_probabilities(score(c), nelson_aalen(c), kind=kind)


def scores_df(spark: SparkSession, sf_dir: str, kind: str = "nearest") -> DataFrame:
    """Cohort + scaled features + margin + horizon probabilities."""
    return scores_from(materialized_cohort(spark, sf_dir), kind)


def risk_scores_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score table: probabilities and theme contributions per entity."""
    s = theme_contributions(scores_df(spark, sf_dir))
    return s.select("emp_key", "employee_id", "department", "prob_1m", "prob_3m", "prob_6m", "prob_12m",
                    "general_risk_score", "contrib_identity", "contrib_environment",
                    "contrib_compensation", "contrib_sentiment", "contrib_tenure")


def any_horizon_high(threshold: float = HIGH_RISK_PROBABILITY):
    return F.greatest("prob_1m", "prob_3m", "prob_6m", "prob_12m") >= F.lit(threshold)
