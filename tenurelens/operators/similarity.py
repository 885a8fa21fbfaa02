"""Composite similarity distance between two entities.

0.6 · hierarchical (manager, department, project; equal thirds)
+ 0.2 · categorical (gender and performance tier, halves; when either side
  has no tier, gender carries the whole categorical weight)
+ 0.2 · continuous (age and risk, min-max normalised inside the department;
  halves).  Weight of an edge = round(1 - distance, 4).
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import group_normalise
from .graph import org_hierarchy
from .lists import performance_tier

W_HIER, W_CAT, W_CONT = 0.6, 0.2, 0.2


def similarity_inputs(cohort: DataFrame, scores: DataFrame, ratings: DataFrame, with_project) -> DataFrame:
    """Per entity: manager (reporting tree), project, gender, performance tier,
    in-department normalised age and risk."""
    tree = org_hierarchy(cohort).select("id", "manager_id")
    base = with_project(cohort).select(F.col("employee_id").alias("id"), "emp_key", "department", "project",
                                       "gender", "age")
    risk = scores.select("emp_key", F.coalesce("general_risk_score", F.lit(0.0)).alias("risk"))
    tier = ratings.select("emp_key", performance_tier(F.col("performance_score")).alias("tier"))
    x = base.join(risk, "emp_key", "left").join(tier, "emp_key", "left").join(tree, "id", "left")
    x = x.withColumn("risk", F.coalesce("risk", F.lit(0.0)))
    x = group_normalise(x, "age", "department", "age_norm")
    x = group_normalise(x, "risk", "department", "risk_norm")
    return x.select("id", "department", "project", "gender", "tier", "manager_id", "age_norm", "risk_norm")


def distance_expr(a: str = "x", b: str = "y"):
    def c(side, name):
        return F.col(f"{side}.{name}")
    mgr_same = (c(a, "manager_id") == c(b, "manager_id")) & (F.coalesce(c(a, "manager_id"), F.lit("")) != "")
    d_mgr = F.when(F.coalesce(mgr_same, F.lit(False)), 0.0).otherwise(1.0)
    d_dept = F.when(c(a, "department") == c(b, "department"), 0.0).otherwise(1.0)
    d_proj = F.when(c(a, "project") == c(b, "project"), 0.0).otherwise(1.0)
    hier = d_mgr / 3.0 + d_dept / 3.0 + d_proj / 3.0
    d_gender = F.when(c(a, "gender") == c(b, "gender"), 0.0).otherwise(1.0)
    both = c(a, "tier").isNotNull() & c(b, "tier").isNotNull()
    d_tier = F.when(c(a, "tier") == c(b, "tier"), 0.0).otherwise(1.0)
    cat = F.when(both, 0.5 * d_gender + 0.5 * d_tier).otherwise(d_gender)
    cont = 0.5 * F.abs(c(a, "age_norm") - c(b, "age_norm")) + 0.5 * F.abs(c(a, "risk_norm") - c(b, "risk_norm"))
    return W_HIER * hier + W_CAT * cat + W_CONT * cont


def composite_distance(pairs: DataFrame, att: DataFrame) -> DataFrame:
    """``pairs`` (a, b) of ids → (a, b, distance, weight)."""
    x = att.alias("x")
    y = att.alias("y")
    j = pairs.join(x, F.col("a") == F.col("x.id")).join(y, F.col("b") == F.col("y.id"))
    d = distance_expr("x", "y")
    return j.select("a", "b", d.alias("distance"), F.round(1.0 - d, 4).alias("weight"))
