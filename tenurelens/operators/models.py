"""Reading fitted models: coefficient classes and the driver ranking."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# FIXED VALUES — words that mark a compensation driver
PAY_WORDS = ("income", "salary", "rate", "daily", "monthly", "hourly")


def coefficient_classes(coefs: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Significant × direction → risk driver / protective / noise, with the
    hazard multiplier exp(β) and the % change in risk."""
    sig = F.col("p_value") < alpha
    return coefs.select(
        "feature", "coef", F.col("exp_coef").alias("multiplier"),
        ((F.col("exp_coef") - 1.0) * 100.0).alias("risk_change_pct"), "p_value",
        F.when(sig, "Yes").otherwise("No").alias("significant"),
        F.when(F.col("coef") > 0, "Increases risk").otherwise("Decreases risk").alias("direction"),
        F.when(sig & (F.col("coef") > 0), "killer").when(sig, "shield").otherwise("noise").alias("class"))


def driver_ranking(importance: DataFrame) -> DataFrame:
    """(feature, importance) with rank, the compensation-driver decision (any
    pay word among the top 3, and the rank of the first), top 10 and bottom 5."""
    ranked = importance.withColumn("rank", F.rank().over(Window.orderBy(F.col("importance").desc(), "feature")))  # p rows
    pay = F.lit(False)
    for word in PAY_WORDS:
        pay = pay | F.lower("feature").contains(word)
    ranked = ranked.withColumn("is_compensation", pay)
    all_ = ranked.agg(F.bool_or(F.col("is_compensation") & (F.col("rank") <= 3)).alias("pay_in_top3"),
                      F.min(F.when(F.col("is_compensation"), F.col("rank"))).alias("first_pay_rank"), F.count(F.lit(1)).alias("n"))
    return (ranked.join(F.broadcast(all_)).select(*ranked.columns, "pay_in_top3", "first_pay_rank",
                                                  (F.col("rank") <= 10).alias("top10"), (F.col("rank") > F.col("n") - 5).alias("bottom5")))
