"""Bulk what-if rescoring: a table of nullable overrides joined to the
entities, rescored with the fitted scaler and baseline, with the pay-cut
penalty rule.  One plan for any number of requests."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import HORIZONS_MONTHS, PAY_CUT_FACTOR
from .features import ordinal_encode
from .survival import horizon_probabilities, nelson_aalen, score

OVERRIDABLE = ("monthly_income", "over_time", "years_with_curr_manager", "years_at_company", "job_role", "job_level")


def pay_cut_multiplier(old_income: Column, new_income: Column) -> Column:
    """1 + 3 * (old - new) / old for a cut, else 1."""
    return F.when(new_income < old_income,
                  1.0 + (old_income - new_income) / old_income * PAY_CUT_FACTOR).otherwise(1.0)


def apply_overrides(cohort: DataFrame, overrides: DataFrame) -> DataFrame:
    """Every entity with its non-NULL overrides applied; one without a request
    keeps its values."""
    o = overrides.select("emp_key", *[F.col(c).alias(f"o_{c}") for c in OVERRIDABLE if c in overrides.columns])
    j = cohort.join(o, "emp_key", "left")
    for c in OVERRIDABLE:
        if f"o_{c}" in j.columns:
            j = j.withColumn(c if c != "monthly_income" else "new_income", F.coalesce(f"o_{c}", c))
    if "new_income" not in j.columns:
        j = j.withColumn("new_income", F.col("monthly_income"))
    j = j.withColumn("job_level_rank", ordinal_encode(F.col("job_level"), "JobLevel").cast("int"))
    return j.withColumnRenamed("monthly_income", "old_income").withColumnRenamed("new_income", "monthly_income")


def whatif(cohort: DataFrame, overrides: DataFrame, exposure: DataFrame | None = None) -> DataFrame:
    """Probabilities after the overrides.  The scaler and the baseline curve
    stay fitted on the unmodified cohort; an exposure table (emp_key,
    exposure) multiplies the risk multiplier by (1 + exposure)."""
    mod = apply_overrides(cohort, overrides)
    if exposure is not None:
        mod = mod.join(exposure, "emp_key", "left").withColumn("exposure", F.coalesce("exposure", F.lit(0.0)))
    else:
        mod = mod.withColumn("exposure", F.lit(0.0))
    scored = score(mod, fit=cohort)
    return with_pay_cut(horizon_probabilities(scored, nelson_aalen(cohort), extra_multiplier=1.0 + F.col("exposure")))


def with_pay_cut(probs: DataFrame) -> DataFrame:
    """Probabilities and score of rows whose income falls, raised by the
    penalty up to 0.999 and 100."""
    pen = pay_cut_multiplier(F.col("old_income"), F.col("monthly_income"))
    cut = lambda c, most: F.when(pen > 1, F.least(F.col(c) * pen, F.lit(most))).otherwise(F.col(c))
    outs = {f"prob_{h}m": cut(f"prob_{h}m", 0.999) for h in HORIZONS_MONTHS}
    outs["general_risk_score"] = cut("general_risk_score", 100.0)
    return probs.withColumns(outs)
