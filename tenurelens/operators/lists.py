"""List serving as DataFrame operators: filters, whitelisted sort, paging,
presentation columns, counts.

Paging is ``orderBy(...).offset(...).limit(...)``: Spark plans it as a
distributed top-(offset+limit) (TakeOrderedAndProject), so a page never
sorts the whole list in one task.  Presentation rounding is half-even on
the value scaled to an integer, so every engine renders the same text.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import BOOSTED_HIGH_RISK, HIGH_PERFORMANCE, LOW_PERFORMANCE, PERFORMANCE_SCORE_LABELS, RISK_BANDS

# FIXED VALUES — sortable list columns (request name → column)
SORTABLE = {
    "General_Risk_Score": "boosted_risk_score",
    "MonthlyIncome": "monthly_income",
    "YearsAtCompany": "years_at_company",
    "Prob_Leave_1M": "prob_1m",
    "Prob_Leave_12M": "prob_12m",
    "Age": "age",
    "EmployeeId": "employee_id",
}


def round_half_even(col: Column, digits: int) -> Column:
    scale = 10 ** digits
    return F.bround(col * float(scale), 0) / float(scale)


def pct_text(p: Column) -> Column:
    """'12.3%' for p = 0.1234 (one decimal, half-even on p*1000)."""
    t = F.bround(p * 1000.0, 0).cast("bigint")
    return F.concat((t / 10).cast("bigint").cast("string"), F.lit("."), (t % 10).cast("string"), F.lit("%"))


def performance_tier(score: Column) -> Column:
    return F.when(score.isin(*HIGH_PERFORMANCE), "High").when(score.isNull(), None).otherwise("Low")


def performance_label(score: Column) -> Column:
    m = F.create_map(*[x for k, v in PERFORMANCE_SCORE_LABELS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(m, F.coalesce(score, F.lit(3))), F.lit("Unknown"))


def filter_list(df: DataFrame, search: str = "", department: str = "", status: str = "all",
                performance: str = "all") -> DataFrame:
    if search:
        df = df.where(F.col("employee_id").rlike("(?i)" + search))
    if department:
        df = df.where(F.col("department") == department)
    high = F.coalesce(F.col("boosted_risk_score") >= BOOSTED_HIGH_RISK, F.lit(False))
    if status == "high":
        df = df.where(high)
    elif status == "normal":
        df = df.where(~high)
    if performance == "high":
        df = df.where(F.col("performance_score").isin(*HIGH_PERFORMANCE))
    elif performance == "low":
        df = df.where(F.col("performance_score").isin(*LOW_PERFORMANCE))
    return df


def employee_list(df: DataFrame, **filters) -> DataFrame:
    themes = ("identity", "environment", "compensation", "sentiment", "tenure")
    f = filter_list(df, **filters)
    return f.select(
        "emp_key", "employee_id", "age", "gender", "department", "job_role", "job_level", "monthly_income",
        "over_time", "years_at_company",
        F.coalesce("performance_score", F.lit(3)).alias("performance_score"),
        performance_label(F.col("performance_score")).alias("performance_label"),
        *[pct_text(F.col(f"prob_{h}m")).alias(f"prob_{h}m_text") for h in (1, 3, 6, 12)],
        round_half_even(F.col("boosted_risk_score"), 1).alias("general_risk_score"),
        round_half_even(F.col("general_risk_score"), 1).alias("unboosted_risk_score"),
        round_half_even(F.col("exposure"), 2).alias("exposure_score"),
        (F.greatest("prob_1m", "prob_3m", "prob_6m", "prob_12m") >= 0.30).alias("is_high_risk"),
        *[round_half_even(F.col(f"contrib_{t}"), 1).alias(f"contrib_{t}") for t in themes])


def list_counts(df: DataFrame) -> DataFrame:
    high = F.col("boosted_risk_score") >= BOOSTED_HIGH_RISK
    return df.agg(F.count(F.lit(1)).alias("total_active"), F.count_if(high).alias("high_risk_count"),
                  F.count_if(high & F.col("performance_score").isin(*HIGH_PERFORMANCE)).alias("total_filtered"))


def risk_distribution(df: DataFrame, col: str = "boosted_risk_score") -> DataFrame:
    c = F.col(col)
    (n1, t1), (n2, t2), (n3, t3) = RISK_BANDS
    return df.agg(F.count_if(c >= t1).alias(n1), F.count_if((c >= t2) & (c < t1)).alias(n2),
                  F.count_if((c >= t3) & (c < t2)).alias(n3), F.count_if(c < t3).alias("low"))


def sorted_list(df: DataFrame, sort_by: str = "General_Risk_Score", sort_dir: str = "desc") -> DataFrame:
    """Whitelisted sort, NULLs last, id as tie-break; unknown columns fall
    back to the boosted score, descending."""
    col = SORTABLE.get(sort_by)
    if col is None:
        col, sort_dir = "boosted_risk_score", "desc"
    key = F.col(col).asc_nulls_last() if sort_dir == "asc" else F.col(col).desc_nulls_last()
    return df.orderBy(key, F.col("employee_id").asc())


def page(sorted_df: DataFrame, page_no: int, limit: int) -> DataFrame:
    return sorted_df.offset((page_no - 1) * limit).limit(limit)


def exited_peers(nodes: DataFrame, n: int | None = None) -> DataFrame:
    """Exited rows whose exit date parses, newest first (unparseable dates
    are skipped, not errors); ``n`` keeps the first page only."""
    ok = F.try_to_timestamp(F.col("exit_date"), F.lit("yyyy-MM-dd")).isNotNull()
    x = nodes.where(~F.col("is_active") & (F.col("exit_date") != "") & ok)
    x = x.orderBy(F.col("exit_date").desc(), "id").select("id", "job_role", "exit_date")
    return x if n is None else x.limit(n)
