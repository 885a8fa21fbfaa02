"""Survival keys: risk set, Nelson–Aalen, as-of lookups, probabilities,
curves, contributions, department roll-up."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.survival import individual_curves, interp_lookup, nearest_lookup, risk_set
from .common import any_horizon_high, cohort_df, curve_df, risk_scores_df, scored_df, scores_df
from .registry import query, r
from .sqlparts import with_ctes


@query("risk_set", with_ctes("SELECT t, n_at_risk, d FROM risk_set"))
def q_risk_set(spark, d):
    return risk_set(cohort_df(spark, d))


@query("nelson_aalen", with_ctes(
    "SELECT t, n_at_risk, d, round(h, 9) AS h, round(cum_hazard, 9) AS cum_hazard, round(s0, 9) AS s0 FROM curve"))
def q_nelson_aalen(spark, d):
    c = curve_df(spark, d)
    return c.select("t", "n_at_risk", "d", r("h").alias("h"), r("cum_hazard").alias("cum_hazard"),
                    r("s0").alias("s0"))


@query("asof_nearest", with_ctes("SELECT hz AS horizon, t_near, round(s0, 9) AS s0 FROM near"))
def q_asof_nearest(spark, d):
    look = nearest_lookup(curve_df(spark, d))
    stack = ", ".join(f"{float(h)}D, t_h{h}, s0_h{h}" for h in (1, 3, 6, 12))
    return look.selectExpr(f"stack(4, {stack}) AS (horizon, t_near, s0)").select(
        "horizon", "t_near", r("s0").alias("s0"))


_INTERP_SQL = with_ctes("SELECT hz AS horizon, round(s0, 9) AS s0 FROM interp", None)


@query("asof_interp", _INTERP_SQL)
def q_asof_interp(spark, d):
    look = interp_lookup(curve_df(spark, d))
    stack = ", ".join(f"{float(h)}D, s0_h{h}" for h in (1, 3, 6, 12))
    return look.selectExpr(f"stack(4, {stack}) AS (horizon, s0)").select("horizon", r("s0").alias("s0"))


_PROB_COLS = ("prob_1m", "prob_3m", "prob_6m", "prob_12m", "general_risk_score")


def _prob_select(df):
    return df.select("emp_key", "employee_id", *[r(c).alias(c) for c in _PROB_COLS])


@query("horizon_probabilities", with_ctes(
    "SELECT emp_key, employee_id, " + ", ".join(f"round({c}, 9) AS {c}" for c in _PROB_COLS) + " FROM scores"))
def q_horizon_probabilities(spark, d):
    return _prob_select(scores_df(spark, d))




def _interp_prob(h):
    return (f"least(greatest(1 - pow((SELECT s0 FROM interp WHERE hz = {h}), "
            f"exp(least(greatest(margin, -20), 20))), 0.0), 1.0)")


@query("horizon_probabilities_interp", with_ctes(
    "SELECT emp_key, employee_id, " + ", ".join(
        f"round({_interp_prob(h)}, 9) AS prob_{h}m" for h in (1, 3, 6, 12))
    + f", round({_interp_prob(12)} * 100.0, 9) AS general_risk_score FROM scored"))
def q_horizon_probabilities_interp(spark, d):
    return _prob_select(scores_df(spark, d, kind="interp"))


@query("individual_curves", with_ctes(
    "SELECT s.emp_key, s.employee_id, c.t, round(pow(c.s0, exp(least(greatest(s.margin, -20), 20))), 9) AS survival "
    "FROM scored s, curve c"))
def q_individual_curves(spark, d):
    c = cohort_df(spark, d)
    from ..operators.survival import nelson_aalen, score
    cur = individual_curves(score(c), nelson_aalen(c))
    return cur.select("emp_key", "employee_id", "t", r("survival").alias("survival"))


_CONTRIB = ("contrib_identity", "contrib_environment", "contrib_compensation", "contrib_sentiment", "contrib_tenure")


@query("theme_contributions", with_ctes(
    "SELECT emp_key, " + ", ".join(f"round({c}, 6) AS {c}" for c in _CONTRIB) + " FROM contribs"))
def q_theme_contributions(spark, d):
    s = risk_scores_df(spark, d)
    return s.select("emp_key", *[r(c, 6).alias(c) for c in _CONTRIB])


@query("department_rollup", with_ctes("""
SELECT CASE WHEN grouping(department) = 1 THEN 'ALL' ELSE department END AS department,
       count(*) AS headcount,
       round(avg(prob_12m) * 100.0, 6) AS mean_risk_12m_pct,
       CAST(count(*) FILTER (WHERE greatest(prob_1m, prob_3m, prob_6m, prob_12m) >= 0.30) AS BIGINT)
         AS high_risk_count,
       CAST(grouping(department) AS INTEGER) AS is_total
FROM scores GROUP BY ROLLUP (department)"""))
def q_department_rollup(spark, d):
    return department_rollup(scores_df(spark, d))


def department_rollup(scores):
    agg = scores.rollup("department").agg(
        F.count(F.lit(1)).alias("headcount"),
        F.round(F.avg("prob_12m") * 100.0, 6).alias("mean_risk_12m_pct"),
        F.count_if(any_horizon_high()).alias("high_risk_count"),
        F.grouping("department").cast("int").alias("is_total"))
    return agg.select(F.when(F.col("is_total") == 1, F.lit("ALL")).otherwise(F.col("department")).alias("department"),
                      "headcount", "mean_risk_12m_pct", "high_risk_count", "is_total")


@query("survival_target", with_ctes("""
SELECT emp_key, CAST(years_at_company AS DOUBLE) AS duration, attrition AS event,
       CASE WHEN attrition = 1 THEN CAST(years_at_company AS DOUBLE) ELSE -CAST(years_at_company AS DOUBLE) END
         AS signed_y FROM cohort"""))
def q_survival_target(spark, d):
    from ..operators.features import signed_duration
    c = cohort_df(spark, d)
    return c.select("emp_key", F.col("years_at_company").cast("double").alias("duration"),
                    F.col("attrition").alias("event"),
                    signed_duration(F.col("years_at_company"), F.col("attrition")).alias("signed_y"))


@query("risk_multiplier", with_ctes(
    "SELECT emp_key, round(margin, 9) AS margin, "
    "round(least(greatest(exp(margin), 0.0001), 10000.0), 9) AS risk_multiplier FROM scored"))
def q_risk_multiplier(spark, d):
    s = scored_df(spark, d)
    return s.select("emp_key", r("margin").alias("margin"),
                    r(F.least(F.greatest(F.exp("margin"), F.lit(1e-4)), F.lit(1e4))).alias("risk_multiplier"))
