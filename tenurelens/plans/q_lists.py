"""List and dashboard keys: search, filters, whitelisted sort, paging, top-N,
KPIs, department means, distributions, exited peers, reconciliation."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.labels import PERFORMANCE_SCORE_LABELS
from ..operators import score_table
from ..operators.lists import employee_list, exited_peers, list_counts, page, risk_distribution, sorted_list
from ..operators.survival import nelson_aalen, scaled_features
from .common import any_horizon_high, cohort_df, materialized_cohort, risk_scores_df, scores_df
from .q_graph import _nodes, boosted_df
from .q_warehouse import ratings_df
from .registry import query, r
from .sqlparts import CTES, with_ctes

# FIXED VALUES — parameters of the registered list requests
LIST_DEPARTMENT = "BUILDING"
SEARCH_PATTERN = "customer#0000001[0-4]"
PAGE, PAGE_SIZE = 2, 10

CTES["listing"] = """
  SELECT b.*, r.performance_score FROM boosted b LEFT JOIN ratings r ON b.emp_key = r.emp_key"""


def listing_df(spark, d, c=None):
    from .common import materialized_cohort
    c = c if c is not None else materialized_cohort(spark, d)
    b = boosted_df(spark, d, c)
    return b.join(ratings_df(spark, d, c).select("emp_key", "performance_score"), "emp_key", "left")


def _pct_sql(c):
    t = f"CAST(round_even({c} * 1000.0, 0) AS BIGINT)"
    return f"(CAST({t} // 10 AS VARCHAR) || '.' || CAST({t} % 10 AS VARCHAR) || '%')"


def _r_sql(c, n):
    return f"(round_even({c} * {10 ** n}.0, 0) / {10 ** n}.0)"


_LABEL_SQL = "CASE coalesce(performance_score, 3) " + " ".join(
    f"WHEN {k} THEN '{v}'" for k, v in PERFORMANCE_SCORE_LABELS.items()) + " ELSE 'Unknown' END"
_THEMES = ("identity", "environment", "compensation", "sentiment", "tenure")
CTES["contrib_only"] = "SELECT emp_key, " + ", ".join(f"contrib_{t}" for t in _THEMES) + " FROM contribs"
_LIST_SQL = with_ctes(f"""
SELECT l.emp_key, employee_id, age, gender, department, job_role, job_level, monthly_income, over_time,
       years_at_company, coalesce(performance_score, 3) AS performance_score, {_LABEL_SQL} AS performance_label,
       {_pct_sql('prob_1m')} AS prob_1m_text, {_pct_sql('prob_3m')} AS prob_3m_text,
       {_pct_sql('prob_6m')} AS prob_6m_text, {_pct_sql('prob_12m')} AS prob_12m_text,
       {_r_sql('boosted_risk_score', 1)} AS general_risk_score, {_r_sql('general_risk_score', 1)} AS unboosted_risk_score,
       {_r_sql('exposure', 2)} AS exposure_score,
       greatest(prob_1m, prob_3m, prob_6m, prob_12m) >= 0.30 AS is_high_risk,
       {", ".join(f"{_r_sql('c.contrib_' + t, 1)} AS contrib_{t}" for t in _THEMES)}
FROM listing l JOIN contrib_only c ON l.emp_key = c.emp_key
WHERE department = '{LIST_DEPARTMENT}' AND boosted_risk_score >= 50 AND performance_score IN (1, 2)""")


@query("employee_list", _LIST_SQL)
def q_employee_list(spark, d):
    """department filter, status 'high' (boosted >= 50), performance 'high'
    (score 1 or 2), presentation columns (percent text, 1/2-decimal rounds)."""
    from ..operators.survival import theme_contributions
    from .common import materialized_cohort, scores_from
    c = materialized_cohort(spark, d)
    lst = listing_df(spark, d, c)
    contrib = theme_contributions(scores_from(c)).select("emp_key", *[f"contrib_{t}" for t in _THEMES])
    return employee_list(lst.join(contrib, "emp_key"), department=LIST_DEPARTMENT, status="high",
                         performance="high")


@query("employee_search", with_ctes(
    f"SELECT emp_key, employee_id FROM cohort WHERE regexp_matches(employee_id, '(?i){SEARCH_PATTERN}')"))
def q_employee_search(spark, d):
    return cohort_df(spark, d).where(F.col("employee_id").rlike(f"(?i){SEARCH_PATTERN}")).select(
        "emp_key", "employee_id")


@query("list_counts", with_ctes(f"""
SELECT count(*) AS total_active, count(*) FILTER (WHERE boosted_risk_score >= 50) AS high_risk_count,
       count(*) FILTER (WHERE boosted_risk_score >= 50 AND performance_score IN (1, 2)) AS total_filtered
FROM listing WHERE department = '{LIST_DEPARTMENT}'"""))
def q_list_counts(spark, d):
    """Counts taken after search/department, before status/performance."""
    return list_counts(listing_df(spark, d).where(F.col("department") == LIST_DEPARTMENT))


@query("risk_distribution", with_ctes(f"""
SELECT count(*) FILTER (WHERE boosted_risk_score >= 80) AS critical,
       count(*) FILTER (WHERE boosted_risk_score >= 50 AND boosted_risk_score < 80) AS high,
       count(*) FILTER (WHERE boosted_risk_score >= 20 AND boosted_risk_score < 50) AS medium,
       count(*) FILTER (WHERE boosted_risk_score < 20) AS low
FROM boosted"""))
def q_risk_distribution(spark, d):
    return risk_distribution(boosted_df(spark, d))


@query("employee_page", with_ctes(f"""
SELECT emp_key, employee_id, round(boosted_risk_score, 9) AS boosted_risk_score FROM listing
ORDER BY boosted_risk_score DESC NULLS LAST, employee_id LIMIT {PAGE_SIZE} OFFSET {(PAGE - 1) * PAGE_SIZE}"""))
def q_employee_page(spark, d):
    """Page 2 of 10 under the default sort (boosted score, descending)."""
    lst = sorted_list(listing_df(spark, d), "General_Risk_Score", "desc")
    p = page(lst, PAGE, PAGE_SIZE)
    return p.select("emp_key", "employee_id", r("boosted_risk_score").alias("boosted_risk_score"))


@query("employee_page_by_income", with_ctes(f"""
SELECT emp_key, employee_id, monthly_income FROM listing
ORDER BY monthly_income ASC NULLS LAST, employee_id LIMIT {PAGE_SIZE} OFFSET 0"""))
def q_employee_page_by_income(spark, d):
    """Whitelisted sort column with ascending direction."""
    p = page(sorted_list(listing_df(spark, d), "MonthlyIncome", "asc"), 1, PAGE_SIZE)
    return p.select("emp_key", "employee_id", "monthly_income")


@query("top_risk", with_ctes("""
SELECT emp_key, employee_id, department, round(prob_12m, 9) AS prob_12m FROM scores
ORDER BY prob_12m DESC, employee_id LIMIT 20"""))
def q_top_risk(spark, d):
    s = scores_df(spark, d).orderBy(F.col("prob_12m").desc(), "employee_id").limit(20)
    return s.select("emp_key", "employee_id", "department", r("prob_12m").alias("prob_12m"))


@query("high_risk_any_horizon", with_ctes("""
SELECT emp_key, employee_id FROM scores WHERE greatest(prob_1m, prob_3m, prob_6m, prob_12m) >= 0.30"""))
def q_high_risk_any_horizon(spark, d):
    return scores_df(spark, d).where(any_horizon_high()).select("emp_key", "employee_id")


_STORED: dict[tuple[str, str], str] = {}


def stored_scores(spark, d) -> str:
    """Name of the bucketed table of scores and contributions of the fixed
    model, written once per application and data folder."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _STORED:
        _STORED[key] = score_table.write_bucketed(risk_scores_df(spark, d), "employee_id")
    return _STORED[key]


@query("point_lookup", with_ctes("SELECT * FROM risk_scores WHERE employee_id = 'Customer#000000042'"))
def q_point_lookup(spark, d):
    """Key lookup in the stored score table: one bucket is read."""
    found = score_table.lookup(spark, stored_scores(spark, d), "employee_id", "Customer#000000042")
    return found.select("emp_key", "employee_id", "prob_1m", "prob_3m", "prob_6m", "prob_12m", "general_risk_score",
                        "contrib_identity", "contrib_environment", "contrib_compensation", "contrib_sentiment",
                        "contrib_tenure")


@query("dashboard_stats", with_ctes("""
SELECT count(*) AS total_active,
       count(*) FILTER (WHERE greatest(prob_1m, prob_3m, prob_6m, prob_12m) >= 0.30) AS high_risk_count,
       round(avg(general_risk_score), 6) AS avg_risk_score
FROM scores s JOIN cohort c USING (emp_key)"""))
def q_dashboard_stats(spark, d):
    """Inner join features x stored scores, then the three KPIs in one
    aggregate."""
    s = spark.table(stored_scores(spark, d)).select("emp_key", "prob_1m", "prob_3m", "prob_6m", "prob_12m", "general_risk_score")
    j = s.join(cohort_df(spark, d).select("emp_key"), "emp_key")
    return j.agg(F.count(F.lit(1)).alias("total_active"), F.count_if(any_horizon_high()).alias("high_risk_count"),
                 F.round(F.avg("general_risk_score"), 6).alias("avg_risk_score"))


@query("department_risk", with_ctes("""
SELECT department, round(avg(general_risk_score), 6) AS avg_risk_score FROM scores
GROUP BY department ORDER BY avg_risk_score DESC"""))
def q_department_risk(spark, d):
    s = scores_df(spark, d).groupBy("department").agg(F.round(F.avg("general_risk_score"), 6).alias("avg_risk_score"))
    return s.orderBy(F.col("avg_risk_score").desc())


@query("distinct_departments", with_ctes(
    "SELECT DISTINCT department FROM cohort WHERE department IS NOT NULL ORDER BY department"))
def q_distinct_departments(spark, d):
    return cohort_df(spark, d).where(F.col("department").isNotNull()).select("department").distinct() \
        .orderBy("department")


@query("performance_label", with_ctes(f"""
SELECT c.emp_key, r.performance_score,
       CASE WHEN r.performance_score IN (1, 2) THEN 'High' WHEN r.performance_score IS NULL THEN NULL
            ELSE 'Low' END AS performance_tier,
       {_LABEL_SQL.replace('performance_score', 'r.performance_score')} AS performance_label
FROM cohort c LEFT JOIN ratings r ON c.emp_key = r.emp_key"""))
def q_performance_label(spark, d):
    from ..operators.lists import performance_label, performance_tier
    c = cohort_df(spark, d).select("emp_key").join(ratings_df(spark, d).select("emp_key", "performance_score"),
                                                   "emp_key", "left")
    return c.select("emp_key", "performance_score", performance_tier(F.col("performance_score")).alias("performance_tier"),
                    performance_label(F.col("performance_score")).alias("performance_label"))


@query("exited_peers", with_ctes("""
SELECT id, job_role, exit_date FROM nodes
WHERE NOT is_active AND exit_date <> '' AND TRY_CAST(exit_date AS DATE) IS NOT NULL
ORDER BY exit_date DESC, id"""))
def q_exited_peers(spark, d):
    """Every exited row with a parseable exit date, newest first."""
    return exited_peers(_nodes(spark, d))


@query("score_reconcile", with_ctes("SELECT count(*) AS n, 0.0::DOUBLE AS max_abs_diff, 0::BIGINT AS n_diff FROM scores"))
def q_score_reconcile(spark, d):
    """Stored 12-month probabilities against a second way of scoring (terms as
    rows, summed by entity): no id may differ."""
    c = materialized_cohort(spark, d)
    fresh = score_table.probabilities_by_terms(scaled_features(c), nelson_aalen(c), 12)
    found = score_table.reconcile(spark.table(stored_scores(spark, d)).select("emp_key", F.col("prob_12m").alias("prob")), fresh)
    return found.select("n", r("max_abs_diff").alias("max_abs_diff"), "n_diff")


@query("feature_skew", with_ctes("""
SELECT emp_key, feature, round(train_value, 9) AS train_value, round(serve_value, 9) AS serve_value FROM (
  SELECT coalesce(t.emp_key, s.emp_key) AS emp_key, coalesce(t.feature, s.feature) AS feature,
         t.v AS train_value, s.v AS serve_value
  FROM (UNPIVOT (SELECT emp_key, job_role_loo AS job_role_enc FROM (
          SELECT emp_key, CASE WHEN count(*) OVER (PARTITION BY job_role) > 1
                 THEN (sum(attrition) OVER (PARTITION BY job_role) - attrition) / (count(*) OVER (PARTITION BY job_role) - 1)
                 ELSE (SELECT avg(attrition) FROM cohort) END AS job_role_loo FROM cohort))
        ON job_role_enc INTO NAME feature VALUE v) t
  FULL OUTER JOIN
       (UNPIVOT (SELECT c.emp_key, CASE WHEN st.n > 1 THEN st.s / st.n ELSE (SELECT avg(attrition) FROM cohort) END
                        AS job_role_enc
                 FROM cohort c JOIN (SELECT job_role, CAST(sum(attrition) AS DOUBLE) AS s, count(*) AS n
                                     FROM cohort GROUP BY job_role) st ON c.job_role = st.job_role)
        ON job_role_enc INTO NAME feature VALUE v) s
  ON t.emp_key = s.emp_key AND t.feature = s.feature)
WHERE train_value IS NULL OR serve_value IS NULL OR abs(train_value - serve_value) > 1e-5"""))
def q_feature_skew(spark, d):
    """Train (leave-one-out) vs serve (target mean) encodings per (id,
    feature): unpivot both sides, full outer join, keep differences > 1e-5."""
    from ..operators.features import loo_encode_infer, loo_encode_train
    c = cohort_df(spark, d)
    tr = loo_encode_train(c, "job_role", "attrition", "job_role_enc").select("emp_key", "job_role_enc")
    sv = loo_encode_infer(c, c, "job_role", "attrition", "job_role_enc").select("emp_key", "job_role_enc")
    t = tr.unpivot("emp_key", ["job_role_enc"], "feature", "train_value")
    s = sv.unpivot("emp_key", ["job_role_enc"], "feature", "serve_value")
    j = t.join(s, ["emp_key", "feature"], "full_outer")
    j = j.where(F.col("train_value").isNull() | F.col("serve_value").isNull()
                | (F.abs(F.col("train_value") - F.col("serve_value")) > 1e-5))
    return j.select("emp_key", "feature", r("train_value").alias("train_value"), r("serve_value").alias("serve_value"))

