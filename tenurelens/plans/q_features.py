"""Feature-engineering, synthetic-attribute and data-quality keys."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.labels import EVENT_ALLOWED, ORDINAL_MAPPINGS
from ..operators.attributes import hash_score, project
from ..operators.features import (event_flag, loo_encode_infer, loo_encode_train, minmax_apply, minmax_fit,
                                  one_hot, ordinal_encode, repair_zero_duration, stratified_split,
                                  target_stats, group_normalise)
from ..operators.quality import dq_report, horizon_monotonic
from ..operators.survival import SCORE_FEATURES, feature_matrix
from ..session import cut_lineage
from .common import cohort_df, scores_df
from .registry import query, r
from .sqlparts import CTES, _case_map, md5_mod_sql, md5_prefix_sql, project_sql, with_ctes

# ---------------------------------------------------------------------------
# shared SQL pieces
# ---------------------------------------------------------------------------
SPLIT_SQL = f"""
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY attrition ORDER BY sh, employee_id)
                      <= sn - ceil(sn * 0.2) THEN 'train' ELSE 'test' END AS split
  FROM (SELECT *, {md5_mod_sql("('42|' || employee_id)", 1 << 30)} AS sh,
               count(*) OVER (PARTITION BY attrition) AS sn FROM cohort)"""
CTES["split"] = SPLIT_SQL
CTES["with_project"] = f"SELECT *, {project_sql('department', 'job_role', 'job_level', 'employee_id')} AS project FROM cohort"


def split_df(spark, d):
    return stratified_split(cohort_df(spark, d), "employee_id", "attrition", 0.2, 42)


def with_project(c):
    return c.withColumn("project", project(F.col("department"), F.col("job_role"), F.col("job_level"),
                                           F.col("employee_id")))


# ---------------------------------------------------------------------------
# scalar maps
# ---------------------------------------------------------------------------
_ORD = {"business_travel": "BusinessTravel", "work_life_balance": "WorkLifeBalance",
        "job_satisfaction": "JobSatisfaction", "job_level": "JobLevel"}


@query("ordinal_encode", with_ctes(
    "SELECT emp_key, " + ", ".join(f"{_case_map(c, ORDINAL_MAPPINGS[a])} AS {c}_rank" for c, a in _ORD.items())
    + " FROM cohort"))
def q_ordinal_encode(spark, d):
    c = cohort_df(spark, d)
    return c.select("emp_key", *[ordinal_encode(F.col(col), a).alias(f"{col}_rank") for col, a in _ORD.items()])


@query("clean_rows", with_ctes("""
SELECT emp_key, event, duration, monthly_income FROM (
  SELECT emp_key,
         CASE WHEN attrition_text IS NULL THEN NULL
              WHEN attrition_text IN ('Yes', '1', '1.0', 'True') THEN 1 ELSE 0 END AS event,
         CASE WHEN raw_months = 0 AND attrition_text IN ('Yes', '1', '1.0', 'True') THEN 0.01
              ELSE CAST(raw_months AS DOUBLE) END AS duration,
         TRY_CAST(income_text AS DOUBLE) AS monthly_income
  FROM (SELECT emp_key, CASE WHEN attrition = 1 THEN 'Yes' ELSE 'No' END AS attrition_text,
               CAST(floor(date_diff('day', hire_date, last_active_date) / 30) AS BIGINT) AS raw_months,
               CASE WHEN emp_key % 97 = 0 THEN 'n/a' ELSE CAST(CAST(floor(monthly_income) AS BIGINT) AS VARCHAR) END
                 AS income_text
        FROM cohort))
WHERE event IS NOT NULL AND duration IS NOT NULL AND monthly_income IS NOT NULL"""))
def q_clean_rows(spark, d):
    """Text event → 0/1, numbers coerced with try_cast (unparseable → NULL),
    zero durations of events repaired, incomplete rows dropped."""
    c = cohort_df(spark, d)
    raw = c.select(
        "emp_key",
        F.when(F.col("attrition") == 1, "Yes").otherwise("No").alias("attrition_text"),
        F.floor(F.datediff("last_active_date", "hire_date") / 30).cast("bigint").alias("raw_months"),
        F.when(F.col("emp_key") % 97 == 0, F.lit("n/a"))
         .otherwise(F.floor("monthly_income").cast("bigint").cast("string")).alias("income_text"))
    ev = event_flag(F.col("attrition_text"))
    out = raw.select("emp_key", ev.alias("event"),
                     repair_zero_duration(F.col("raw_months"), ev).alias("duration"),
                     F.expr("try_cast(income_text AS DOUBLE)").alias("monthly_income"))
    return out.na.drop(subset=["event", "duration", "monthly_income"])


@query("hash_bucket", with_ctes("SELECT emp_key, department, project FROM with_project"))
def q_hash_bucket(spark, d):
    return with_project(cohort_df(spark, d)).select("emp_key", "department", "project")


_SCORE_SQL = (f"CAST(least(greatest(round_even(({_case_map('job_satisfaction', ORDINAL_MAPPINGS['JobSatisfaction'])}"
              f" + {_case_map('business_travel', ORDINAL_MAPPINGS['BusinessTravel'])}"
              f" + {_case_map('work_life_balance', ORDINAL_MAPPINGS['WorkLifeBalance'])}) / 3.0"
              f" + (-0.6 + 1.2 * {md5_prefix_sql('employee_id')} / 4294967296.0), 0), 1.0), 4.0) AS INTEGER)")
CTES["perf"] = f"SELECT emp_key, {_SCORE_SQL} AS performance_score FROM cohort"


def performance_scores(c):
    return c.select("emp_key", hash_score(
        F.col("employee_id"), ordinal_encode(F.col("job_satisfaction"), "JobSatisfaction"),
        ordinal_encode(F.col("business_travel"), "BusinessTravel"),
        ordinal_encode(F.col("work_life_balance"), "WorkLifeBalance")).alias("performance_score"))


@query("hash_score", with_ctes("SELECT emp_key, performance_score FROM perf"))
def q_hash_score(spark, d):
    return performance_scores(cohort_df(spark, d))


# ---------------------------------------------------------------------------
# one-hot
# ---------------------------------------------------------------------------
# level domains of the one-hot columns on the driver's schema
_OH_LEVELS = {
    "gender": ("Female", "Male"),
    "marital_status": ("Divorced", "Married", "Single"),
    "over_time": ("No", "Yes"),
    "department": ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"),
}
_OH_PREFIX = {"gender": "Gender", "marital_status": "MaritalStatus", "over_time": "OverTime",
              "department": "Department"}


@query("one_hot", with_ctes(
    "SELECT emp_key, " + ", ".join(
        f"CAST({c} = '{v}' AS INTEGER) AS \"{_OH_PREFIX[c]}_{v}\"" for c, lv in _OH_LEVELS.items() for v in lv[1:])
    + " FROM cohort"))
def q_one_hot(spark, d):
    c = cohort_df(spark, d)
    enc = one_hot(c, _OH_PREFIX)
    return enc.select("emp_key", *[f"{_OH_PREFIX[k]}_{v}" for k, lv in _OH_LEVELS.items() for v in lv[1:]])


@query("one_hot_aligned", with_ctes(
    "SELECT emp_key, " + ", ".join(
        f"CAST({c} = '{v}' AS INTEGER) AS \"{_OH_PREFIX[c]}_{v}\"" for c, lv in _OH_LEVELS.items() for v in lv[1:])
    + " FROM split WHERE split = 'test'"))
def q_one_hot_aligned(spark, d):
    """Dummies fitted on the train split, applied to the test split (levels
    absent from test still get their all-zero column)."""
    s = split_df(spark, d)
    train, test = s.where("split = 'train'"), s.where("split = 'test'")
    from ..operators.features import one_hot_levels
    levels = {_OH_PREFIX[k]: lv for k, lv in one_hot_levels(train, list(_OH_PREFIX)).items()}
    enc = one_hot(test, _OH_PREFIX, levels)
    return enc.select("emp_key", *[f"{p}_{v}" for p, lv in levels.items() for v in lv[1:]])


# ---------------------------------------------------------------------------
# leave-one-out / target mean
# ---------------------------------------------------------------------------
@query("loo_fit", with_ctes("""
SELECT job_role, CAST(sum(attrition) AS DOUBLE) AS t_sum, count(*) AS t_count,
       round((SELECT avg(attrition) FROM cohort), 9) AS global_mean
FROM cohort GROUP BY job_role"""))
def q_loo_fit(spark, d):
    c = cohort_df(spark, d)
    mu = c.agg(F.avg(F.col("attrition").cast("double"))).scalar()
    return target_stats(c, "job_role", "attrition").withColumn("global_mean", F.round(mu, 9))


_LOO_TRAIN_SQL = """
  CASE WHEN count(*) OVER (PARTITION BY {c}) > 1
       THEN (sum(attrition) OVER (PARTITION BY {c}) - attrition) / (count(*) OVER (PARTITION BY {c}) - 1)
       ELSE (SELECT avg(attrition) FROM cohort) END"""


@query("loo_encode_train", with_ctes(
    "SELECT emp_key, round(" + _LOO_TRAIN_SQL.format(c="job_role") + ", 9) AS job_role_loo, round("
    + _LOO_TRAIN_SQL.format(c="education_field") + ", 9) AS education_field_loo FROM cohort"))
def q_loo_encode_train(spark, d):
    c = cohort_df(spark, d)
    a = loo_encode_train(c, "job_role", "attrition", "job_role_loo")
    a = loo_encode_train(a, "education_field", "attrition", "education_field_loo")
    return a.select("emp_key", r("job_role_loo").alias("job_role_loo"),
                    r("education_field_loo").alias("education_field_loo"))


@query("loo_encode_infer", with_ctes("""
SELECT s.emp_key, round(CASE WHEN st.n > 1 THEN st.s / st.n
                             ELSE (SELECT avg(attrition) FROM split WHERE split = 'train') END, 9) AS education_field_te
FROM split s LEFT JOIN (SELECT education_field, CAST(sum(attrition) AS DOUBLE) AS s, count(*) AS n
                        FROM split WHERE split = 'train' GROUP BY education_field) st
  ON s.education_field = st.education_field
WHERE s.split = 'test'"""))
def q_loo_encode_infer(spark, d):
    s = split_df(spark, d)
    train, test = s.where("split = 'train'"), s.where("split = 'test'")
    e = loo_encode_infer(test, train, "education_field", "attrition", "education_field_te")
    return e.select("emp_key", r("education_field_te").alias("education_field_te"))


# ---------------------------------------------------------------------------
# scaling and normalisation
# ---------------------------------------------------------------------------
@query("minmax_fit", with_ctes(
    "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{k}' AS feature, min(f_{k}) AS min_value, max(f_{k}) AS max_value FROM fm" for k in SCORE_FEATURES)
    + ")"))
def q_minmax_fit(spark, d):
    fm = feature_matrix(cohort_df(spark, d))
    st = minmax_fit(fm, [f"f_{k}" for k in SCORE_FEATURES])
    stack = ", ".join(f"'{k}', `f_{k}__min`, `f_{k}__max`" for k in SCORE_FEATURES)
    return st.selectExpr(f"stack({len(SCORE_FEATURES)}, {stack}) AS (feature, min_value, max_value)")


_MM_TRAIN = ("SELECT " + ", ".join(f"min(f_{k}) AS {k}__lo, max(f_{k}) AS {k}__hi" for k in SCORE_FEATURES)
             + " FROM fm JOIN split USING (emp_key) WHERE split = 'train'")


@query("minmax_scale", with_ctes(
    "SELECT emp_key, " + ", ".join(
        f"round(CASE WHEN {k}__hi - {k}__lo > 0 THEN (f_{k} - {k}__lo) / ({k}__hi - {k}__lo) ELSE 0.0 END, 9) AS {k}"
        for k in SCORE_FEATURES) + " FROM fm, (" + _MM_TRAIN + ")"))
def q_minmax_scale(spark, d):
    """Fit on the train split, apply to every row (test values may leave [0, 1])."""
    s = split_df(spark, d)
    cols = [f"f_{k}" for k in SCORE_FEATURES]
    stats = minmax_fit(feature_matrix(s.where("split = 'train'")), cols)
    out = minmax_apply(feature_matrix(cohort_df(spark, d)), stats, cols)
    return out.select("emp_key", *[r(f"f_{k}").alias(k) for k in SCORE_FEATURES])


@query("dept_normalise", with_ctes("""
SELECT emp_key, department,
  round(CASE WHEN max(age) OVER w = min(age) OVER w THEN 0.5
             ELSE (age - min(age) OVER w) / (max(age) OVER w - min(age) OVER w) END, 9) AS age_norm,
  round(CASE WHEN max(r) OVER w = min(r) OVER w THEN 0.5
             ELSE (r - min(r) OVER w) / (max(r) OVER w - min(r) OVER w) END, 9) AS risk_norm
FROM (SELECT *, coalesce(general_risk_score, 0.0) AS r FROM scores)
WINDOW w AS (PARTITION BY department)"""))
def q_dept_normalise(spark, d):
    s = scores_df(spark, d).withColumn("_r", F.coalesce("general_risk_score", F.lit(0.0)))
    s = group_normalise(s, "age", "department", "age_norm")
    s = group_normalise(s, "_r", "department", "risk_norm")
    return s.select("emp_key", "department", r("age_norm").alias("age_norm"), r("risk_norm").alias("risk_norm"))


# ---------------------------------------------------------------------------
# split
# ---------------------------------------------------------------------------
@query("stratified_split", with_ctes("SELECT emp_key, attrition, split FROM split"))
def q_stratified_split(spark, d):
    return split_df(spark, d).select("emp_key", "attrition", "split")


CTES["validation"] = f"""
  SELECT *, CASE WHEN row_number() OVER (ORDER BY sh, employee_id) <= sn - ceil(sn * 0.15) THEN 'fit' ELSE 'validation' END AS part
  FROM (SELECT * EXCLUDE (sh, sn), {md5_mod_sql("('43|' || employee_id)", 1 << 30)} AS sh, count(*) OVER () AS sn
        FROM split WHERE split = 'train')"""


@query("validation_split", with_ctes("SELECT emp_key, attrition, part FROM validation"))
def q_validation_split(spark, d):
    """The train rows of the stratified split, split again 85/15 for early
    stopping, without strata."""
    train = cut_lineage(split_df(spark, d).where("split = 'train'").select("emp_key", "employee_id", "attrition", F.lit(0).alias("_all")))
    parts = stratified_split(train, "employee_id", "_all", 0.15, 43, out="part")
    return parts.select("emp_key", "attrition", F.when(F.col("part") == "train", "fit").otherwise("validation").alias("part"))


@query("stratified_counts", with_ctes("""
SELECT split, attrition AS event, count(*) AS n,
       round(count(*) / sum(count(*)) OVER (PARTITION BY split), 9) AS share
FROM split GROUP BY split, attrition"""))
def q_stratified_counts(spark, d):
    s = split_df(spark, d).groupBy("split", F.col("attrition").alias("event")).agg(F.count(F.lit(1)).alias("n"))
    tot = s.groupBy("split").agg(F.sum("n").alias("_tot"))
    return s.join(tot, "split").select("split", "event", "n", r(F.col("n") / F.col("_tot")).alias("share"))


@query("knn_k", with_ctes("""
SELECT department, count(*) AS n, CAST(greatest(3, least(20, ceil(count(*) * 0.1))) AS BIGINT) AS k
FROM cohort GROUP BY department"""))
def q_knn_k(spark, d):
    c = cohort_df(spark, d).groupBy("department").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("k", F.greatest(F.lit(3), F.least(F.lit(20), F.ceil(F.col("n") * 0.1))).cast("bigint"))


# ---------------------------------------------------------------------------
# data quality
# ---------------------------------------------------------------------------
_ABSENT = ("stock_option_level",)  # required, but the cohort has no such column
_REQ = ("employee_id", "department", "job_role", "years_at_company", "attrition", "monthly_income")
_DOMAINS = {"job_satisfaction": ("1", "2", "3", "4", "Low", "Medium", "High", "Very High"),
            "attrition": EVENT_ALLOWED}


def _in(vals):
    return "(" + ", ".join(f"'{v}'" for v in vals) + ")"


@query("dq_report", with_ctes(
    "SELECT * FROM (SELECT 'row_count' AS rule, count(*) AS violations FROM cohort"
    " UNION ALL SELECT 'empty_table', CAST(count(*) = 0 AS BIGINT) FROM cohort"
    + "".join(f" UNION ALL SELECT 'missing:{c}', CAST({int(c in _ABSENT)} AS BIGINT)" for c in (*_REQ, *_ABSENT))
    + "".join(f" UNION ALL SELECT 'null:{c}', count(*) FILTER (WHERE {c} IS NULL) FROM cohort" for c in _REQ)
    + " UNION ALL SELECT 'order:years_at_company<=total_working_years', "
      "count(*) FILTER (WHERE years_at_company > total_working_years) FROM cohort"
    + "".join(f" UNION ALL SELECT 'domain:{c}', count(*) FILTER (WHERE {c} IS NOT NULL AND "
              f"CAST({c} AS VARCHAR) NOT IN {_in(v)}) FROM cohort" for c, v in _DOMAINS.items())
    + ")"))
def q_dq_report(spark, d):
    """All rules over the cohort, which lacks one required column."""
    return dq_report(cohort_df(spark, d), [*_REQ, *_ABSENT], [("years_at_company", "total_working_years")], _DOMAINS)


@query("horizon_monotonic", with_ctes("""
SELECT count(*) AS rows,
       count(*) FILTER (WHERE prob_3m < prob_1m - 0.01 OR prob_6m < prob_3m - 0.01 OR prob_12m < prob_6m - 0.01)
         AS non_monotonic,
       count(*) FILTER (WHERE least(prob_1m, prob_3m, prob_6m, prob_12m) < 0
                           OR greatest(prob_1m, prob_3m, prob_6m, prob_12m) > 1) AS out_of_bounds,
       coalesce(bool_and(NOT (prob_3m < prob_1m - 0.01 OR prob_6m < prob_3m - 0.01 OR prob_12m < prob_6m - 0.01)
                         AND least(prob_1m, prob_3m, prob_6m, prob_12m) >= 0
                         AND greatest(prob_1m, prob_3m, prob_6m, prob_12m) <= 1), true) AS all_ok
FROM scores"""))
def q_horizon_monotonic(spark, d):
    return horizon_monotonic(scores_df(spark, d))
