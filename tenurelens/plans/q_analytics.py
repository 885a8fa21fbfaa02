"""Analytics keys: concordance, percentiles, cohort curves, monthly rates,
rate compounding, step sample, inter-exit gaps, permutation test."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.cohort import AS_OF_DATE
from ..operators.concordance import concordance
from ..operators.quantiles import global_quantiles, grouped_quantiles
from ..operators.rates import compound_projection, exit_gaps, monthly_rates, shuffle_test
from ..operators.survival import mean_curves, nelson_aalen, score
from ..session import cut_lineage
from .common import cohort_df, materialized_cohort, scored_df, scores_df
from .q_features import split_df
from .registry import query, r
from .sqlparts import CTES, with_ctes

# ---------------------------------------------------------------------------
# concordance
# ---------------------------------------------------------------------------
CTES["sc"] = "SELECT emp_key, CAST(years_at_company AS DOUBLE) AS t, attrition AS e, margin AS s FROM scored"
_CONC = """
  SELECT round(sum(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0.0 END) / count(*), 9) AS c_index,
         count(*) AS comparable_pairs, count(*) FILTER (WHERE a.s > b.s) AS concordant_pairs,
         count(*) FILTER (WHERE a.s = b.s) AS tied_pairs
  FROM {src} a JOIN {src} b ON a.e = 1 AND (a.t < b.t OR (a.t = b.t AND b.e = 0))"""


@query("concordance_index", with_ctes(_CONC.format(src="sc")))
def q_concordance_index(spark, d):
    c = concordance(scored_df(spark, d), "years_at_company", "attrition", "margin")
    return c.select(r("c_index").alias("c_index"), "comparable_pairs", "concordant_pairs", "tied_pairs")


CTES["sc_split"] = "SELECT sc.*, s.split FROM sc JOIN split s USING (emp_key)"
CTES["sc_train"] = "SELECT * FROM sc_split WHERE split = 'train'"
CTES["sc_test"] = "SELECT * FROM sc_split WHERE split = 'test'"


@query("concordance_gap", with_ctes(f"""
SELECT round(tr.c_index, 9) AS c_train, round(te.c_index, 9) AS c_test,
       round(abs(tr.c_index - te.c_index), 9) AS gap, abs(tr.c_index - te.c_index) > 0.05 AS overfit_flag
FROM ({_CONC.format(src="sc_train")}) tr, ({_CONC.format(src="sc_test")}) te"""))
def q_concordance_gap(spark, d):
    """Train / test concordance and their gap, of either sign (> 0.05 flagged)."""
    s = cut_lineage(score(split_df(spark, d)).select("split", "years_at_company", "attrition", "margin"))
    tr = concordance(s.where("split = 'train'"), "years_at_company", "attrition", "margin")
    te = concordance(s.where("split = 'test'"), "years_at_company", "attrition", "margin")
    ct, cs = tr.select("c_index").scalar(), te.select("c_index").scalar()
    out = spark.range(1).select(ct.alias("c_train"), cs.alias("c_test"))
    return concordance_gap(out).select(r("c_train").alias("c_train"), r("c_test").alias("c_test"), r("gap").alias("gap"),
                                       "overfit_flag")


def concordance_gap(df):
    """``df``: c_train, c_test.  Adds the absolute gap and its flag."""
    gap = F.abs(F.col("c_train") - F.col("c_test"))
    return df.withColumns({"gap": gap, "overfit_flag": gap > 0.05})


# ---------------------------------------------------------------------------
# percentiles
# ---------------------------------------------------------------------------
@query("percentile_summary", with_ctes("""
SELECT 'all' AS scope, round(avg(prob_12m), 9) AS mean, round(quantile_cont(prob_12m, 0.1), 9) AS p10,
       round(quantile_cont(prob_12m, 0.5), 9) AS p50, round(quantile_cont(prob_12m, 0.9), 9) AS p90,
       round(min(prob_12m), 9) AS min, round(max(prob_12m), 9) AS max FROM scores"""))
def q_percentile_summary(spark, d):
    s = cut_lineage(scores_df(spark, d).select("prob_12m"))
    (p10, p50, p90), x = global_quantiles(s, "prob_12m", [0.1, 0.5, 0.9])
    row = spark.createDataFrame([("all", x["mean"], p10, p50, p90, x["min"], x["max"])],
                                "scope string, mean double, p10 double, p50 double, p90 double, min double, max double")
    return row.select("scope", *[r(c).alias(c) for c in ("mean", "p10", "p50", "p90", "min", "max")])


@query("percentile_bands", with_ctes("""
SELECT department, round(quantile_cont(prob_12m, 0.1), 9) AS p10, round(quantile_cont(prob_12m, 0.5), 9) AS p50,
       round(quantile_cont(prob_12m, 0.9), 9) AS p90 FROM scores GROUP BY department"""))
def q_percentile_bands(spark, d):
    q = grouped_quantiles(scores_df(spark, d), ["department"], "prob_12m", [0.1, 0.5, 0.9])
    return q.select("department", *[r(c).alias(c) for c in ("p10", "p50", "p90")])


@query("cohort_curves", with_ctes("""
SELECT grp, c.t, round(avg(pow(c.s0, exp(least(greatest(s.margin, -20), 20)))), 9) AS mean_survival
FROM (SELECT *, CASE WHEN margin >= (SELECT quantile_cont(margin, 0.5) FROM scored) THEN 'high' ELSE 'low' END AS grp
      FROM scored) s, curve c
GROUP BY grp, c.t"""))
def q_cohort_curves(spark, d):
    """Mean individual survival curve of the entities above / below the
    median risk multiplier."""
    c = materialized_cohort(spark, d)
    sc = score(c)
    (med,), _ = global_quantiles(sc, "margin", [0.5])
    sc = sc.withColumn("grp", F.when(F.col("margin") >= F.lit(med), "high").otherwise("low"))
    return mean_curves(sc, nelson_aalen(c), "grp").select("grp", "t", r("mean_survival").alias("mean_survival"))


# ---------------------------------------------------------------------------
# monthly rates and projection
# ---------------------------------------------------------------------------
CTES["rates"] = f"""
  SELECT department, CAST(month AS DATE) AS month, count(*) AS at_risk,
         count(*) FILTER (WHERE x = CAST(month AS DATE)) AS exits,
         count(*) FILTER (WHERE x = CAST(month AS DATE)) / count(*) AS rate
  FROM (SELECT department, x, unnest(generate_series(CAST(f AS TIMESTAMP), CAST(l AS TIMESTAMP), INTERVAL 1 MONTH))
               AS month
        FROM (SELECT department, x,
                     greatest(h, CAST(DATE '{AS_OF_DATE}' - INTERVAL 12 MONTH AS DATE)) AS f,
                     least(coalesce(x, CAST(DATE '{AS_OF_DATE}' - INTERVAL 1 MONTH AS DATE)),
                           CAST(DATE '{AS_OF_DATE}' - INTERVAL 1 MONTH AS DATE)) AS l
              FROM (SELECT department, CAST(date_trunc('month', hire_date) AS DATE) AS h,
                           CAST(date_trunc('month', CAST(date_of_leaving AS DATE)) AS DATE) AS x FROM cohort))
        WHERE f <= l)
  GROUP BY department, month"""


@query("monthly_rates", with_ctes("SELECT department, month, at_risk, exits, round(rate, 9) AS rate FROM rates"))
def q_monthly_rates(spark, d):
    m = monthly_rates(cohort_df(spark, d), AS_OF_DATE)
    return m.select("department", "month", "at_risk", "exits", r("rate").alias("rate"))


@query("compound_projection", with_ctes("""
SELECT department, headcount, CAST(h AS BIGINT) AS projected_headcount FROM (
  SELECT rec.department, st.headcount, rec.h, rec.i, max(rec.i) OVER (PARTITION BY rec.department) AS mi
  FROM rec JOIN (SELECT department, count(*) FILTER (WHERE attrition = 0) AS headcount FROM cohort GROUP BY 1) st
    ON rec.department = st.department)
WHERE i = mi""", {
    "rr": "SELECT department, rate, row_number() OVER (PARTITION BY department ORDER BY month) AS i FROM rates",
    "rec": """SELECT department, 0 AS i, CAST(count(*) FILTER (WHERE attrition = 0) AS DOUBLE) AS h
              FROM cohort GROUP BY department
              UNION ALL
              SELECT rec.department, rec.i + 1, rec.h - round_even(rec.h * rr.rate, 0)
              FROM rec JOIN rr ON rr.department = rec.department AND rr.i = rec.i + 1"""}).replace(
    "WITH ", "WITH RECURSIVE ", 1))
def q_compound_projection(spark, d):
    """Active headcount per department carried through the last 12 observed
    monthly exit rates: h <- h - rint(h * r)."""
    c = cohort_df(spark, d)
    start = c.groupBy("department").agg(F.count_if(F.col("attrition") == 0).alias("headcount"))
    return compound_projection(monthly_rates(c, AS_OF_DATE), start)


@query("step_sample", with_ctes("""
SELECT department, month, round(rate, 9) AS rate FROM (
  SELECT *, row_number() OVER (ORDER BY month, department) - 1 AS pos, count(*) OVER () AS n FROM rates)
WHERE pos % greatest(1, n // 100) = 0 AND pos // greatest(1, n // 100) < 100"""))
def q_step_sample(spark, d):
    """Every floor(n/100)-th row (at most 100) of the monthly rate table in
    (month, department) order.  The table is bounded by departments x 12
    months, so its ordered window runs over a small, fixed-size input."""
    m = monthly_rates(cohort_df(spark, d), AS_OF_DATE)
    w = Window.orderBy("month", "department")
    x = m.withColumn("pos", F.row_number().over(w) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))
    step = F.greatest(F.lit(1), F.floor(F.col("n") / 100))
    x = x.where((F.col("pos") % step == 0) & (F.floor(F.col("pos") / step) < 100))
    return x.select("department", "month", r("rate").alias("rate"))


# ---------------------------------------------------------------------------
# exit clustering
# ---------------------------------------------------------------------------
@query("exit_gap", with_ctes("""
SELECT department, count(*) AS n_exits,
       CASE WHEN count(*) > 1 THEN round(avg(gap), 9) END AS mean_gap_days
FROM (SELECT department, date_diff('day', lag(CAST(date_of_leaving AS DATE)) OVER
              (PARTITION BY department ORDER BY CAST(date_of_leaving AS DATE)), CAST(date_of_leaving AS DATE)) AS gap
      FROM cohort WHERE attrition = 1)
GROUP BY department"""))
def q_exit_gap(spark, d):
    x = exit_gaps(cohort_df(spark, d).where("attrition = 1"), "department", "date_of_leaving")
    return x.select("department", "n_exits", r("mean_gap_days").alias("mean_gap_days"))


_PERMUTED = {
    "pt_ex": """SELECT department AS g, CAST(date_of_leaving AS DATE) AS d, employee_id AS id
                FROM cohort WHERE attrition = 1""",
    "pt_sizes": "SELECT g, n, sum(n) OVER (ORDER BY g) AS hi FROM (SELECT g, count(*) AS n FROM pt_ex GROUP BY g)",
    "pt_dealt": """SELECT p, d, row_number() OVER (PARTITION BY p ORDER BY md5('7|' || p || '|' || id), id) - 1 AS slot
                   FROM pt_ex, (SELECT unnest(range(0, 1000)) AS p)""",
    "pt_stat": """SELECT p, sum(span) / sum(k - 1) AS gap FROM (
                    SELECT p, g, count(*) AS k, date_diff('day', min(d), max(d)) AS span
                    FROM pt_dealt JOIN pt_sizes ON slot >= hi - n AND slot < hi GROUP BY p, g) GROUP BY p""",
    "pt_obs": """SELECT sum(span) / sum(k - 1) AS gap FROM (
                   SELECT g, count(*) AS k, date_diff('day', min(d), max(d)) AS span FROM pt_ex GROUP BY g)""",
}


@query("permutation_test", with_ctes("""
SELECT round(o.gap, 9) AS observed, round(avg(s.gap), 9) AS expected, round(o.gap / avg(s.gap), 9) AS lift,
       count(*) FILTER (WHERE s.gap <= o.gap) / CAST(1000 AS DOUBLE) AS p_value, CAST(1000 AS INTEGER) AS permutations
FROM pt_stat s, pt_obs o GROUP BY o.gap""", _PERMUTED))
def q_permutation_test(spark, d):
    """Exit-clustering permutation test, 1,000 md5 permutations of
    department labels among all exits."""
    ex = cohort_df(spark, d).where("attrition = 1")
    res = shuffle_test(ex, "department", "date_of_leaving", "employee_id", n_perm=1000)
    return res.select(r("observed").alias("observed"), r("expected").alias("expected"), r("lift").alias("lift"),
                      "p_value", "permutations")


# FIXED VALUES — labels of the five spectrum picks
SPECTRUM_LABELS = ("Lowest Flight Risk", "Low-Medium Risk", "Median Flight Risk", "High-Medium Risk",
                   "Highest Flight Risk")


@query("risk_spectrum", with_ctes("""
SELECT pos, label, emp_key, employee_id, round(margin, 9) AS margin FROM (
  SELECT *, row_number() OVER (ORDER BY margin, md5(employee_id)) - 1 AS rn, count(*) OVER () AS n FROM scored) s
JOIN (SELECT * FROM (VALUES (0, 'Lowest Flight Risk'), (1, 'Low-Medium Risk'), (2, 'Median Flight Risk'),
                            (3, 'High-Medium Risk'), (4, 'Highest Flight Risk')) v(pos, label)) l
  ON s.rn = CASE l.pos WHEN 0 THEN 0 WHEN 1 THEN s.n // 4 WHEN 2 THEN s.n // 2 WHEN 3 THEN 3 * s.n // 4
                       ELSE s.n - 1 END"""))
def q_risk_spectrum(spark, d):
    """Entities at positions 0, n/4, n/2, 3n/4, n-1 of the risk order
    (ties by md5 of the id), found by exact distributed rank selection."""
    from ..operators.quantiles import rows_at_ranks
    from .common import materialized_cohort
    s = score(materialized_cohort(spark, d)).withColumn("_h", F.md5("employee_id"))
    n = s.count()
    positions = [0, n // 4, n // 2, 3 * n // 4, n - 1]
    picks = rows_at_ranks(s.select("emp_key", "employee_id", "margin", "_h"), "margin", "_h", positions)
    lab = spark.createDataFrame([(i, p, lbl) for i, (p, lbl) in enumerate(zip(positions, SPECTRUM_LABELS))],
                                "pos int, r long, label string")
    return picks.join(F.broadcast(lab), "r").select(F.col("pos").cast("int").alias("pos"), "label", "emp_key",
                                                     "employee_id", r("margin").alias("margin"))
