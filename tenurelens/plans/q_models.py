"""Model keys: sums and derivatives of the fits, the feature matrix, bulk
what-if and historical rescoring (SQL-checked); the stored fits, their classes,
ranking and scores."""
from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.labels import ORDINAL_MAPPINGS
from ..operators import boosting, cox, encoding, model_store, models
from ..operators.cohort import versions_cohort
from ..operators.survival import FIXED_COEFFICIENTS, SCORE_FEATURES, horizon_probabilities, nelson_aalen, scaled_features, score
from ..operators.time_ranges import by_time
from ..operators.whatif import apply_overrides, whatif, with_pay_cut
from ..sources.sinks import output_dir
from ..sources.tables import scan
from . import q_features  # noqa: F401  (its SQL parts)
from .common import cohort_df, materialized_cohort
from .q_warehouse import built_history
from .registry import query, r
from .sqlparts import CTES, _case_map, scored_over, with_ctes

# ---------------------------------------------------------------------------
# sums of the fits, at given coefficients and margins
# ---------------------------------------------------------------------------
_FEATS = [f"f_{c}" for c in SCORE_FEATURES]
_BETA = [FIXED_COEFFICIENTS[c] for c in SCORE_FEATURES]
_P = range(len(_FEATS))
_UPPER = [(j, k) for j in _P for k in _P if j <= k]


def _cox_sums_sql() -> str:
    f = _FEATS
    eta = " + ".join(f"{c} * CAST({b!r} AS DOUBLE)" for c, b in zip(f, _BETA, strict=True))
    moments = {"0": "1", **{f"1_{j}": f[j] for j in _P}, **{f"2_{j}_{k}": f"{f[j]} * {f[k]}" for j, k in _UPPER}}
    rows = f"SELECT CAST(years_at_company AS DOUBLE) AS t, attrition AS e, {', '.join(f)}, {eta} AS eta, exp({eta}) AS w FROM scaled"
    per = ("SELECT t, CAST(sum(e) AS BIGINT) AS d, sum(e * eta) AS eeta, " + ", ".join(f"sum(e * {f[j]}) AS x_{j}" for j in _P) + ", "
           + ", ".join(f"sum(w * {v}) AS w{m}, sum(e * w * {v}) AS d{m}" for m, v in moments.items()) + " FROM cs_rows GROUP BY t")
    at_risk = ("SELECT * REPLACE (" + ", ".join(f"sum(w{m}) OVER later AS w{m}" for m in moments)
               + ") FROM cs_per WINDOW later AS (ORDER BY t DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
    ties = "SELECT *, l / CAST(d AS DOUBLE) AS f FROM (SELECT *, unnest(range(0, d)) AS l FROM cs_risk WHERE d > 0)"
    phi = "(w0 - f * d0)"
    one = lambda j: f"(w1_{j} - f * d1_{j})"
    sums = ["SELECT 'll' AS term, (SELECT sum(eeta) FROM cs_per) - sum(ln" + phi + ") AS value FROM cs_ties"]
    sums += [f"SELECT 'g_{SCORE_FEATURES[j]}', (SELECT sum(x_{j}) FROM cs_per) - sum({one(j)} / {phi}) FROM cs_ties" for j in _P]
    sums += [f"SELECT 'h_{SCORE_FEATURES[j]}_{SCORE_FEATURES[k]}', -sum((w2_{j}_{k} - f * d2_{j}_{k}) / {phi} - {one(j)} * {one(k)} / ({phi} * {phi}))"
             " FROM cs_ties" for j, k in _UPPER]
    CTES.update({"cs_rows": rows, "cs_per": per, "cs_risk": at_risk, "cs_ties": ties})
    return "SELECT term, round(value, 6) AS value FROM (" + " UNION ALL ".join(sums) + ")"


@query("cox_sums", with_ctes(_cox_sums_sql()))
def q_cox_sums(spark, d):
    """Log partial likelihood (Efron), gradient and Hessian of the Cox model at
    the fixed coefficients: what each Newton step of the fit computes."""
    scaled = scaled_features(materialized_cohort(spark, d))
    ll, grad, hess = cox.likelihood(by_time(scaled, "years_at_company", "attrition", _FEATS), np.array(_BETA))
    rows = [("ll", ll), *((f"g_{SCORE_FEATURES[j]}", float(grad[j])) for j in _P),
            *((f"h_{SCORE_FEATURES[j]}_{SCORE_FEATURES[k]}", float(hess[j, k])) for j, k in _UPPER)]
    return spark.createDataFrame(rows, "term string, value double").select("term", r("value", 6).alias("value"))


CTES["bg_rows"] = "SELECT emp_key, CAST(years_at_company AS DOUBLE) AS t, attrition AS e, exp(margin) AS w FROM scored"
CTES["bg_times"] = """
  SELECT t, d, sum(d / s0) OVER up AS a, sum(d / (s0 * s0)) OVER up AS b
  FROM (SELECT t, d, sum(w) OVER (ORDER BY t DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s0
        FROM (SELECT t, sum(e) AS d, sum(w) AS w FROM bg_rows GROUP BY t))
  WINDOW up AS (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


@query("boost_gradients", with_ctes("""
SELECT emp_key, round(w * a - e, 9) AS gradient, round(greatest(w * a - w * w * b, 1e-16), 9) AS hessian
FROM bg_rows JOIN bg_times USING (t)"""))
def q_boost_gradients(spark, d):
    """First and second derivative of the boosting loss by row, at the margins
    of the fixed model: what a round of the boosted fit starts from."""
    scored = score(materialized_cohort(spark, d))
    found = boosting.gradients_at(scored, "years_at_company", "attrition", "emp_key", "margin")
    return found.select(F.col("id").alias("emp_key"), r("gradient").alias("gradient"), r("hessian").alias("hessian"))


# ---------------------------------------------------------------------------
# the full feature matrix
# ---------------------------------------------------------------------------
_RAW = {**{c: f"CAST({c} AS DOUBLE)" for c in encoding.NUMERIC}, "years_with_curr_manager": "CAST(years_at_company % 12 AS DOUBLE)",
        **{c: f"CAST({_case_map(c, ORDINAL_MAPPINGS[a])} AS DOUBLE)" for c, a in encoding.ORDINAL.items()}}
_TE = "CASE WHEN n_{c} > 1 THEN {v} ELSE (SELECT avg(attrition) FROM cohort) END"
CTES["fx_rows"] = ("SELECT *, " + ", ".join(f"CAST(sum(attrition) OVER (PARTITION BY {c}) AS DOUBLE) AS s_{c}, count(*) OVER (PARTITION BY {c}) AS n_{c}"
                                            for c in encoding.TARGET_ENCODED) + " FROM with_project")
CTES["fx_long"] = (
    " UNION ALL ".join(f"SELECT emp_key, '{c}' AS feature, {v} AS x, {v} AS fitted FROM fx_rows" for c, v in _RAW.items())
    + "".join(f" UNION ALL SELECT emp_key, '{c}', {_TE.format(c=c, v=f's_{c} / n_{c}')}, {_TE.format(c=c, v=f'(s_{c} - attrition) / (n_{c} - 1)')} FROM fx_rows"
              for c in encoding.TARGET_ENCODED)
    + "".join(f""" UNION ALL SELECT emp_key, '{p}_' || v, CAST({c} = v AS DOUBLE), CAST({c} = v AS DOUBLE) FROM fx_rows,
    (SELECT DISTINCT {c} AS v FROM fx_rows) WHERE v > (SELECT min({c}) FROM fx_rows)""" for c, p in encoding.DUMMIES.items()))


@query("feature_matrix", with_ctes("""
SELECT emp_key, feature, round(CASE WHEN hi > lo THEN (x - lo) / (hi - lo) ELSE 0.0 END, 9) AS value
FROM fx_long JOIN (SELECT feature, min(fitted) AS lo, max(fitted) AS hi FROM fx_long GROUP BY feature) USING (feature)"""))
def q_feature_matrix(spark, d):
    """All encoded features of every row (dummies of projects and target-encoded
    categories too), by the inference encoding with the bounds of the training
    encoding; one row per entity and feature."""
    c = materialized_cohort(spark, d)
    enc, _ = encoding.fit(c)
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(x).alias("value"))
                                for f, x in zip(enc.features, model_store._columns(enc.features), strict=True)]))
    return encoding.inference(c, enc).select("emp_key", cells.alias("c")).select("emp_key", "c.feature", r("c.value").alias("value"))


# ---------------------------------------------------------------------------
# fit, store, load, score
# ---------------------------------------------------------------------------
_STORED: dict[tuple[str, str], model_store.Store] = {}


def stored_model(spark, d) -> model_store.Store:
    """The model fitted on the cohort and stored in the shared folder, once per
    application and data folder."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _STORED:
        _STORED[key] = model_store.fit(cohort_df(spark, d))
    return _STORED[key]


@query("cox_fit", None)
def q_cox_fit(spark, d):
    """Coefficients of the stored Cox fit: all features, ridge 0.1, Efron ties."""
    return stored_model(spark, d).table("cox").drop("place")


@query("coef_classes", None)
def q_coef_classes(spark, d):
    return models.coefficient_classes(stored_model(spark, d).table("cox"))


@query("boosted_cox_fit", None)
def q_boosted_cox_fit(spark, d):
    """Loss (negative Breslow partial log-likelihood by row) of the stored
    boosted fit after each round, on training and held-out rows; round 0 is
    the null model."""
    return stored_model(spark, d).table("losses")


@query("driver_ranking", None)
def q_driver_ranking(spark, d):
    """Features of the stored trees by the mean gain of their splits, with the
    compensation-driver decision."""
    return models.driver_ranking(stored_model(spark, d).importance())


@query("model_metadata", with_ctes("""
SELECT count(*) AS dataset_rows, (SELECT count(DISTINCT feature) FROM fx_long) AS features_count,
       'boosted Cox and Cox PH' AS model_type FROM cohort"""))
def q_model_metadata(spark, d):
    return stored_model(spark, d).table("meta").select("dataset_rows", "features_count", "model_type")


@query("model_scores", None)
def q_model_scores(spark, d):
    """Every row scored by the stored model: margin, multiplier, probabilities
    and theme contributions."""
    return model_store.score(cohort_df(spark, d), stored_model(spark, d))


@query("model_reconcile", with_ctes("SELECT count(*) AS n_rows, 0::BIGINT AS n_margin_differs, 0::BIGINT AS n_probability_differs FROM cohort"))
def q_model_reconcile(spark, d):
    """The written score table against a second way of scoring (rows missing
    on a side differ)."""
    store = stored_model(spark, d)
    path = output_dir(spark, f"scores/{uuid.uuid4().hex}")
    model_store.score(cohort_df(spark, d), store).write.parquet(path)
    return model_store.reconcile(spark.read.parquet(path), model_store.rescored(cohort_df(spark, d), store))


@query("model_whatif", None)
def q_model_whatif(spark, d):
    """Overrides of all five fields scored by the stored model, where each of
    them moves a feature; rows without a request keep their values."""
    c, overrides = requested_overrides(spark, d)
    changed = apply_overrides(c, overrides).join(_exposure(c), "emp_key", "left").withColumn("exposure", F.coalesce("exposure", F.lit(0.0)))
    scored = model_store.score(changed, stored_model(spark, d), 1.0 + F.col("exposure"), ("exposure", "old_income", "monthly_income"))
    return with_pay_cut(scored).select("emp_key", *[f"prob_{h}m" for h in (1, 3, 6, 12)], "general_risk_score")


# ---------------------------------------------------------------------------
# what-if (bulk) and historical rescoring
# ---------------------------------------------------------------------------
CTES["overrides"] = """
  SELECT emp_key,
         CASE WHEN emp_key % 10 = 7 THEN monthly_income * CAST(0.65 AS DOUBLE) END AS monthly_income,
         CASE WHEN emp_key % 10 = 8 THEN 'Yes' END AS over_time,
         CASE WHEN emp_key % 10 = 9 THEN 'Senior Level' END AS job_level
  FROM cohort"""
CTES["cohort_w"] = """
  SELECT c.* REPLACE (coalesce(o.monthly_income, c.monthly_income) AS monthly_income,
                      coalesce(o.over_time, c.over_time) AS over_time,
                      coalesce(o.job_level, c.job_level) AS job_level,
                      CAST(CASE coalesce(o.job_level, c.job_level) WHEN 'Entry Level' THEN 1 WHEN 'Junior Level' THEN 2
                           WHEN 'Mid Level' THEN 3 WHEN 'Senior Level' THEN 4 WHEN 'Executive Level' THEN 5 END
                           AS INTEGER) AS job_level_rank),
         c.monthly_income AS old_income
  FROM cohort c JOIN overrides o ON c.emp_key = o.emp_key"""
scored_over("cohort_w", "w")
CTES["whatif_p"] = """
  SELECT s.emp_key, s.old_income, s.monthly_income,
         exp(least(greatest(s.margin, -15), 15)) * (1.0 + coalesce(x.exposure_score, 0.0)) AS m,
         CASE WHEN s.monthly_income < s.old_income
              THEN 1.0 + (s.old_income - s.monthly_income) / s.old_income * 3.0 ELSE 1.0 END AS pen
  FROM scored_w s LEFT JOIN exposure x ON s.employee_id = x.node"""


def _wi(h):
    p = f"(1 - pow((SELECT s0 FROM near WHERE hz = {h}), m))"
    return f"CASE WHEN pen > 1 THEN least({p} * pen, 0.999) ELSE {p} END"


@query("whatif_batch", with_ctes(
    "SELECT emp_key, " + ", ".join(f"round({_wi(h)}, 9) AS prob_{h}m" for h in (1, 3, 6, 12))
    + ", round(CASE WHEN pen > 1 THEN least((1 - pow((SELECT s0 FROM near WHERE hz = 12), m)) * 100.0 * pen, 100.0)"
      " ELSE (1 - pow((SELECT s0 FROM near WHERE hz = 12), m)) * 100.0 END, 9) AS general_risk_score FROM whatif_p"))
def q_whatif_batch(spark, d):
    """Overrides (pay cut 35 %, overtime, promotion to senior level; chosen by
    the key, none for most) over the whole cohort, rescored in one pass with
    graph exposure and the pay-cut penalty."""
    c = materialized_cohort(spark, d)
    k = F.col("emp_key")
    ov = c.select(
        "emp_key",
        F.when(k % 10 == 7, F.col("monthly_income") * F.lit(0.65)).alias("monthly_income"),
        F.when(k % 10 == 8, F.lit("Yes")).alias("over_time"),
        F.when(k % 10 == 9, F.lit("Senior Level")).alias("job_level"))
    w = whatif(c, ov, _exposure(c))
    return w.select("emp_key", *[r(f"prob_{h}m").alias(f"prob_{h}m") for h in (1, 3, 6, 12)],
                    r("general_risk_score").alias("general_risk_score"))


def _exposure(c):
    from ..operators import graph
    from ..operators.cohort import AS_OF_DATE
    n = graph.node_table(c)
    return graph.exposure_scores(graph.exposure_contributions(None, n, AS_OF_DATE)).join(c.select("emp_key", F.col("employee_id").alias("node")), "node").select(
        "emp_key", F.col("exposure_score").alias("exposure"))


# whole cohort: a request for every row but those with emp_key % 6 = 5, each
# with one of the reference's five fields
CTES["overrides_all"] = """
  SELECT emp_key,
         CASE WHEN emp_key % 6 = 0 THEN monthly_income * CAST(0.65 AS DOUBLE) END AS monthly_income,
         CASE WHEN emp_key % 6 = 1 THEN 'Yes' END AS over_time,
         CASE WHEN emp_key % 6 = 2 THEN 0 END AS years_with_curr_manager,
         CASE WHEN emp_key % 6 = 3 THEN 'EUROPE' END AS job_role,
         CASE WHEN emp_key % 6 = 4 THEN 'Senior Level' END AS job_level
  FROM cohort WHERE emp_key % 6 < 5"""
CTES["cohort_wa"] = """
  SELECT c.* REPLACE (coalesce(o.monthly_income, c.monthly_income) AS monthly_income,
                      coalesce(o.over_time, c.over_time) AS over_time,
                      coalesce(o.job_role, c.job_role) AS job_role,
                      coalesce(o.job_level, c.job_level) AS job_level,
                      CAST(CASE coalesce(o.job_level, c.job_level) WHEN 'Entry Level' THEN 1 WHEN 'Junior Level' THEN 2
                           WHEN 'Mid Level' THEN 3 WHEN 'Senior Level' THEN 4 WHEN 'Executive Level' THEN 5 END
                           AS INTEGER) AS job_level_rank),
         coalesce(o.years_with_curr_manager, c.years_at_company % 12) AS years_with_curr_manager,
         c.monthly_income AS old_income
  FROM cohort c LEFT JOIN overrides_all o ON c.emp_key = o.emp_key"""
scored_over("cohort_wa", "wa")
CTES["whatif_pa"] = """
  SELECT s.*, exp(least(greatest(s.margin, -15), 15)) * (1.0 + coalesce(x.exposure_score, 0.0)) AS m,
         CASE WHEN s.monthly_income < s.old_income
              THEN 1.0 + (s.old_income - s.monthly_income) / s.old_income * 3.0 ELSE 1.0 END AS pen
  FROM scored_wa s LEFT JOIN exposure x ON s.employee_id = x.node"""


def requested_overrides(spark, d):
    """The cohort with years with the manager, and a request for every row but
    those with emp_key % 6 = 5, each for one of the five fields."""
    c = materialized_cohort(spark, d).withColumn("years_with_curr_manager", F.col("years_at_company") % 12)
    k = F.col("emp_key")
    return c, c.where(k % 6 < 5).select(
        "emp_key",
        F.when(k % 6 == 0, F.col("monthly_income") * F.lit(0.65)).alias("monthly_income"),
        F.when(k % 6 == 1, F.lit("Yes")).alias("over_time"),
        F.when(k % 6 == 2, F.lit(0).cast("bigint")).alias("years_with_curr_manager"),
        F.when(k % 6 == 3, F.lit("EUROPE")).alias("job_role"),
        F.when(k % 6 == 4, F.lit("Senior Level")).alias("job_level"))


@query("whatif_cohort", with_ctes(
    "SELECT emp_key, over_time, years_with_curr_manager, job_role, job_level, "
    + ", ".join(f"round({_wi(h)}, 9) AS prob_{h}m" for h in (1, 3, 6, 12))
    + ", round(CASE WHEN pen > 1 THEN least((1 - pow((SELECT s0 FROM near WHERE hz = 12), m)) * 100.0 * pen, 100.0)"
      " ELSE (1 - pow((SELECT s0 FROM near WHERE hz = 12), m)) * 100.0 END, 9) AS general_risk_score FROM whatif_pa"))
def q_whatif_cohort(spark, d):
    """Overrides of all five fields over the whole cohort, the field chosen by
    the key; rows without a request keep their values.  Role and years with
    the manager feed no feature of the fixed model, so they are returned."""
    c, overrides = requested_overrides(spark, d)
    return whatif(c, overrides, _exposure(c)).select(
        "emp_key", "over_time", "years_with_curr_manager", "job_role", "job_level",
        *[r(f"prob_{h}m").alias(f"prob_{h}m") for h in (1, 3, 6, 12)],
        r("general_risk_score").alias("general_risk_score"))


CTES["hist_prof"] = CTES["prof"].replace("SELECT o_custkey,", "SELECT o_custkey, valid_from,").replace(
    "FROM orders GROUP BY o_custkey", "FROM orders JOIN hist_built ON o_custkey = emp_key AND o_orderdate < valid_from GROUP BY o_custkey, valid_from")
CTES["cohort_h"] = CTES["cohort"].replace("FROM customer JOIN prof", "FROM customer JOIN hist_prof").replace(
    "SELECT c_custkey AS emp_key,", "SELECT valid_from, c_custkey AS emp_key,")
scored_over("cohort_h", "hist")


@query("risk_history", with_ctes("""
SELECT emp_key, valid_from, age, round(monthly_income, 6) AS monthly_income, over_time, business_travel, work_life_balance,
       round(p12, 9) AS prob_12m, round(p12 - lag(p12) OVER (PARTITION BY emp_key ORDER BY valid_from), 9) AS delta_prob_12m
FROM (SELECT h.*, 1 - pow((SELECT s0 FROM near WHERE hz = 12),
                          exp(least(greatest(margin, -15), 15)) * (1.0 + coalesce(x.exposure_score, 0.0))) AS p12
      FROM scored_hist h LEFT JOIN exposure x ON h.employee_id = x.node)"""))
def q_risk_history(spark, d):
    """Every stored version rescored at once from its own attributes (those of
    the orders before it), with the exposure of its entity and the change from
    the previous version."""
    c = materialized_cohort(spark, d)
    v = versions_cohort(*[scan(spark, d, t) for t in ("customer", "orders", "nation", "region")],
                        built_history(spark, d).select("emp_key", "valid_from"))
    v = v.join(_exposure(c), "emp_key", "left").withColumn("exposure", F.coalesce("exposure", F.lit(0.0)))
    p = horizon_probabilities(score(v, fit=c), nelson_aalen(c), horizons=(12,), extra_multiplier=1.0 + F.col("exposure"))
    w = Window.partitionBy("emp_key").orderBy("valid_from")  # a key has at most one row per snapshot
    p = p.withColumn("delta_prob_12m", F.col("prob_12m") - F.lag("prob_12m").over(w))
    return p.select("emp_key", "valid_from", "age", r("monthly_income", 6).alias("monthly_income"), "over_time", "business_travel",
                    "work_life_balance", r("prob_12m").alias("prob_12m"), r("delta_prob_12m").alias("delta_prob_12m"))
