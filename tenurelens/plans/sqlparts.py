"""Shared CTEs of the oracle SQL (DuckDB dialect, ANSI where possible).

Each oracle query is ``WITH <needed CTEs> <final select>``; ``with_ctes``
pulls in the transitive dependencies in definition order.
"""
from __future__ import annotations

import re

from ..functions.labels import ORDINAL_MAPPINGS
from ..operators.cohort import BALANCE_NAMES, LEVEL_NAMES, MARITAL_BY_STATUS, SATISFACTION_NAMES
from ..operators.survival import FEATURE_THEME, FIXED_COEFFICIENTS, FIXED_INTERCEPT


def _case_idx(expr: str, names) -> str:
    return "CASE " + expr + " " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names, 1)) + " END"


def _case_map(expr: str, mapping: dict) -> str:
    return "CASE " + expr + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in mapping.items()) + " END"


def md5_mod_sql(text: str, m: int) -> str:
    """int(md5(text),16) mod m folded over four 32-bit chunks (BIGINT-safe)."""
    base = (1 << 32) % m

    def chunk(i):
        return f"(('0x' || substr(md5({text}), {8 * i + 1}, 8))::BIGINT)"
    acc = f"({chunk(0)} % {m})"
    for i in (1, 2, 3):
        acc = f"(({acc} * {base} + {chunk(i)} % {m}) % {m})"
    return acc


def md5_prefix_sql(text: str) -> str:
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT)"


def project_sql(dept: str, role: str, level: str, emp: str) -> str:
    m = 4000
    g = md5_mod_sql(f"({dept} || '|' || {role} || '|' || {level})", m)
    e = md5_mod_sql(emp, m)
    idx = f"least(CAST(floor((({g}) * 7 + ({e}) * 3) % {m} / 1000) AS BIGINT), 3)"
    return (f"(replace(replace({dept}, ' ', '_'), '&', 'and') || '_Project_' || chr(CAST(65 + {idx} AS INTEGER)))")


_LEVEL = "least(greatest(floor(c_acctbal / 2000) + 1, 1), 5)"
_MONTHS = "CAST(floor(date_diff('day', first_date, last_date) / 30) AS BIGINT)"
_MARITAL = "CASE latest_status " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in MARITAL_BY_STATUS.items()) + " END"

CTES: dict[str, str] = {}

CTES["prof"] = """
  SELECT o_custkey, count(*) AS n_orders, avg(o_totalprice) AS avg_price,
         min(CAST(o_orderdate AS DATE)) AS first_date, max(CAST(o_orderdate AS DATE)) AS last_date,
         avg(CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0 ELSE 0.0 END) AS urgent_share,
         arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS latest_priority,
         arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS latest_status
  FROM orders GROUP BY o_custkey"""

CTES["cohort"] = f"""
  SELECT c_custkey AS emp_key, c_name AS employee_id, c_mktsegment AS department,
         r_name AS job_role, n_name AS education_field,
         CAST({_LEVEL} AS INTEGER) AS job_level_rank,
         {_case_idx(_LEVEL, LEVEL_NAMES)} AS job_level,
         CASE WHEN c_custkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender,
         {_MARITAL} AS marital_status,
         n_orders + 20 AS age,
         avg_price AS monthly_income,
         CASE WHEN urgent_share >= 0.25 THEN 'Yes' ELSE 'No' END AS over_time,
         CASE WHEN n_orders < 8 THEN 'Non-Travel' WHEN n_orders < 12 THEN 'Travel_Rarely'
              ELSE 'Travel_Frequently' END AS business_travel,
         {_case_idx("CAST(substr(latest_priority, 1, 1) AS INTEGER)", BALANCE_NAMES)} AS work_life_balance,
         {_case_idx("(c_custkey % 4 + 1)", SATISFACTION_NAMES)} AS job_satisfaction,
         greatest({_MONTHS}, 1) AS years_at_company,
         greatest({_MONTHS}, 1) + c_custkey % 7 AS total_working_years,
         CASE WHEN last_date < DATE '2000-08-01' THEN 1 ELSE 0 END AS attrition,
         CASE WHEN last_date < DATE '2000-08-01' THEN strftime(last_date, '%Y-%m-%d') END AS date_of_leaving,
         first_date AS hire_date, last_date AS last_active_date
  FROM customer JOIN prof ON c_custkey = o_custkey
       JOIN nation ON c_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey"""

_F = {
    "age": "CAST(age AS DOUBLE)",
    "monthly_income": "monthly_income",
    "job_level": "CAST(job_level_rank AS DOUBLE)",
    "over_time_yes": "CASE WHEN over_time = 'Yes' THEN 1.0 ELSE 0.0 END",
    "business_travel": f"CAST({_case_map('business_travel', ORDINAL_MAPPINGS['BusinessTravel'])} AS DOUBLE)",
    "work_life_balance": f"CAST({_case_map('work_life_balance', ORDINAL_MAPPINGS['WorkLifeBalance'])} AS DOUBLE)",
    "job_satisfaction": f"CAST({_case_map('job_satisfaction', ORDINAL_MAPPINGS['JobSatisfaction'])} AS DOUBLE)",
}
CTES["fm"] = "SELECT *, " + ", ".join(f"CAST({e} AS DOUBLE) AS f_{k}" for k, e in _F.items()) + " FROM cohort"
CTES["mm"] = "SELECT " + ", ".join(f"min(f_{k}) AS {k}__min, max(f_{k}) AS {k}__max" for k in _F) + " FROM fm"
CTES["scaled"] = ("SELECT fm.* REPLACE (" + ", ".join(
    f"CASE WHEN {k}__max - {k}__min > 0 THEN (f_{k} - {k}__min) / ({k}__max - {k}__min) ELSE 0.0 END AS f_{k}"
    for k in _F) + ") FROM fm, mm")
_MARGIN = f"CAST({FIXED_INTERCEPT!r} AS DOUBLE)" + "".join(f" + f_{k} * CAST({b!r} AS DOUBLE)" for k, b in FIXED_COEFFICIENTS.items())
CTES["scored"] = f"SELECT *, ({_MARGIN}) AS margin FROM scaled"



def scored_over(src: str, suffix: str) -> None:
    """Register fm_/scaled_/scored_<suffix> CTEs: the fixed model applied to
    ``src`` with the scaler fitted on the cohort (``mm``)."""
    CTES[f"fm_{suffix}"] = ("SELECT *, " + ", ".join(f"CAST({e} AS DOUBLE) AS f_{k}" for k, e in _F.items())
                            + f" FROM {src}")
    CTES[f"scaled_{suffix}"] = (f"SELECT fm_{suffix}.* REPLACE (" + ", ".join(
        f"CASE WHEN {k}__max - {k}__min > 0 THEN (f_{k} - {k}__min) / ({k}__max - {k}__min) ELSE 0.0 END AS f_{k}"
        for k in _F) + f") FROM fm_{suffix}, mm")
    CTES[f"scored_{suffix}"] = f"SELECT *, ({_MARGIN}) AS margin FROM scaled_{suffix}"


CTES["per_t"] = """
  SELECT t, sum(n_t) AS n_t, sum(d) AS d FROM (
    SELECT CAST(years_at_company AS DOUBLE) AS t, count(*) AS n_t, CAST(sum(attrition) AS BIGINT) AS d
    FROM cohort GROUP BY 1
    UNION ALL SELECT 0.0, 0, 0) GROUP BY t"""
CTES["risk_set"] = """
  SELECT t, CAST(sum(n_t) OVER (ORDER BY t DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT)
         AS n_at_risk, CAST(d AS BIGINT) AS d FROM per_t"""
CTES["na_steps"] = """
  SELECT t, n_at_risk, d,
         CASE WHEN d <= 0 THEN 0.0
              ELSE list_sum(list_transform(range(0, d), lambda i: CAST(1.0 AS DOUBLE) / (n_at_risk - i))) END AS h
  FROM risk_set"""
CTES["curve"] = """
  SELECT t, n_at_risk, d, h, cum_hazard, exp(-cum_hazard) AS s0 FROM (
    SELECT *, sum(h) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_hazard
    FROM na_steps)"""
CTES["near"] = """
  SELECT hz, arg_min(t, (abs(t - hz), t)) AS t_near, arg_min(s0, (abs(t - hz), t)) AS s0
  FROM curve, (VALUES (1.0), (3.0), (6.0), (12.0)) hs(hz) GROUP BY hz"""
CTES["probs"] = """
  SELECT s.*,
    1 - pow((SELECT s0 FROM near WHERE hz = 1), exp(least(greatest(margin, -15), 15))) AS prob_1m,
    1 - pow((SELECT s0 FROM near WHERE hz = 3), exp(least(greatest(margin, -15), 15))) AS prob_3m,
    1 - pow((SELECT s0 FROM near WHERE hz = 6), exp(least(greatest(margin, -15), 15))) AS prob_6m,
    1 - pow((SELECT s0 FROM near WHERE hz = 12), exp(least(greatest(margin, -15), 15))) AS prob_12m
  FROM scored s"""
CTES["interp"] = """
  SELECT hz, CASE WHEN lo_t IS NULL THEN 1.0 WHEN hi_t IS NULL THEN last_s0
                  WHEN hi_t = lo_t THEN lo_s ELSE lo_s + (hi_s - lo_s) * (hz - lo_t) / (hi_t - lo_t) END AS s0
  FROM (SELECT hz, max(t) FILTER (WHERE t <= hz) AS lo_t, arg_max(s0, t) FILTER (WHERE t <= hz) AS lo_s,
               min(t) FILTER (WHERE t >= hz) AS hi_t, arg_min(s0, t) FILTER (WHERE t >= hz) AS hi_s,
               (SELECT arg_max(s0, t) FROM curve) AS last_s0
        FROM curve, (VALUES (1.0), (3.0), (6.0), (12.0)) hs(hz) GROUP BY hz)"""
CTES["scores"] = "SELECT *, prob_12m * 100.0 AS general_risk_score FROM probs"

_THEMES = ("identity", "environment", "compensation", "sentiment", "tenure")


def _theme_part(theme: str) -> str:
    terms = [f"greatest(f_{k} * CAST({b!r} AS DOUBLE), 0.0)" for k, b in FIXED_COEFFICIENTS.items()
             if FEATURE_THEME.get(k, "tenure") == theme]
    return "(0.0" + "".join(" + " + t for t in terms) + ")"


CTES["contrib_parts"] = "SELECT *, " + ", ".join(f"{_theme_part(t)} AS part_{t}" for t in _THEMES) + " FROM scored"
CTES["contribs"] = ("SELECT *, " + ", ".join(
    f"CASE WHEN tot > 0 THEN part_{t} / tot * 100.0 ELSE 20.0 END AS contrib_{t}" for t in _THEMES)
    + " FROM (SELECT *, (0.0" + "".join(f" + part_{t}" for t in _THEMES) + ") AS tot FROM contrib_parts)")

CTES["risk_scores"] = """
  SELECT p.emp_key, p.employee_id, p.prob_1m, p.prob_3m, p.prob_6m, p.prob_12m, p.general_risk_score,
         c.contrib_identity, c.contrib_environment, c.contrib_compensation, c.contrib_sentiment, c.contrib_tenure
  FROM scores p JOIN contribs c ON p.emp_key = c.emp_key"""



def with_ctes(final: str, extra: dict | None = None) -> str:
    """Prefix ``final`` with every CTE it (transitively) references."""
    defs = dict(CTES)
    if extra:
        defs.update(extra)
    order = list(defs)
    need: set[str] = set()
    stack = [final]
    while stack:
        s = stack.pop()
        for n in order:
            if n not in need and re.search(rf"\b{n}\b", s) and not _is_table(n):
                need.add(n)
                stack.append(defs[n])
    names = [n for n in order if n in need]
    if not names:
        return final
    return "WITH " + ",\n".join(f"{n} AS ({defs[n]})" for n in names) + "\n" + final


_TABLES = {"region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"}


def _is_table(name: str) -> bool:
    return name in _TABLES
