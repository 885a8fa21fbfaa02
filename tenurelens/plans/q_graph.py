"""Graph keys: nodes, typed edges, exposure, boosted risk, reporting tree,
tree traversal, exit ripple, tiers."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.labels import GRAPH_RISK_BANDS, RISK_BANDS
from ..operators import graph
from ..operators.attributes import exposure_fallback, slug
from ..operators.cohort import AS_OF_DATE
from ..session import cut_lineage
from .common import cohort_df, materialized_cohort, scores_df, scores_from
from .registry import query, r
from .sqlparts import CTES, md5_mod_sql, md5_prefix_sql, with_ctes

# ---------------------------------------------------------------------------
# SQL building blocks
# ---------------------------------------------------------------------------
CTES["nodes"] = """
  SELECT employee_id AS id, department, job_role, job_level,
         CASE WHEN years_at_company / 12.0 < 2 THEN '0-2' WHEN years_at_company / 12.0 < 5 THEN '2-5'
              WHEN years_at_company / 12.0 < 10 THEN '5-10' ELSE '10+' END AS tenure_cohort,
         attrition = 0 AS is_active, coalesce(date_of_leaving, '') AS exit_date
  FROM cohort"""
CTES["ranked_mgr"] = """
  SELECT *, row_number() OVER (PARTITION BY department, job_role, job_level ORDER BY md5(id), id) AS rank
  FROM nodes"""
CTES["edges_mgr"] = """
  SELECT a.id AS src, b.id AS dst, CAST(1.0 AS DOUBLE) AS weight, 'inferred' AS source, 'SAME_MANAGER' AS type
  FROM ranked_mgr a JOIN ranked_mgr b
    ON a.department = b.department AND a.job_role = b.job_role AND a.job_level = b.job_level
   AND (a.rank - 1) // 8 = (b.rank - 1) // 8
  WHERE a.id <> b.id"""
CTES["ranked_role"] = """
  SELECT *, row_number() OVER (PARTITION BY department, job_role ORDER BY md5(id), id) AS rank,
         count(*) OVER (PARTITION BY department, job_role) AS group_size FROM nodes"""
_ROLE_IDX = md5_mod_sql("(d.id || '|role|' || CAST(d.k AS VARCHAR))", 1 << 30)
_TEN_IDX = md5_mod_sql("(d.id || '|tenure|' || CAST(d.k AS VARCHAR))", 1 << 30)
CTES["edges_role"] = f"""
  SELECT src, dst, CAST(0.6 AS DOUBLE) AS weight, 'inferred' AS source, 'SAME_ROLE_DEPT' AS type FROM (
    SELECT DISTINCT d.id AS src, m.id AS dst FROM (SELECT * FROM ranked_role, (SELECT unnest(range(0, 5)) AS k) ks) d
    JOIN ranked_role m ON m.department = d.department AND m.job_role = d.job_role
     AND m.rank = {_ROLE_IDX} % d.group_size + 1
    WHERE d.id <> m.id)"""
CTES["ranked_ten"] = """
  SELECT *, row_number() OVER (PARTITION BY tenure_cohort ORDER BY md5(id), id) AS rank,
         count(*) OVER (PARTITION BY tenure_cohort) AS group_size FROM nodes"""
CTES["edges_ten"] = f"""
  SELECT DISTINCT d.id AS src, m.id AS dst, CAST(0.4 AS DOUBLE) AS weight, 'inferred' AS source,
         'SAME_TENURE_COHORT' AS type
  FROM (SELECT * FROM ranked_ten, (SELECT unnest(range(0, 3)) AS k) ks) d
  JOIN ranked_ten m ON m.tenure_cohort = d.tenure_cohort AND m.rank = {_TEN_IDX} % d.group_size + 1
  WHERE d.id <> m.id"""
CTES["edges_all"] = "SELECT * FROM edges_mgr UNION ALL SELECT * FROM edges_role UNION ALL SELECT * FROM edges_ten"
CTES["contrib"] = f"""
  SELECT u.node, u.peer, u.weight, u.type, x.peer_role, x.days,
         u.weight * exp(CAST(-0.1 AS DOUBLE) * x.days) AS contribution
  FROM (SELECT src AS node, dst AS peer, weight, type FROM edges_all
        UNION ALL SELECT dst, src, weight, type FROM edges_all) u
  JOIN (SELECT id AS peer, job_role AS peer_role,
               date_diff('day', CAST(exit_date AS DATE), DATE '{AS_OF_DATE}') AS days
        FROM nodes WHERE NOT is_active AND exit_date <> '') x ON u.peer = x.peer
  WHERE x.days BETWEEN 0 AND 60"""
CTES["exposure"] = ("SELECT node, sum(contribution) AS exposure_score, count(*) AS connected_exits "
                    "FROM contrib GROUP BY node")
CTES["boosted"] = """
  SELECT s.*, coalesce(x.exposure_score, 0.0) AS exposure,
         (1.0 - pow(1.0 - s.general_risk_score / 100.0, 1.0 + coalesce(x.exposure_score, 0.0))) * 100.0
           AS boosted_risk_score
  FROM scores s LEFT JOIN exposure x ON s.employee_id = x.node"""
CTES["emp_tree"] = f"""
  SELECT employee_id AS id, department, job_role AS role, job_level_rank AS level,
         CAST(attrition = 0 AS INTEGER) AS is_active FROM cohort"""
CTES["pools"] = "SELECT department, level AS target_level, count(*) AS pool_size FROM emp_tree GROUP BY 1, 2"
CTES["targets"] = """
  SELECT e.department, e.level, min(p.target_level) AS target_level
  FROM (SELECT DISTINCT department, level FROM emp_tree) e
  JOIN pools p ON e.department = p.department AND p.target_level > e.level GROUP BY 1, 2"""
CTES["pool_ranked"] = """
  SELECT id AS manager_id, department, level AS target_level,
         row_number() OVER (PARTITION BY department, level ORDER BY md5(id), id) AS idx FROM emp_tree"""
CTES["tree"] = f"""
  SELECT 'CEO' AS id, '' AS manager_id, 'Executive' AS department, 'Chief Executive Officer' AS role,
         CAST(NULL AS INTEGER) AS level, 1 AS is_active
  UNION ALL
  SELECT DISTINCT 'HEAD_' || replace(department, ' ', '_'), 'CEO', department, 'VP of ' || department,
         CAST(NULL AS INTEGER), 1 FROM emp_tree
  UNION ALL
  SELECT e.id, coalesce(pr.manager_id, 'HEAD_' || replace(e.department, ' ', '_')), e.department, e.role,
         e.level, e.is_active
  FROM emp_tree e LEFT JOIN targets t ON e.department = t.department AND e.level = t.level
  LEFT JOIN pools p ON p.department = t.department AND p.target_level = t.target_level
  LEFT JOIN pool_ranked pr ON pr.department = t.department AND pr.target_level = t.target_level
   AND pr.idx = {md5_mod_sql("(e.id || '|manager')", 1 << 30)} % p.pool_size + 1"""


def _nodes(spark, d):
    """Node table over the checkpointed cohort: the three edge families and
    the exposure walk read it several times."""
    return graph.node_table(materialized_cohort(spark, d))


def _contrib(spark, d):
    n = _nodes(spark, d)
    return graph.exposure_contributions(None, n, AS_OF_DATE)


_ECOLS = "src, dst, weight, source, type"


@query("graph_nodes", with_ctes("SELECT * FROM nodes"))
def q_graph_nodes(spark, d):
    return _nodes(spark, d)


@query("tenure_cohort", with_ctes("SELECT id, tenure_cohort FROM nodes"))
def q_tenure_cohort(spark, d):
    return _nodes(spark, d).select("id", "tenure_cohort")


@query("manager_chunks", with_ctes(
    "SELECT id, department, job_role, job_level, rank, (rank - 1) // 8 AS chunk FROM ranked_mgr"))
def q_manager_chunks(spark, d):
    g = ["department", "job_role", "job_level"]
    rk = graph._ranked(_nodes(spark, d).select("id", *g), g)
    return rk.select("id", *g, "rank", F.floor((F.col("rank") - 1) / 8).alias("chunk"))


@query("edges_same_manager", with_ctes(f"SELECT {_ECOLS} FROM edges_mgr"))
def q_edges_same_manager(spark, d):
    return graph.same_manager_edges(_nodes(spark, d))


@query("edges_same_role", with_ctes(f"SELECT {_ECOLS} FROM edges_role"))
def q_edges_same_role(spark, d):
    return graph.same_role_edges(_nodes(spark, d))


@query("edges_same_tenure", with_ctes(f"SELECT {_ECOLS} FROM edges_ten"))
def q_edges_same_tenure(spark, d):
    return graph.same_tenure_edges(_nodes(spark, d))


@query("edges_all", with_ctes(f"SELECT {_ECOLS} FROM edges_all"))
def q_edges_all(spark, d):
    """The union of the three edge types, row by row."""
    return graph.all_edges(_nodes(spark, d))


@query("exposure_score", with_ctes(
    "SELECT node, round(exposure_score, 9) AS exposure_score, connected_exits FROM exposure"))
def q_exposure_score(spark, d):
    x = graph.exposure_scores(_contrib(spark, d))
    return x.select("node", r("exposure_score").alias("exposure_score"), "connected_exits")


@query("exposure_peers", with_ctes(
    "SELECT node, peer, peer_role, round(weight, 2) AS weight, type, days, round(contribution, 9) AS exposure "
    "FROM contrib ORDER BY node, weight DESC, peer, type"))
def q_exposure_peers(spark, d):
    """Exited peers of every node, heaviest edge first, with each peer's
    decayed exposure; a filter on ``node`` reads the list of one node."""
    c = _contrib(spark, d).orderBy("node", F.desc("weight"), "peer", "type")
    return c.select("node", "peer", "peer_role", F.round("weight", 2).alias("weight"), "type", "days",
                    r("contribution").alias("exposure"))


@query("exposure_curve", with_ctes("""
SELECT node, -dd AS day, round(sum(CASE WHEN days - dd >= 0
                                   THEN weight * exp(CAST(-0.1 AS DOUBLE) * (days - dd)) ELSE 0.0 END), 9) AS score
FROM contrib, (SELECT unnest(range(0, 61)) AS dd) g GROUP BY node, dd"""))
def q_exposure_curve(spark, d):
    c = graph.exposure_curve(_contrib(spark, d))
    return c.select("node", "day", r("score").alias("score"))


def boosted_df(spark, d, c=None):
    c = c if c is not None else materialized_cohort(spark, d)
    s = scores_from(c)
    n = graph.node_table(c)
    x = graph.exposure_scores(graph.exposure_contributions(None, n, AS_OF_DATE)).select(
        F.col("node").alias("employee_id"), "exposure_score")
    b = s.join(x, "employee_id", "left").withColumn("exposure", F.coalesce("exposure_score", F.lit(0.0)))
    return b.withColumn("boosted_risk_score", graph.boosted_risk(F.col("general_risk_score"), F.col("exposure")))


@query("boosted_risk", with_ctes(
    "SELECT emp_key, round(exposure, 9) AS exposure, round(boosted_risk_score, 9) AS boosted_risk_score FROM boosted"))
def q_boosted_risk(spark, d):
    b = boosted_df(spark, d)
    return b.select("emp_key", r("exposure").alias("exposure"), r("boosted_risk_score").alias("boosted_risk_score"))


_FB_SQL = f"""
SELECT emp_key, CAST(q + CASE WHEN rem * 2 > 100 OR (rem * 2 = 100 AND q % 2 = 1) THEN 1 ELSE 0 END
                     AS DOUBLE) / 100.0 AS exposure_fallback
FROM (SELECT emp_key, units // 100 AS q, units % 100 AS rem
      FROM (SELECT emp_key, ({md5_prefix_sql('employee_id')} % 1000)
                   * (CASE WHEN general_risk_score > 50 THEN 25 WHEN general_risk_score > 25 THEN 12 ELSE 4 END)
                   AS units FROM scores))"""


@query("exposure_fallback", with_ctes(_FB_SQL))
def q_exposure_fallback(spark, d):
    s = scores_df(spark, d)
    return s.select("emp_key", exposure_fallback(F.col("employee_id"), F.col("general_risk_score"))
                    .alias("exposure_fallback"))


def _tier(col, bands, strict=False):
    expr = None
    for name, lo in bands:
        cond = (col > lo) if strict else (col >= lo)
        expr = F.when(cond, name) if expr is None else expr.when(cond, name)
    return expr.otherwise("low")


def _tier_sql(col, bands, strict=False):
    op = ">" if strict else ">="
    return "CASE " + " ".join(f"WHEN {col} {op} {lo} THEN '{n}'" for n, lo in bands) + " ELSE 'low' END"


@query("risk_tiers", with_ctes(
    f"SELECT emp_key, {_tier_sql('boosted_risk_score', RISK_BANDS)} AS tier, "
    f"{_tier_sql('general_risk_score', GRAPH_RISK_BANDS, True)} AS graph_tier FROM boosted"))
def q_risk_tiers(spark, d):
    b = boosted_df(spark, d)
    return b.select("emp_key", _tier(F.col("boosted_risk_score"), RISK_BANDS).alias("tier"),
                    _tier(F.col("general_risk_score"), GRAPH_RISK_BANDS, strict=True).alias("graph_tier"))


# ---------------------------------------------------------------------------
# reporting tree
# ---------------------------------------------------------------------------
@query("org_hierarchy", with_ctes("SELECT id, manager_id, department, role, level, is_active FROM tree"))
def q_org_hierarchy(spark, d):
    return graph.org_hierarchy(cohort_df(spark, d))


_LEVELS_SQL = with_ctes("SELECT id, depth FROM depth", {"depth": """
  SELECT id, 0 AS depth FROM tree WHERE manager_id = ''
  UNION ALL
  SELECT t.id, d.depth + 1 FROM tree t JOIN depth d ON t.manager_id = d.id"""}).replace("WITH ", "WITH RECURSIVE ", 1)


@query("org_levels", _LEVELS_SQL)
def q_org_levels(spark, d):
    return graph.tree_depths(graph.org_hierarchy(cohort_df(spark, d)))


@query("org_subtree", with_ctes("""
SELECT head, id, depth FROM under""", {"under": """
  SELECT id AS head, id, 0 AS depth FROM tree WHERE manager_id = 'CEO'
  UNION ALL
  SELECT u.head, t.id, u.depth + 1 FROM tree t JOIN under u ON t.manager_id = u.id"""}).replace("WITH ", "WITH RECURSIVE ", 1))
def q_org_subtree(spark, d):
    """Everyone below each department head, from path labels: a subtree is one
    range of labels."""
    tree = cut_lineage(graph.org_hierarchy(cohort_df(spark, d)))
    return graph.subtrees(graph.tree_paths(tree), tree.where("manager_id = 'CEO'").select("id"))


@query("org_department_view", with_ctes("""
SELECT t.id, t.manager_id, t.department, round(coalesce(s.general_risk_score, 0.0), 9) AS risk_score
FROM tree t LEFT JOIN scores s ON t.id = s.employee_id
WHERE t.id IN ('CEO', 'HEAD_BUILDING') OR t.department = 'BUILDING'"""))
def q_org_department_view(spark, d):
    """One department's members with its head and the root, each with a score."""
    s = scores_df(spark, d).select(F.col("employee_id").alias("id"), "general_risk_score")
    t = graph.department_view(graph.org_hierarchy(cohort_df(spark, d)), "BUILDING").join(s, "id", "left")
    return t.select("id", "manager_id", "department", r(F.coalesce("general_risk_score", F.lit(0.0))).alias("risk_score"))


@query("tree_with_risk", with_ctes("""
SELECT t.id, t.manager_id, round(coalesce(s.general_risk_score, 0.0), 9) AS risk_score
FROM tree t LEFT JOIN scores s ON t.id = s.employee_id"""))
def q_tree_with_risk(spark, d):
    """Defaulted dictionary join: every tree node gets its score, 0 if none."""
    t = graph.org_hierarchy(cohort_df(spark, d))
    s = scores_df(spark, d).select(F.col("employee_id").alias("id"), "general_risk_score")
    return t.join(s, "id", "left").select("id", "manager_id", r(F.coalesce("general_risk_score", F.lit(0.0)))
                                          .alias("risk_score"))


CTES["ripple_base"] = """
  SELECT id, manager_id, department, 1 - is_active AS is_exit
  FROM tree WHERE manager_id NOT IN ('', 'CEO')"""


@query("exit_ripple", with_ctes("""
SELECT b.id,
       CAST(30 * (coalesce(sib.n, 0) - b.is_exit + CASE WHEN mx.id IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS tree_bump,
       CAST(10 * (coalesce(dx.n, 0) - b.is_exit) AS BIGINT) AS dept_bump
FROM ripple_base b
LEFT JOIN (SELECT manager_id, count(*) AS n FROM ripple_base WHERE is_exit = 1 GROUP BY manager_id) sib
  ON b.manager_id = sib.manager_id
LEFT JOIN (SELECT id FROM ripple_base WHERE is_exit = 1) mx ON b.manager_id = mx.id
LEFT JOIN (SELECT department, count(*) AS n FROM ripple_base WHERE is_exit = 1 GROUP BY department) dx
  ON b.department = dx.department"""))
def q_exit_ripple(spark, d):
    """Observed exits bump the risk of siblings and reports by 30 (tree view) and of department peers by 10 (similarity
    view).  Counted per manager / department: no pairs are formed."""
    t = graph.org_hierarchy(cohort_df(spark, d)).where(~F.col("manager_id").isin("", "CEO"))
    b = t.select("id", "manager_id", "department", (1 - F.col("is_active")).alias("is_exit"))
    ex = b.where("is_exit = 1")
    sib = ex.groupBy("manager_id").agg(F.count(F.lit(1)).alias("_sib"))
    mx = ex.select(F.col("id").alias("manager_id"), F.lit(1).alias("_mx"))
    dx = ex.groupBy("department").agg(F.count(F.lit(1)).alias("_dx"))
    j = b.join(sib, "manager_id", "left").join(mx, "manager_id", "left").join(dx, "department", "left")
    return j.select("id",
                    (30 * (F.coalesce("_sib", F.lit(0)) - F.col("is_exit") + F.coalesce("_mx", F.lit(0))))
                    .cast("bigint").alias("tree_bump"),
                    (10 * (F.coalesce("_dx", F.lit(0)) - F.col("is_exit"))).cast("bigint").alias("dept_bump"))


@query("dept_slug", with_ctes(
    "SELECT DISTINCT department, replace(replace(department, ' ', '_'), '&', 'and') AS slug FROM cohort"))
def q_dept_slug(spark, d):
    c = cohort_df(spark, d).select("department").distinct()
    return c.select("department", slug(F.col("department")).alias("slug"))
