"""Source / sink keys and the composite pair distance on graph edges."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import graph
from ..operators.ranking import group_rank
from ..operators.similarity import composite_distance, similarity_inputs
from ..operators.survival import SCORE_FEATURES
from ..sources.csv_scan import lenient_csv, normalise_nulls
from ..session import cut_lineage
from ..sources.sinks import export_partitioned_json, export_typed_csv, output_dir, read_partitioned_json, run_metadata
from ..sources.tables import scan
from .common import cohort_df, materialized_cohort, scores_from
from . import q_graph  # noqa: F401  (registers the graph CTEs used below)
from .q_features import with_project
from .q_warehouse import ratings_df
from .registry import query, r
from .sqlparts import CTES, with_ctes

KEYS_PER_BUCKET = 1 << 16  # keys are numbered inside ranges of so many


_CSV_SCHEMA = T.StructType([T.StructField("emp_key", T.LongType()), T.StructField("employee_id", T.StringType()),
                            T.StructField("department", T.StringType()),
                            T.StructField("date_of_leaving", T.StringType())])


def write_dirty_extract(spark, d) -> str:
    """The source extract as CSV text derived from the tables: missing dates
    spelled 'nan', every 97th key with an extra field (over-long line), every
    89th key cut short (missing fields)."""
    c = cohort_df(spark, d)
    k = F.col("emp_key")
    base = F.concat_ws(",", k.cast("string"), F.col("employee_id"), F.col("department"),
                       F.coalesce(F.col("date_of_leaving"), F.lit("nan")))
    line = (F.when(k % 97 == 0, F.concat(base, F.lit(",EXTRA")))
            .when(k % 89 == 0, F.concat_ws(",", k.cast("string"), F.col("employee_id")))
            .otherwise(base))
    path = output_dir(spark, f"extract_{uuid.uuid4().hex}")
    c.select(line.alias("value")).write.mode("overwrite").text(path)
    return path


@query("csv_lenient_scan", with_ctes("""
SELECT emp_key, employee_id, CASE WHEN emp_key % 89 = 0 THEN NULL ELSE department END AS department,
       CASE WHEN emp_key % 89 = 0 THEN NULL ELSE date_of_leaving END AS date_of_leaving
FROM cohort WHERE emp_key % 97 <> 0"""))
def q_csv_lenient_scan(spark, d):
    df = lenient_csv(spark, write_dirty_extract(spark, d), _CSV_SCHEMA)
    return normalise_nulls(df, ["date_of_leaving"])


@query("null_tokens", with_ctes("SELECT emp_key, date_of_leaving FROM cohort"))
def q_null_tokens(spark, d):
    c = cohort_df(spark, d).select("emp_key", F.coalesce("date_of_leaving", F.lit("nan")).alias("date_of_leaving"))
    return normalise_nulls(c, ["date_of_leaving"])


def surrogate_keys(rows, key: str, first: int | None = None):
    """Every row gets the code EMP_%04d of its place in key order; ``first``
    keeps only so many.  Places are ranks inside key ranges plus the rows of
    the earlier ranges, so no task sorts the whole table."""
    ranked = group_rank(rows.withColumn("_all", F.lit(0)), ["_all"], key, key,
                        F.floor(F.col(key) / KEYS_PER_BUCKET).cast("long"), "_place", "_rows").drop("_all", "_rows")
    if first is not None:
        ranked = ranked.where(F.col("_place") <= first)
    return ranked.withColumn("employee_code", F.format_string("EMP_%04d", "_place")).drop("_place")


@query("surrogate_key", with_ctes("""
SELECT printf('EMP_%04d', rn) AS employee_code, c_custkey, c_name FROM (
  SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_custkey) AS rn FROM customer)"""))
def q_surrogate_key(spark, d):
    """Every customer in key order gets its EMP_%04d code."""
    c = surrogate_keys(scan(spark, d, "customer", "c_custkey", "c_name"), "c_custkey")
    return c.select("employee_code", "c_custkey", "c_name")


@query("run_metadata", with_ctes(
    f"SELECT count(*) AS dataset_rows, CAST({len(SCORE_FEATURES)} AS BIGINT) AS features_count, "
    "'fixed-coefficient survival scoring' AS model_type FROM cohort"))
def q_run_metadata(spark, d):
    m = run_metadata(spark, cohort_df(spark, d), list(SCORE_FEATURES), "fixed-coefficient survival scoring")
    path = output_dir(spark, f"run_metadata_{uuid.uuid4().hex}")
    m.coalesce(1).write.mode("overwrite").json(path)  # one record
    return spark.read.schema(m.schema).json(path).select("dataset_rows", "features_count", "model_type")


@query("graph_nodes_csv", with_ctes("""
SELECT id AS "id:ID", department, job_role AS "jobRole", job_level AS "jobLevel", tenure_cohort AS "tenureCohort",
       CAST(is_active AS VARCHAR) AS "isActive:boolean", NULLIF(exit_date, '') AS "exitDate" FROM nodes"""))
def q_graph_nodes_csv(spark, d):
    """Node table exported with typed CSV headers, read back."""
    nodes = graph.node_table(cohort_df(spark, d))
    names = {"id": "id:ID", "is_active": "isActive:boolean", "job_role": "jobRole", "job_level": "jobLevel",
             "tenure_cohort": "tenureCohort", "exit_date": "exitDate"}
    path = export_typed_csv(nodes, names, output_dir(spark, f"graph_nodes_{uuid.uuid4().hex}"))
    return spark.read.option("header", True).csv(path)


# ---------------------------------------------------------------------------
# composite distance on edges
# ---------------------------------------------------------------------------
CTES["sim_base"] = """
  SELECT wp.employee_id AS id, wp.department, wp.project, wp.gender, CAST(wp.age AS DOUBLE) AS age,
         coalesce(s.general_risk_score, 0.0) AS risk, tr.manager_id,
         CASE WHEN rt.performance_score IN (1, 2) THEN 'High' WHEN rt.performance_score IS NULL THEN NULL
              ELSE 'Low' END AS tier
  FROM with_project wp LEFT JOIN scores s ON wp.emp_key = s.emp_key
  LEFT JOIN ratings rt ON wp.emp_key = rt.emp_key LEFT JOIN tree tr ON wp.employee_id = tr.id"""
CTES["sim_att"] = """
  SELECT *, CASE WHEN max(age) OVER w - min(age) OVER w = 0 THEN 0.5
                 ELSE (age - min(age) OVER w) / (max(age) OVER w - min(age) OVER w) END AS age_norm,
            CASE WHEN max(risk) OVER w - min(risk) OVER w = 0 THEN 0.5
                 ELSE (risk - min(risk) OVER w) / (max(risk) OVER w - min(risk) OVER w) END AS risk_norm
  FROM sim_base WINDOW w AS (PARTITION BY department)"""
_DIST = """CAST(0.6 AS DOUBLE) * ((CASE WHEN x.manager_id = y.manager_id AND coalesce(x.manager_id, '') <> '' THEN CAST(0.0 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END) / CAST(3.0 AS DOUBLE) + (CASE WHEN x.department = y.department THEN CAST(0.0 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END) / CAST(3.0 AS DOUBLE) + (CASE WHEN x.project = y.project THEN CAST(0.0 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END) / CAST(3.0 AS DOUBLE)) + CAST(0.2 AS DOUBLE) * (CASE WHEN x.tier IS NOT NULL AND y.tier IS NOT NULL THEN CAST(0.5 AS DOUBLE) * (CASE WHEN x.gender = y.gender THEN CAST(0.0 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END) + CAST(0.5 AS DOUBLE) * (CASE WHEN x.tier = y.tier THEN CAST(0.0 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END) ELSE (CASE WHEN x.gender = y.gender THEN CAST(0.0 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END) END) + CAST(0.2 AS DOUBLE) * (CAST(0.5 AS DOUBLE) * abs(x.age_norm - y.age_norm) + CAST(0.5 AS DOUBLE) * abs(x.risk_norm - y.risk_norm))"""


@query("pair_distance", with_ctes(f"""
SELECT a, b, round(dist, 9) AS distance, round(1.0 - dist, 4) AS weight FROM (
  SELECT p.a, p.b, {_DIST} AS dist
  FROM (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges_all) p
  JOIN sim_att x ON p.a = x.id JOIN sim_att y ON p.b = y.id)"""))
def q_pair_distance(spark, d):
    """The composite similarity distance evaluated on the peer-graph edges
    (each unordered pair once), with weight = round(1 - d, 4)."""
    c = materialized_cohort(spark, d)
    att = similarity_inputs(c, scores_from(c), ratings_df(spark, d), with_project)
    nodes = graph.node_table(c)
    e = graph.all_edges(nodes).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")) \
        .distinct()
    out = composite_distance(e, att)
    return out.select("a", "b", r("distance").alias("distance"), "weight")


# ---------------------------------------------------------------------------
# similarity kNN graph
# ---------------------------------------------------------------------------
CTES["knn_ranked"] = f"""
  SELECT a, b, dist, row_number() OVER (PARTITION BY a ORDER BY dist, b) AS rank FROM (
    SELECT x.id AS a, y.id AS b, {_DIST} AS dist
    FROM sim_att x JOIN sim_att y ON x.department = y.department AND x.id <> y.id)"""
CTES["knn_top"] = """
  SELECT r.a, r.b, r.dist, r.rank FROM knn_ranked r JOIN sim_att s ON r.a = s.id
  JOIN (SELECT department, greatest(3, least(20, ceil(count(*) * 0.1))) AS k FROM sim_att GROUP BY department) kd
    ON s.department = kd.department
  WHERE r.rank <= kd.k"""


def _knn(spark, d):
    from ..operators.knn import knn
    c = materialized_cohort(spark, d)
    att = similarity_inputs(c, scores_from(c), ratings_df(spark, d, c), with_project)
    return knn(att)


@query("similarity_knn", with_ctes("SELECT a, b, round(dist, 9) AS distance, rank FROM knn_top"))
def q_similarity_knn(spark, d):
    """k nearest peers of every entity inside its department (exact; ties by
    id), found by certified ring searches instead of all pairs."""
    return _knn(spark, d).select("a", "b", r("distance").alias("distance"), "rank")


@query("similarity_edges", with_ctes("""
SELECT source, target, round(1.0 - any_value(dist), 4) AS weight FROM (
  SELECT least(a, b) AS source, greatest(a, b) AS target, dist FROM knn_top) GROUP BY source, target"""))
def q_similarity_edges(spark, d):
    """Undirected kNN graph: each unordered pair once, weight = round(1-d, 4)."""
    from ..operators.knn import similarity_edges
    return similarity_edges(_knn(spark, d))


# ---------------------------------------------------------------------------
# exports of the graphs, read back
# ---------------------------------------------------------------------------
# FIXED VALUES — typed headers of the edge files
EDGE_HEADERS = {"src": ":START_ID", "dst": ":END_ID", "weight": "weight:float", "source": "source", "type": ":TYPE"}


@query("graph_edges_csv", with_ctes("""
SELECT src AS ":START_ID", dst AS ":END_ID", weight AS "weight:float", source, type AS ":TYPE" FROM edges_all"""))
def q_graph_edges_csv(spark, d):
    """The three edge lists exported to a CSV folder each, with typed headers,
    and read back."""
    nodes = graph.node_table(materialized_cohort(spark, d))
    base = output_dir(spark, f"graph_edges_{uuid.uuid4().hex}")
    lists = {"manager": graph.same_manager_edges(nodes), "role": graph.same_role_edges(nodes), "tenure": graph.same_tenure_edges(nodes)}
    paths = [export_typed_csv(e.select(*EDGE_HEADERS), EDGE_HEADERS, f"{base}/{name}") for name, e in lists.items()]
    schema = ", ".join(f"`{h}` {'double' if h == 'weight:float' else 'string'}" for h in EDGE_HEADERS.values())
    return spark.read.schema(schema).option("header", True).csv(paths)


_NODE = ("id", "job_role", "job_level", "gender", "age", "project", "manager_id", "performance_tier", "risk_score")


@query("graph_json_export", with_ctes("""
SELECT b.department, 'node' AS kind, b.id, w.job_role, w.job_level, b.gender, w.age, b.project, coalesce(b.manager_id, '') AS manager_id,
       b.tier AS performance_tier, round(b.risk, 9) AS risk_score, NULL::VARCHAR AS source, NULL::VARCHAR AS target, NULL::DOUBLE AS weight
FROM sim_base b JOIN with_project w ON b.id = w.employee_id
UNION ALL
SELECT b.department, 'edge', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, e.source, e.target, e.weight
FROM (SELECT source, target, round(1.0 - any_value(dist), 4) AS weight
      FROM (SELECT least(a, b) AS source, greatest(a, b) AS target, dist FROM knn_top) GROUP BY source, target) e
JOIN sim_base b ON e.source = b.id"""))
def q_graph_json_export(spark, d):
    """The similarity graph of every department as nested JSON, nodes with all
    their attributes and kNN edges with weights, written and read back."""
    from ..operators.knn import knn, similarity_edges
    c = materialized_cohort(spark, d)
    scores = scores_from(c)
    att = cut_lineage(similarity_inputs(c, scores, ratings_df(spark, d, c), with_project))
    own = c.select(F.col("employee_id").alias("id"), "emp_key", "job_role", "job_level", "age").join(
        scores.select("emp_key", F.coalesce("general_risk_score", F.lit(0.0)).alias("risk_score")), "emp_key", "left")
    nodes = att.withColumn("manager_id", F.coalesce("manager_id", F.lit(""))).withColumnRenamed("tier", "performance_tier").join(own, "id").select("department", *_NODE)
    edges = similarity_edges(knn(att)).join(att.select(F.col("id").alias("source"), "department"), "source").select("department", "source", "target", "weight")
    path = export_partitioned_json(nodes, edges, "department", output_dir(spark, f"graph_json_{uuid.uuid4().hex}"))
    back = read_partitioned_json(spark, path, nodes, edges, "department")
    return back.select("department", "kind", *[r(f"node.{c}").alias(c) if c == "risk_score" else F.col(f"node.{c}") for c in _NODE],
                       "edge.source", "edge.target", "edge.weight")
