"""Warehouse keys: SCD2 snapshots, change classification, history build,
as-of reads, theme split / star join, ratings upsert, schema evolution,
score write-back and HR actions."""
from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import scd2
from ..operators.cohort import LEVEL_NAMES
from ..session import cut_lineage, ensure_checkpoint_dir
from ..sources.tables import scan
from .common import cohort_df, risk_scores_df
from .q_features import performance_scores
from .registry import query, r
from .sqlparts import CTES, _LEVEL, _case_idx, with_ctes

# FIXED VALUES — snapshot dates of the nightly loads on the driver's data
SNAPSHOTS = ("1999-01-01", "2000-01-01", "2001-01-01")
ASOF_READ = "2000-06-01"

_TR = scd2.TRACKED
_TR_SQL = ", ".join(_TR)


def _snap_sql(as_of: str) -> str:
    return f"""
  SELECT c_custkey AS emp_key, c_name AS employee_id, c_mktsegment AS department, r_name AS job_role,
         n_name AS education_field, {_case_idx(_LEVEL, LEVEL_NAMES)} AS job_level, order_status, order_priority
  FROM customer
  JOIN (SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS order_status,
               arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS order_priority
        FROM orders WHERE o_orderdate >= DATE '{as_of}' - INTERVAL 24 MONTH AND o_orderdate < DATE '{as_of}'
        GROUP BY o_custkey) p ON c_custkey = o_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


for _i, _d in enumerate(SNAPSHOTS, 1):
    CTES[f"snap{_i}"] = _snap_sql(_d)

_DIFF = " OR ".join(f"o.{c} IS DISTINCT FROM n.{c}" for c in _TR)
CTES["changes12"] = f"""
  SELECT coalesce(o.emp_key, n.emp_key) AS emp_key,
         CASE WHEN o.emp_key IS NULL THEN 'insert' WHEN n.emp_key IS NULL THEN 'delete'
              WHEN {_DIFF} THEN 'update' ELSE 'same' END AS change_type
  FROM snap1 o FULL OUTER JOIN snap2 n ON o.emp_key = n.emp_key"""
_T = "CAST(TIMESTAMP '{}' AS TIMESTAMP)"
CTES["hist_applied"] = f"""
  SELECT s.*, {_T.format(SNAPSHOTS[0])} AS valid_from, CAST(NULL AS TIMESTAMP) AS valid_to, true AS is_active
    FROM snap1 s JOIN changes12 c USING (emp_key) WHERE c.change_type = 'same'
  UNION ALL
  SELECT s.*, {_T.format(SNAPSHOTS[0])}, {_T.format(SNAPSHOTS[1])}, false
    FROM snap1 s JOIN changes12 c USING (emp_key) WHERE c.change_type IN ('update', 'delete')
  UNION ALL
  SELECT s.*, {_T.format(SNAPSHOTS[1])}, CAST(NULL AS TIMESTAMP), true
    FROM snap2 s JOIN changes12 c USING (emp_key) WHERE c.change_type IN ('insert', 'update')"""
_LAGDIFF = " OR ".join(f"lag({c}) OVER w IS DISTINCT FROM {c}" for c in _TR)
CTES["hist_built"] = f"""
  SELECT emp_key, {_TR_SQL},
         CASE fi WHEN 0 THEN {_T.format(SNAPSHOTS[0])} WHEN 1 THEN {_T.format(SNAPSHOTS[1])}
                 ELSE {_T.format(SNAPSHOTS[2])} END AS valid_from,
         CASE li WHEN 0 THEN {_T.format(SNAPSHOTS[1])} WHEN 1 THEN {_T.format(SNAPSHOTS[2])} END AS valid_to,
         li = 2 AS is_active
  FROM (SELECT emp_key, run, min(i) AS fi, max(i) AS li, {", ".join(f"any_value({c}) AS {c}" for c in _TR)}
        FROM (SELECT *, sum(st) OVER (PARTITION BY emp_key ORDER BY i ROWS UNBOUNDED PRECEDING) AS run
              FROM (SELECT *, CASE WHEN lag(i) OVER w IS NULL OR lag(i) OVER w <> i - 1 OR {_LAGDIFF}
                                   THEN 1 ELSE 0 END AS st
                    FROM (SELECT *, 0 AS i FROM snap1 UNION ALL SELECT *, 1 FROM snap2
                          UNION ALL SELECT *, 2 FROM snap3)
                    WINDOW w AS (PARTITION BY emp_key ORDER BY i)))
        GROUP BY emp_key, run)"""


def _snap(spark, d, as_of):
    return scd2.snapshot(scan(spark, d, "customer", "c_custkey", "c_name", "c_nationkey", "c_acctbal",
                              "c_mktsegment"),
                         scan(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate",
                              "o_orderpriority"),
                         scan(spark, d, "nation", "n_nationkey", "n_name", "n_regionkey"),
                         scan(spark, d, "region", "r_regionkey", "r_name"), as_of)


def built_history(spark, d):
    return scd2.build_history([(t, _snap(spark, d, t)) for t in SNAPSHOTS])


_HCOLS = ("emp_key",) + _TR + scd2.VALIDITY


@query("scd2_changes", with_ctes("SELECT change_type, count(*) AS n FROM changes12 GROUP BY change_type"))
def q_scd2_changes(spark, d):
    ch = scd2.classify(_snap(spark, d, SNAPSHOTS[0]), _snap(spark, d, SNAPSHOTS[1]))
    return ch.groupBy("change_type").agg(F.count(F.lit(1)).alias("n"))


@query("scd2_inserts", with_ctes(
    "SELECT n.emp_key, n.employee_id FROM snap2 n WHERE NOT EXISTS (SELECT 1 FROM snap1 o WHERE o.emp_key = n.emp_key)"))
def q_scd2_inserts(spark, d):
    old, new = _snap(spark, d, SNAPSHOTS[0]), _snap(spark, d, SNAPSHOTS[1])
    return new.join(old.select("emp_key"), "emp_key", "left_anti").select("emp_key", "employee_id")


@query("scd2_deletes", with_ctes("SELECT emp_key FROM snap1 EXCEPT SELECT emp_key FROM snap2"))
def q_scd2_deletes(spark, d):
    """Set difference of keys (active in the warehouse, gone from the source)."""
    old, new = _snap(spark, d, SNAPSHOTS[0]), _snap(spark, d, SNAPSHOTS[1])
    return old.select("emp_key").subtract(new.select("emp_key"))


@query("scd2_updates", with_ctes(
    f"SELECT o.emp_key, o.order_status AS old_status, n.order_status AS new_status, o.order_priority AS old_priority, "
    f"n.order_priority AS new_priority FROM snap1 o JOIN snap2 n ON o.emp_key = n.emp_key WHERE {_DIFF}"))
def q_scd2_updates(spark, d):
    o, n = _snap(spark, d, SNAPSHOTS[0]).alias("o"), _snap(spark, d, SNAPSHOTS[1]).alias("n")
    j = o.join(n, F.col("o.emp_key") == F.col("n.emp_key")).where(scd2._changed("o", "n", _TR))
    return j.select(F.col("o.emp_key").alias("emp_key"), F.col("o.order_status").alias("old_status"),
                    F.col("n.order_status").alias("new_status"), F.col("o.order_priority").alias("old_priority"),
                    F.col("n.order_priority").alias("new_priority"))


@query("scd2_apply", with_ctes("SELECT " + ", ".join(_HCOLS) + " FROM hist_applied"))
def q_scd2_apply(spark, d):
    h0 = scd2.initial_history(_snap(spark, d, SNAPSHOTS[0]), SNAPSHOTS[0])
    h1 = scd2.apply_snapshot(h0, _snap(spark, d, SNAPSHOTS[1]), SNAPSHOTS[1])
    return h1.select(*_HCOLS)


@query("scd2_build", with_ctes("SELECT " + ", ".join(_HCOLS) + " FROM hist_built"))
def q_scd2_build(spark, d):
    return built_history(spark, d).select(*_HCOLS)


@query("scd2_asof", with_ctes(
    "SELECT " + ", ".join(_HCOLS) + f" FROM hist_built WHERE valid_from <= TIMESTAMP '{ASOF_READ}' "
    f"AND (valid_to IS NULL OR TIMESTAMP '{ASOF_READ}' < valid_to)"))
def q_scd2_asof(spark, d):
    return scd2.asof(built_history(spark, d), ASOF_READ).select(*_HCOLS)


@query("latest_version", with_ctes(
    "SELECT " + ", ".join(_HCOLS) + " FROM (SELECT *, row_number() OVER (PARTITION BY emp_key "
    "ORDER BY valid_from DESC) AS rn FROM hist_built) WHERE rn = 1"))
def q_latest_version(spark, d):
    return scd2.latest(built_history(spark, d)).select(*_HCOLS)


@query("theme_split", with_ctes(" UNION ALL ".join(
    f"SELECT '{t}' AS theme, emp_key, '{c}' AS attribute, CAST({c} AS VARCHAR) AS value, valid_from, valid_to, "
    f"is_active FROM hist_built" for t, cols in scd2.THEMES.items() for c in cols)))
def q_theme_split(spark, d):
    """All five theme tables (vertical projections with key and validity), as
    (theme, attribute, value) rows."""
    out = None
    for theme, table in scd2.theme_split(cut_lineage(built_history(spark, d))).items():
        cols = [c for c in table.columns if c not in ("emp_key", *scd2.VALIDITY)]
        rows = table.select("emp_key", *scd2.VALIDITY, *[F.col(c).cast("string").alias(c) for c in cols]).unpivot(
            ["emp_key", *scd2.VALIDITY], cols, "attribute", "value")
        rows = rows.select(F.lit(theme).alias("theme"), "emp_key", "attribute", "value", *scd2.VALIDITY)
        out = rows if out is None else out.unionByName(rows)
    return out


@query("ml_features_view", with_ctes("SELECT emp_key, " + _TR_SQL + " FROM hist_built WHERE is_active"))
def q_ml_features_view(spark, d):
    """Active rows of the five theme tables re-joined on the key.  The history
    is written once, clustered by the key, and read by all five."""
    history = cut_lineage(built_history(spark, d).where("is_active").repartition(scd2.KEY))
    v = scd2.star_join_active(scd2.theme_split(history))
    return v.select("emp_key", *_TR)


# ---------------------------------------------------------------------------
# ratings: left join and upsert (latest wins)
# ---------------------------------------------------------------------------
CTES["ratings"] = """
  SELECT emp_key, performance_score, 'mgr_' || CAST(emp_key % 50 AS VARCHAR) AS rated_by,
         CAST(TIMESTAMP '2000-01-01' + to_days(CAST(emp_key % 365 AS INTEGER)) AS TIMESTAMP) AS rated_at
  FROM perf WHERE emp_key % 10 <> 3"""
CTES["rating_updates"] = """
  SELECT emp_key, CAST(1 + emp_key % 4 AS INTEGER) AS performance_score, 'hr_portal' AS rated_by,
         TIMESTAMP '2000-06-01' AS rated_at
  FROM cohort WHERE emp_key % 10 IN (3, 5)"""


def ratings_df(spark, d, c=None):
    c = c if c is not None else cohort_df(spark, d)
    p = performance_scores(c).where(F.col("emp_key") % 10 != 3)
    return p.select("emp_key", "performance_score",
                    F.concat(F.lit("mgr_"), (F.col("emp_key") % 50).cast("string")).alias("rated_by"),
                    F.timestamp_add("DAY", (F.col("emp_key") % 365).cast("int"),
                                    F.lit("2000-01-01").cast("timestamp_ntz")).alias("rated_at"))


def rating_updates_df(spark, d):
    c = cohort_df(spark, d).where((F.col("emp_key") % 10).isin(3, 5))
    return c.select("emp_key", (F.col("emp_key") % 4 + 1).cast("int").alias("performance_score"),
                    F.lit("hr_portal").alias("rated_by"),
                    F.lit("2000-06-01").cast("timestamp_ntz").alias("rated_at"))


@query("ratings_left_join", with_ctes(
    "SELECT c.emp_key, c.employee_id, r.performance_score FROM cohort c LEFT JOIN ratings r ON c.emp_key = r.emp_key"))
def q_ratings_left_join(spark, d):
    c = cohort_df(spark, d).select("emp_key", "employee_id")
    return c.join(ratings_df(spark, d).select("emp_key", "performance_score"), "emp_key", "left")


def upsert_latest(base, updates, key="emp_key", order_col="rated_at"):
    """Insert new keys, overwrite existing ones: union, newest row per key
    (updates win ties).  Per-key windows hold at most one row per source."""
    u = base.withColumn("_src", F.lit(0)).unionByName(updates.withColumn("_src", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.col(order_col).desc(), F.col("_src").desc())
    return u.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_src")


@query("rating_upsert", with_ctes("""
SELECT emp_key, performance_score, rated_by, rated_at FROM (
  SELECT *, row_number() OVER (PARTITION BY emp_key ORDER BY rated_at DESC, src DESC) AS rn FROM (
    SELECT *, 0 AS src FROM ratings UNION ALL SELECT *, 1 FROM rating_updates)) WHERE rn = 1"""))
def q_rating_upsert(spark, d):
    return upsert_latest(ratings_df(spark, d), rating_updates_df(spark, d))


# ---------------------------------------------------------------------------
# schema evolution, write-back, actions
# ---------------------------------------------------------------------------
@query("schema_evolve_union", with_ctes("""
SELECT emp_key, department, job_role, CAST(NULL AS VARCHAR) AS project FROM snap1
UNION ALL SELECT emp_key, department, job_role, project FROM with_project"""))
def q_schema_evolve_union(spark, d):
    """Rows written before the ``project`` column existed, unioned by name
    with rows that carry it (missing column → NULL)."""
    from .q_features import with_project
    old = _snap(spark, d, SNAPSHOTS[0]).select("emp_key", "department", "job_role")
    new = with_project(cohort_df(spark, d)).select("emp_key", "department", "job_role", "project")
    return old.unionByName(new, allowMissingColumns=True)


_SCORE_COLS = ("emp_key", "employee_id", "prob_1m", "prob_3m", "prob_6m", "prob_12m", "general_risk_score",
               "contrib_identity", "contrib_environment", "contrib_compensation", "contrib_sentiment",
               "contrib_tenure")


def table_dir(spark, name: str) -> str:
    """A folder for materialised tables under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    return base.rstrip("/") + "/tables/" + name


def write_scores(spark, d, path: str | None = None) -> str:
    """Full refresh of the score table, each into a folder of its own, so that
    no reader of an earlier one is disturbed."""
    path = path or table_dir(spark, f"flight_risk_scores_{uuid.uuid4().hex}")
    s = risk_scores_df(spark, d).withColumn("date_calculated", F.current_timestamp())
    s.write.mode("overwrite").parquet(path)
    return path


@query("score_writeback", with_ctes(
    "SELECT " + ", ".join(c if c in ("emp_key", "employee_id") else f"round({c}, 6) AS {c}" for c in _SCORE_COLS)
    + " FROM risk_scores"))
def q_score_writeback(spark, d):
    path = write_scores(spark, d)
    back = spark.read.parquet(path)
    return back.select(*[c if c in ("emp_key", "employee_id") else r(c, 6).alias(c) for c in _SCORE_COLS])


_LEVEL_UP = "least(job_level_rank + 1, 5)"
CTES["promotions"] = f"""
  SELECT emp_key, 'Lead ' || job_role AS job_role, CAST({_LEVEL_UP} AS INTEGER) AS job_level_rank,
         round(monthly_income * CAST(1.1 AS DOUBLE), 2) AS monthly_income FROM cohort WHERE emp_key % 10 = 1"""
CTES["hikes"] = """
  SELECT emp_key, CAST(5 + emp_key % 11 AS DOUBLE) AS pct FROM cohort WHERE emp_key % 10 = 6 OR emp_key % 20 = 11"""


def actions_df(spark, d):
    """Requested actions with their parameters: promotions (new role, level and
    income), overtime changes, manager changes and percent raises; some
    employees have two of them."""
    c = cohort_df(spark, d)
    k = F.col("emp_key")
    none = {"job_role": "string", "job_level_rank": "int", "monthly_income": "double", "over_time": "string",
            "years_with_curr_manager": "bigint", "percent_salary_hike": "double"}

    def part(cond, action, ts, **values):
        cols = [values.get(n, F.lit(None)).cast(t).alias(n) for n, t in none.items()]
        return c.where(cond).select("emp_key", F.lit(action).alias("action"),
                                    F.lit(ts).cast("timestamp_ntz").alias("action_ts"), *cols)

    parts = [part(k % 10 == 1, "promote", "2000-02-01", job_role=F.concat(F.lit("Lead "), "job_role"),
                  job_level_rank=F.least(F.col("job_level_rank") + 1, F.lit(5)),
                  monthly_income=F.round(F.col("monthly_income") * 1.1, 2)),
             part((k % 10 == 2) | (k % 20 == 1), "overtime", "2000-03-01",
                  over_time=F.when(k % 4 == 0, F.lit("No")).otherwise(F.lit("Yes"))),
             part(k % 10 == 4, "manager_change", "2000-04-01", years_with_curr_manager=k % 3),
             part((k % 10 == 6) | (k % 20 == 11), "salary_hike", "2000-05-01",
                  percent_salary_hike=5 + k % 11)]
    return reduce(lambda a, b: a.unionByName(b), parts)


def apply_actions(employees, actions):
    """Each action updates its own columns, in time order per employee: a
    promotion sets role, level and income, an overtime or manager change its
    one value, a raise multiplies the income of its time and is kept as the
    percentage.  ``employees`` needs years_with_curr_manager."""
    values = ("job_role", "job_level_rank", "monthly_income", "over_time", "years_with_curr_manager",
              "percent_salary_hike")
    queue = actions.groupBy("emp_key").agg(F.sort_array(F.collect_list(
        F.struct("action_ts", "action", *values))).alias("_queue"))  # one employee's actions
    j = employees.withColumn("percent_salary_hike", F.lit(None).cast("double")).join(queue, "emp_key", "left")
    start = F.struct(*[F.col(c) for c in values], F.lit(0).alias("n"))

    def step(acc, x):
        new = {c: F.coalesce(x[c], acc[c]) for c in values}
        new["monthly_income"] = F.when(x["action"] == "salary_hike", F.round(
            acc["monthly_income"] * (1 + x["percent_salary_hike"] / 100), 2)).otherwise(new["monthly_income"])
        return F.struct(*[v.alias(c) for c, v in new.items()], (acc["n"] + 1).alias("n"))

    empty = F.filter(F.array(F.struct(F.lit(None).cast("timestamp_ntz").alias("action_ts"),
                                      F.lit("").alias("action"), *[F.col(c) for c in values])), lambda x: F.lit(False))
    done = F.aggregate(F.coalesce("_queue", empty), start, step)
    return j.select("emp_key", done.alias("_v")).select("emp_key", *[f"_v.{c}" for c in values],
                                                        F.col("_v.n").alias("n_actions"))


@query("apply_actions", with_ctes("""
SELECT c.emp_key, coalesce(p.job_role, c.job_role) AS job_role,
       coalesce(p.job_level_rank, c.job_level_rank) AS job_level_rank,
       CASE WHEN h.pct IS NULL THEN coalesce(p.monthly_income, c.monthly_income)
            ELSE round(coalesce(p.monthly_income, c.monthly_income) * (1 + h.pct / 100), 2) END AS monthly_income,
       CASE WHEN c.emp_key % 10 = 2 OR c.emp_key % 20 = 1 THEN CASE WHEN c.emp_key % 4 = 0 THEN 'No' ELSE 'Yes' END
            ELSE c.over_time END AS over_time,
       CASE WHEN c.emp_key % 10 = 4 THEN c.emp_key % 3 ELSE c.years_at_company % 12 END AS years_with_curr_manager,
       h.pct AS percent_salary_hike,
       CAST((c.emp_key % 10 = 1)::INT + (c.emp_key % 10 = 2 OR c.emp_key % 20 = 1)::INT + (c.emp_key % 10 = 4)::INT
            + (h.pct IS NOT NULL)::INT AS INTEGER) AS n_actions
FROM cohort c LEFT JOIN promotions p ON c.emp_key = p.emp_key LEFT JOIN hikes h ON c.emp_key = h.emp_key"""))
def q_apply_actions(spark, d):
    c = cohort_df(spark, d).withColumn("years_with_curr_manager", F.col("years_at_company") % 12)
    return apply_actions(c, actions_df(spark, d))


# ---------------------------------------------------------------------------
# streaming load (micro-batches of snapshots)
# ---------------------------------------------------------------------------
@query("scd2_stream", with_ctes("SELECT " + ", ".join(_HCOLS) + " FROM hist_built"))
def q_scd2_stream(spark, d):
    """The three snapshots announced to the manifest stream (one a trigger)
    and applied by the foreachBatch SCD2 sink; the final history equals the
    batch build."""
    from ..streaming.scd2_stream import announce_snapshot, run_snapshot_stream
    base = table_dir(spark, f"scd2_stream_{uuid.uuid4().hex}")
    for t in SNAPSHOTS:
        path = f"{base}/source/{t[:10]}"
        _snap(spark, d, t).write.parquet(path)
        announce_snapshot(spark, f"{base}/manifest", t, path)
    hist = run_snapshot_stream(spark, base + "/manifest", base + "/state", base + "/checkpoint")
    return hist.select(*_HCOLS)


@query("scd2_active_read", with_ctes("SELECT " + ", ".join(_HCOLS) + " FROM hist_built WHERE is_active"))
def q_scd2_active_read(spark, d):
    """History stored partitioned by is_active; the active read prunes to one
    partition directory."""
    path = table_dir(spark, f"employee_history_{uuid.uuid4().hex}")
    h = built_history(spark, d)
    scd2.write_history(h, path)
    return scd2.read_active(spark, path, h.schema).select(*_HCOLS)
