"""Slowly-changing (Type 2) history.

* ``classify``: full outer join of the active versions and a new snapshot on
  the key; the change test is a null-safe comparison of the tracked columns.
* ``apply_snapshot``: kept ∪ closed ∪ new versions — a set expression in one
  plan instead of per-row UPDATE/INSERT statements.
* ``build_history``: several snapshots at once; change points come from
  ``lag`` over each key's snapshot sequence (a key has at most one row per
  snapshot, so the windows are tiny and cannot skew), validity from the run
  boundaries.
* ``asof`` / ``latest``: the reads the validity interval is for.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cohort import LEVEL_NAMES, _label

KEY = "emp_key"
TRACKED = ("employee_id", "department", "job_role", "education_field", "job_level", "order_status",
           "order_priority")
# FIXED VALUES — theme of each warehouse column of the driver binding
THEMES = {
    "identity": ("employee_id", "education_field"),
    "environment": ("department", "job_role"),
    "compensation": ("job_level",),
    "sentiment": ("order_priority",),
    "tenure": ("order_status",),
}
VALIDITY = ("valid_from", "valid_to", "is_active")


def snapshot(customer: DataFrame, orders: DataFrame, nation: DataFrame, region: DataFrame,
             as_of: str, lookback_months: int = 24) -> DataFrame:
    """The source table as it looked at ``as_of``: customers with an order in
    the lookback window, with the status and priority of their latest order.
    The date predicate is pushed into the orders scan."""
    lo = F.add_months(F.lit(as_of).cast("date"), -lookback_months)
    o = orders.where((F.col("o_orderdate") >= lo.cast("timestamp_ntz"))
                     & (F.col("o_orderdate") < F.lit(as_of).cast("date").cast("timestamp_ntz")))
    latest = F.struct("o_orderdate", "o_orderkey")
    prof = o.groupBy("o_custkey").agg(F.max_by("o_orderstatus", latest).alias("order_status"),
                                      F.max_by("o_orderpriority", latest).alias("order_priority"))
    geo = F.broadcast(nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")))
    level = F.least(F.greatest(F.floor(F.col("c_acctbal") / 2000) + 1, F.lit(1)), F.lit(5)).cast("int")
    return (customer.join(prof, F.col("c_custkey") == F.col("o_custkey"))
            .join(geo, F.col("c_nationkey") == F.col("n_nationkey"))
            .select(F.col("c_custkey").alias(KEY), F.col("c_name").alias("employee_id"),
                    F.col("c_mktsegment").alias("department"), F.col("r_name").alias("job_role"),
                    F.col("n_name").alias("education_field"), _label(level, LEVEL_NAMES).alias("job_level"),
                    "order_status", "order_priority"))


def _changed(a: str, b: str, cols) -> Column:
    return reduce(lambda x, y: x | y, [~F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in cols])


def classify(active: DataFrame, current: DataFrame, tracked=TRACKED) -> DataFrame:
    """(key, change_type) for every key of either side:
    insert / delete / update / same."""
    j = active.alias("o").join(current.alias("n"), F.col(f"o.{KEY}") == F.col(f"n.{KEY}"), "full_outer")
    ct = (F.when(F.col(f"o.{KEY}").isNull(), "insert")
          .when(F.col(f"n.{KEY}").isNull(), "delete")
          .when(_changed("o", "n", tracked), "update")
          .otherwise("same"))
    return j.select(F.coalesce(F.col(f"o.{KEY}"), F.col(f"n.{KEY}")).alias(KEY), ct.alias("change_type"))


def initial_history(snap: DataFrame, ts: str) -> DataFrame:
    return snap.select("*", F.lit(ts).cast("timestamp_ntz").alias("valid_from"),
                       F.lit(None).cast("timestamp_ntz").alias("valid_to"), F.lit(True).alias("is_active"))


def apply_snapshot(history: DataFrame, current: DataFrame, ts: str, tracked=TRACKED) -> DataFrame:
    """New history after loading ``current`` at ``ts``.

    Deleted and changed keys close their active version (valid_to = ts,
    inactive); new and changed keys open a version; closed history rows
    pass through untouched.
    """
    t = F.lit(ts).cast("timestamp_ntz")
    active = history.where("is_active")
    past = history.where(~F.col("is_active"))
    ch = classify(active.drop(*VALIDITY), current, tracked)
    a = active.join(ch, KEY)
    kept = a.where(F.col("change_type") == "same").drop("change_type")
    closed = (a.where(F.col("change_type").isin("update", "delete")).drop("change_type")
              .withColumn("valid_to", t).withColumn("is_active", F.lit(False)))
    opened = (current.join(ch.where(F.col("change_type").isin("insert", "update")), KEY).drop("change_type")
              .select("*", t.alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"),
                      F.lit(True).alias("is_active")))
    cols = history.columns
    return past.select(cols).unionByName(kept.select(cols)).unionByName(closed.select(cols)) \
        .unionByName(opened.select(cols))


def build_history(snapshots: list[tuple[str, DataFrame]], tracked=TRACKED) -> DataFrame:
    """History of several snapshots (ordered by time) in one pass."""
    times = [ts for ts, _ in snapshots]
    tagged = reduce(lambda x, y: x.unionByName(y),
                    [s.withColumn("_i", F.lit(i)) for i, (_, s) in enumerate(snapshots)])
    w = Window.partitionBy(KEY).orderBy("_i")
    prev_i = F.lag("_i").over(w)
    prev_row = F.lag(F.struct(*[F.col(c) for c in tracked])).over(w)
    cur_row = F.struct(*[F.col(c) for c in tracked])
    start = prev_i.isNull() | (prev_i != F.col("_i") - 1) | ~prev_row.eqNullSafe(cur_row)
    x = tagged.withColumn("_start", start.cast("int"))
    x = x.withColumn("_run", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ts_arr = F.array(*[F.lit(t).cast("timestamp_ntz") for t in times])
    g = x.groupBy(KEY, "_run").agg(F.min("_i").alias("_first"), F.max("_i").alias("_last"),
                                   *[F.first(c).alias(c) for c in tracked])
    end = F.when(F.col("_last") + 1 < len(times), F.element_at(ts_arr, F.col("_last") + 2))
    return g.select(KEY, *tracked, F.element_at(ts_arr, F.col("_first") + 1).alias("valid_from"),
                    end.alias("valid_to"), end.isNull().alias("is_active"))


def asof(history: DataFrame, t: str) -> DataFrame:
    """Versions valid at ``t``: valid_from <= t < valid_to (open end = now)."""
    tt = F.lit(t).cast("timestamp_ntz")
    return history.where((F.col("valid_from") <= tt) & (F.col("valid_to").isNull() | (tt < F.col("valid_to"))))


def latest(history: DataFrame) -> DataFrame:
    """Newest version of every key (row_number = 1; Spark plans the
    per-key top-1 as a WindowGroupLimit before the shuffle)."""
    w = Window.partitionBy(KEY).orderBy(F.col("valid_from").desc())
    return history.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def theme_split(history: DataFrame) -> dict[str, DataFrame]:
    """Five vertical projections sharing key and validity."""
    return {t: history.select(KEY, *cols, *VALIDITY) for t, cols in THEMES.items()}


def star_join_active(themes: dict[str, DataFrame]) -> DataFrame:
    """The ML view: inner joins of the active rows of every theme on the key."""
    parts = [df.where("is_active").drop(*VALIDITY) for df in themes.values()]
    return reduce(lambda a, b: a.join(b, KEY), parts)


def write_history(history: DataFrame, path: str) -> str:
    """Store the history partitioned by ``is_active``: readers of the current
    state prune to the active partition (PartitionFilters), readers of the
    past read the closed partition."""
    history.write.mode("overwrite").partitionBy("is_active").parquet(path)
    return path


def read_active(spark, path: str, schema) -> DataFrame:
    """Active versions only; with the stored schema the partition column
    keeps its boolean type and the filter prunes directories."""
    return spark.read.schema(schema).parquet(path).where(F.col("is_active"))
