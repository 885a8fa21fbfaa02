"""The ``cohort``: entity attributes derived from the driver's tables.

One row per customer that has orders.  Orders are aggregated per customer
first (partial aggregation map-side, so a customer holding a third of all
orders is combined before the shuffle), then joined to the customer table on
the key.  nation (25 rows) and region (5 rows) are fixed-size TPC-H
dimensions, so broadcasting them is bounded by the schema, not by the data.

Binding (reference concept → driver data):

* employee id / numeric key        c_name / c_custkey
* department, job role, field      c_mktsegment, r_name, n_name
* job level 1..5                   clamp(floor(c_acctbal / 2000) + 1, 1, 5)
* monthly income, age              avg(o_totalprice), 20 + number of orders
* overtime                         share of '1-URGENT' orders >= 0.25
* work-life balance                priority of the latest order (1..5)
* marital status                   status of the latest order
* business travel                  number of orders (<8, <12, else)
* job satisfaction, gender         derived from the key
* duration (months)                greatest(floor(days(first..last order)/30), 1)
* event / exit date                last order before 2000-08-01 → 1 / that date
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import scan

# FIXED VALUES — binding constants
EXIT_CUTOFF = "2000-08-01"
AS_OF_DATE = "2000-08-01"
LEVEL_NAMES = ("Entry Level", "Junior Level", "Mid Level", "Senior Level", "Executive Level")
BALANCE_NAMES = ("Bad", "Low", "Good", "Better", "Best")
SATISFACTION_NAMES = ("Low", "Medium", "High", "Very High")
MARITAL_BY_STATUS = {"F": "Married", "O": "Single", "P": "Divorced"}


def _label(idx: F.Column, names) -> F.Column:
    """names[idx - 1] as a CASE chain (stays in codegen)."""
    expr = None
    for i, name in enumerate(names, start=1):
        expr = F.when(idx == i, name) if expr is None else expr.when(idx == i, name)
    return expr


def order_profile(orders: DataFrame, *more: str) -> DataFrame:
    """Per-customer order aggregates (one shuffle on o_custkey, and on ``more``)."""
    latest = F.struct(F.col("o_orderdate"), F.col("o_orderkey"))
    return (orders.groupBy("o_custkey", *more).agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.avg("o_totalprice").alias("avg_price"),
        F.min(F.to_date("o_orderdate")).alias("first_date"),
        F.max(F.to_date("o_orderdate")).alias("last_date"),
        F.avg(F.when(F.col("o_orderpriority") == "1-URGENT", 1.0).otherwise(0.0)).alias("urgent_share"),
        F.max_by(F.col("o_orderpriority"), latest).alias("latest_priority"),
        F.max_by(F.col("o_orderstatus"), latest).alias("latest_status"),
    ))


def build_cohort(customer: DataFrame, orders: DataFrame, nation: DataFrame,
                 region: DataFrame) -> DataFrame:
    return cohort_of(customer, order_profile(orders.select(*ORDER_COLUMNS)), nation, region)


ORDER_COLUMNS = ("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate", "o_orderpriority", "o_orderstatus")


def versions_cohort(customer: DataFrame, orders: DataFrame, nation: DataFrame, region: DataFrame, versions: DataFrame) -> DataFrame:
    """The cohort as each version of ``versions`` (emp_key, valid_from) found
    it: attributes from the orders before the version's start."""
    before = (orders.select(*ORDER_COLUMNS).join(versions, F.col("o_custkey") == F.col("emp_key"))
              .where(F.col("o_orderdate") < F.col("valid_from")))
    return cohort_of(customer, order_profile(before, "valid_from"), nation, region, "valid_from")


def cohort_of(customer: DataFrame, prof: DataFrame, nation: DataFrame, region: DataFrame, *more: str) -> DataFrame:
    geo = F.broadcast(nation.select("n_nationkey", "n_name", "n_regionkey")
                      .join(F.broadcast(region.select("r_regionkey", "r_name")),
                            F.col("n_regionkey") == F.col("r_regionkey")))
    c = customer.select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    j = (c.join(prof, c.c_custkey == prof.o_custkey)
         .join(geo, F.col("c_nationkey") == F.col("n_nationkey")))
    level = F.least(F.greatest(F.floor(F.col("c_acctbal") / 2000) + 1, F.lit(1)), F.lit(5)).cast("int")
    months = F.floor(F.datediff("last_date", "first_date") / 30).cast("bigint")
    event = (F.col("last_date") < F.lit(EXIT_CUTOFF).cast("date")).cast("int")
    prio = F.substring("latest_priority", 1, 1).cast("int")
    marital = None
    for k, v in MARITAL_BY_STATUS.items():
        cond = F.col("latest_status") == k
        marital = F.when(cond, v) if marital is None else marital.when(cond, v)
    return j.select(
        F.col("c_custkey").alias("emp_key"),
        F.col("c_name").alias("employee_id"),
        F.col("c_mktsegment").alias("department"),
        F.col("r_name").alias("job_role"),
        F.col("n_name").alias("education_field"),
        level.alias("job_level_rank"),
        _label(level, LEVEL_NAMES).alias("job_level"),
        F.when(F.col("c_custkey") % 2 == 0, "Female").otherwise("Male").alias("gender"),
        marital.alias("marital_status"),
        (F.col("n_orders") + 20).alias("age"),
        F.col("avg_price").alias("monthly_income"),
        F.when(F.col("urgent_share") >= 0.25, "Yes").otherwise("No").alias("over_time"),
        F.when(F.col("n_orders") < 8, "Non-Travel").when(F.col("n_orders") < 12, "Travel_Rarely")
         .otherwise("Travel_Frequently").alias("business_travel"),
        _label(prio, BALANCE_NAMES).alias("work_life_balance"),
        _label((F.col("c_custkey") % 4 + 1).cast("int"), SATISFACTION_NAMES).alias("job_satisfaction"),
        F.greatest(months, F.lit(1).cast("bigint")).alias("years_at_company"),
        (F.greatest(months, F.lit(1).cast("bigint")) + F.col("c_custkey") % 7).alias("total_working_years"),
        event.alias("attrition"),
        F.when(event == 1, F.date_format("last_date", "yyyy-MM-dd")).alias("date_of_leaving"),
        F.col("first_date").alias("hire_date"),
        F.col("last_date").alias("last_active_date"),
        *more,
    )


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_cohort(scan(spark, sf_dir, "customer"), scan(spark, sf_dir, "orders"),
                        scan(spark, sf_dir, "nation"), scan(spark, sf_dir, "region"))
