"""Invariants on the sf0.01 outputs."""
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as E

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def q():
    return E.queries()


def test_one_active_version_per_key_and_no_overlap(spark, q):
    h = q["scd2_build"](spark, SF)
    assert h.where("is_active").groupBy("emp_key").count().where("count > 1").count() == 0
    w = Window.partitionBy("emp_key").orderBy("valid_from")
    nxt = h.withColumn("next_from", F.lead("valid_from").over(w))
    assert nxt.where(F.col("next_from").isNotNull() & (F.col("valid_to").isNull()
                                                      | (F.col("valid_to") > F.col("next_from")))).count() == 0
    assert h.where(F.col("valid_to").isNotNull() & (F.col("valid_to") <= F.col("valid_from"))).count() == 0


def test_apply_equals_build_for_two_snapshots(spark, q):
    a = q["scd2_apply"](spark, SF)
    assert a.where("is_active").groupBy("emp_key").count().where("count > 1").count() == 0


def test_edges_unique_and_manager_edges_symmetric(spark, q):
    for key in ("edges_same_manager", "edges_same_role", "edges_same_tenure"):
        e = q[key](spark, SF)
        assert e.groupBy("src", "dst").count().where("count > 1").count() == 0
        assert e.where("src = dst").count() == 0
    m = q["edges_same_manager"](spark, SF).select("src", "dst")
    rev = m.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    assert m.exceptAll(rev).count() == 0


def test_probabilities_bounded_and_monotonic(spark, q):
    r = q["horizon_monotonic"](spark, SF).first()
    assert r.out_of_bounds == 0 and r.non_monotonic == 0 and r.all_ok


def test_contributions_sum_to_100(spark, q):
    c = q["theme_contributions"](spark, SF)
    tot = sum(F.col(x) for x in c.columns if x.startswith("contrib_"))
    assert c.where(F.abs(tot - 100.0) > 1e-4).count() == 0


def test_rollup_total_equals_department_sum(spark, q):
    rows = q["department_rollup"](spark, SF).collect()
    total = [x for x in rows if x.is_total == 1][0]
    assert total.headcount == sum(x.headcount for x in rows if x.is_total == 0)
    assert total.high_risk_count == sum(x.high_risk_count for x in rows if x.is_total == 0)
