"""Lenient CSV scan: quotes, any separator, short and over-long lines; mended rules."""
import uuid

from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenurelens.operators import graph, whatif
from tenurelens.plans.q_analytics import concordance_gap
from tenurelens.plans.q_io import surrogate_keys
from tenurelens.operators.models import PAY_WORDS
from tenurelens.plans.q_warehouse import apply_actions
from tenurelens.session import ensure_checkpoint_dir
from tenurelens.sources.csv_scan import lenient_csv

SCHEMA = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType())])


def _scan(spark, lines, **options):
    path = ensure_checkpoint_dir(spark) + f"/csv_{uuid.uuid4().hex}"
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    return sorted((tuple(r) for r in lenient_csv(spark, path, SCHEMA, **options).collect()), key=str)


def test_quoted_separators_and_bad_values(spark):
    got = _scan(spark, ['1,"Sales, EMEA"', 'x,"a, b"', "2,b,extra", "3", "", '4,"say \\", so"', "5,,", "6,"])
    assert got == sorted([(1, "Sales, EMEA"), (None, "a, b"), (3, None), (4, 'say ", so'), (6, None)], key=str)


def test_separator_is_not_a_pattern(spark):
    assert _scan(spark, ["1|ok", "y|ok", "2|a|b"], sep="|") == [(1, "ok"), (None, "ok")]
    assert _scan(spark, ["k||v", "1||a,b", "2||c||d"], sep="||", header=True) == [(1, "a,b")]


def test_only_lines_are_counted(spark):
    path = ensure_checkpoint_dir(spark) + f"/csv_{uuid.uuid4().hex}"
    spark.createDataFrame([("1,a",), ("2,b,c",)], "value string").write.text(path)
    assert lenient_csv(spark, path, SCHEMA).count() == 1


def test_actions_update_their_own_columns(spark):
    people = spark.createDataFrame([Row(emp_key=1, job_role="r", job_level_rank=2, monthly_income=100.0, over_time="No",
                                        years_with_curr_manager=4), Row(emp_key=2, job_role="r", job_level_rank=2,
                                        monthly_income=50.0, over_time="No", years_with_curr_manager=1)])
    people = people.withColumn("job_level_rank", F.col("job_level_rank").cast("int"))
    schema = ("emp_key long, action string, action_ts timestamp_ntz, job_role string, job_level_rank int, "
              "monthly_income double, over_time string, years_with_curr_manager long, percent_salary_hike double")
    rows = [(1, "promote", "2000-01-01", "Lead", 3, 200.0, None, None, None),
            (1, "overtime", "2000-02-01", None, None, None, "Yes", None, None),
            (1, "salary_hike", "2000-03-01", None, None, None, None, None, 10.0),
            (1, "salary_hike", "2000-04-01", None, None, None, None, None, 0.5),
            (1, "manager_change", "2000-05-01", None, None, None, None, 0, None)]
    actions = spark.createDataFrame(rows, schema.replace("timestamp_ntz", "string")).withColumn(
        "action_ts", F.col("action_ts").cast("timestamp_ntz"))
    got = {r.emp_key: tuple(r)[1:] for r in apply_actions(people, actions).collect()}
    assert got[1] == ("Lead", 3, 221.1, "Yes", 0, 0.5, 5)  # promotion and overtime both kept
    assert got[2] == ("r", 2, 50.0, "No", 1, None, 0)


def test_negative_gap_is_flagged(spark):
    df = spark.createDataFrame([(0.6, 0.8), (0.8, 0.78)], "c_train double, c_test double")
    assert [(round(r.gap, 6), r.overfit_flag) for r in concordance_gap(df).collect()] == [(0.2, True), (0.02, False)]


def test_caps_apply_to_pay_cuts_only(spark, monkeypatch):
    people = spark.createDataFrame([(1, 100.0, 120.0, "Entry Level"), (2, 100.0, 50.0, "Entry Level")],
                                   "emp_key long, monthly_income double, asked double, job_level string")
    monkeypatch.setattr(whatif, "score", lambda df, fit: df)
    monkeypatch.setattr(whatif, "nelson_aalen", lambda df: None)
    monkeypatch.setattr(whatif, "horizon_probabilities", lambda df, curve, extra_multiplier: df.withColumns(
        {f"prob_{h}m": F.lit(0.9999) for h in (1, 3, 6, 12)} | {"general_risk_score": F.lit(99.99)}))
    asked = people.select("emp_key", F.col("asked").alias("monthly_income"))
    got = {r.emp_key: (r.prob_12m, r.general_risk_score) for r in whatif.whatif(people.drop("asked"), asked).collect()}
    assert got == {1: (0.9999, 99.99), 2: (0.999, 100.0)}


def test_overrides_reach_all_fields_and_keep_other_rows(spark):
    people = spark.createDataFrame([(i, 100.0, "No", 4, "r", "Entry Level") for i in range(6)],
                                   "emp_key long, monthly_income double, over_time string, "
                                   "years_with_curr_manager long, job_role string, job_level string")
    asked = spark.createDataFrame([(0, 65.0, None, None, None, None), (1, None, "Yes", None, None, None),
                                   (2, None, None, 0, None, None), (3, None, None, None, "x", None),
                                   (4, None, None, None, None, "Senior Level")], people.schema)
    got = {r.emp_key: (r.old_income, r.monthly_income, r.over_time, r.years_with_curr_manager, r.job_role, r.job_level_rank)
           for r in whatif.apply_overrides(people, asked).collect()}
    assert got == {0: (100.0, 65.0, "No", 4, "r", 1), 1: (100.0, 100.0, "Yes", 4, "r", 1),
                   2: (100.0, 100.0, "No", 0, "r", 1), 3: (100.0, 100.0, "No", 4, "x", 1),
                   4: (100.0, 100.0, "No", 4, "r", 4), 5: (100.0, 100.0, "No", 4, "r", 1)}


def test_every_row_is_numbered(spark):
    rows = spark.range(10).select((F.col("id") * 40_000).alias("k"))
    got = [(r.k, r.employee_code) for r in surrogate_keys(rows, "k").orderBy("k").collect()]
    assert got == [(i * 40_000, f"EMP_{i + 1:04d}") for i in range(10)]
    assert surrogate_keys(rows, "k", first=3).count() == 3


def test_depths_reach_every_node_and_refuse_cycles(spark):
    import pytest
    chain = [("n0", "")] + [(f"n{i}", f"n{i - 1}") for i in range(1, 12)]
    got = {r.id: r.depth for r in graph.tree_depths(spark.createDataFrame(chain, "id string, manager_id string")).collect()}
    assert got == {f"n{i}": i for i in range(12)}
    with pytest.raises(ValueError):
        graph.tree_depths(spark.createDataFrame([("r", ""), ("a", "b"), ("b", "a")], "id string, manager_id string"))


def test_pay_words():
    assert PAY_WORDS == ("income", "salary", "rate", "daily", "monthly", "hourly")


def test_one_hot_levels_on_one_side_only(spark):
    import pytest

    from tenurelens.operators.features import one_hot, one_hot_levels
    train = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", None)], "p string, q string")
    test = spark.createDataFrame([("b", "x"), ("z", "y")], "p string, q string")
    levels = one_hot_levels(train, ["p", "q"])
    assert levels == {"p": ["a", "b", "c"], "q": ["x"]}
    enc = one_hot(test, {"p": "P", "q": "Q"}, {"P": levels["p"], "Q": levels["q"]})
    assert enc.columns == ["p", "q", "P_b", "P_c"]
    assert [tuple(r)[2:] for r in enc.orderBy("p").collect()] == [(1, 0), (0, 0)]
    assert one_hot(test, {"q": "Q"}, {"Q": []}).columns == ["p", "q"]  # an empty fitted list is kept
    with pytest.raises(ValueError):
        one_hot_levels(train, ["p"], max_levels=2)
