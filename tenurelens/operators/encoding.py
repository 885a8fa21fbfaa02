"""The full feature matrix: ordinal ranks, dummies (first level dropped,
projects too), target-encoded categories and min-max scaling.

Fit and transform are apart, as in Spark ML.  ``fit`` returns what is learnt
from a cohort (levels, target sums, bounds); ``training`` encodes the rows it
was fitted on, leaving each row's own target out; ``inference`` encodes any
rows by the stored sums.  Levels and bounds enter a plan as literals; target
sums, one row per category, are joined, broadcast only below a checked number
of categories.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import ORDINAL_MAPPINGS
from .attributes import project
from .features import minmax_apply, minmax_bounds, minmax_fit, one_hot, one_hot_levels, ordinal_encode, small_join

DURATION, EVENT, KEY = "years_at_company", "attrition", "emp_key"
NUMERIC = ("age", "monthly_income", "total_working_years", "years_with_curr_manager")
ORDINAL = {"job_level": "JobLevel", "business_travel": "BusinessTravel", "work_life_balance": "WorkLifeBalance",
           "job_satisfaction": "JobSatisfaction"}
DUMMIES = {"gender": "Gender", "marital_status": "MaritalStatus", "over_time": "OverTime", "department": "Department",
           "project": "Project"}
TARGET_ENCODED = ("job_role", "education_field")


@dataclass
class Encoders:
    levels: dict[str, list[str]]  # dummy prefix: sorted levels
    target: DataFrame  # feature, category, t_sum, t_count
    mean: float  # of the target
    bounds: dict[str, tuple[float | None, float | None]]

    @property
    def features(self) -> list[str]:
        return [*NUMERIC, *ORDINAL, *TARGET_ENCODED, *(f"{p}_{v}" for p, some in self.levels.items() for v in some[1:])]


def with_attributes(cohort: DataFrame) -> DataFrame:
    """The complete rows of the cohort (no attribute missing, labels known)
    with the attributes derived from others: project, and years with the
    manager where the rows have none."""
    add = {"project": project(F.col("department"), F.col("job_role"), F.col("job_level"), F.col("employee_id"))}
    if "years_with_curr_manager" not in cohort.columns:
        add["years_with_curr_manager"] = F.col(DURATION) % 12
    known = cohort.dropna(subset=[c for c in (DURATION, EVENT, *NUMERIC, *DUMMIES, *TARGET_ENCODED) if c in cohort.columns])
    for c, name in ORDINAL.items():
        known = known.where(F.col(c).isin(*ORDINAL_MAPPINGS[name]))
    return known.withColumns(add)


def _encoded(cohort: DataFrame, levels: dict[str, list[str]], target: dict[str, Column]) -> DataFrame:
    numbers = {c: F.col(c).cast("double") for c in NUMERIC}
    ranks = {c: ordinal_encode(F.col(c), name).cast("double") for c, name in ORDINAL.items()}
    dummies = one_hot(cohort, DUMMIES, levels)
    names = [f"{p}_{v}" for p, some in levels.items() for v in some[1:]]
    return dummies.select(KEY, DURATION, EVENT, *[v.alias(f"x_{c}") for c, v in {**numbers, **ranks, **target}.items()],
                          *[F.col(f"`{c}`").cast("double").alias(f"x_{c}") for c in names])


def _target_columns(rows: DataFrame, target: DataFrame) -> DataFrame:
    for c in TARGET_ENCODED:
        one = target.where(F.col("feature") == c).select(F.col("category").alias(c), F.col("t_sum").alias(f"s_{c}"),
                                                         F.col("t_count").alias(f"n_{c}"))
        rows = small_join(rows, one, c)
    return rows


def fit(cohort: DataFrame) -> tuple[Encoders, DataFrame]:
    """(encoders, scaled training rows): emp_key, duration, event and a column
    ``x_<feature>`` per feature."""
    rows = with_attributes(cohort)
    levels = {DUMMIES[c]: some for c, some in one_hot_levels(rows, list(DUMMIES)).items()}
    stacked = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("category")) for c in TARGET_ENCODED]))
    target = (rows.select(stacked.alias("k"), F.col(EVENT).alias("y")).groupBy("k.feature", "k.category")
              .agg(F.sum("y").cast("double").alias("t_sum"), F.count(F.lit(1)).alias("t_count")))
    mean = rows.agg(F.avg(F.col(EVENT).cast("double"))).first()[0]
    left_out = {c: F.when(F.col(f"n_{c}") > 1, (F.col(f"s_{c}") - F.col(EVENT)) / (F.col(f"n_{c}") - 1)).otherwise(F.lit(mean))
                for c in TARGET_ENCODED}
    enc = Encoders(levels, target, mean, {})
    trained = _encoded(_target_columns(rows, target), levels, left_out)
    columns = [f"x_{c}" for c in enc.features]
    # dots in a level's name would read as fields
    plain = trained.toDF(*[c.replace(".", "_") for c in trained.columns])
    columns = [c.replace(".", "_") for c in columns]
    bounds = minmax_bounds(minmax_fit(plain, columns), columns)
    enc.bounds = {f: bounds[c] for f, c in zip(enc.features, columns, strict=True)}
    return enc, minmax_apply(plain, bounds, columns)


def inference(cohort: DataFrame, enc: Encoders) -> DataFrame:
    """Any rows encoded by the stored sums and bounds: unseen and singleton
    categories take the mean, unseen levels have no dummy."""
    rows = _target_columns(with_attributes(cohort), enc.target)
    known = {c: F.when(F.col(f"n_{c}") > 1, F.col(f"s_{c}") / F.col(f"n_{c}")).otherwise(F.lit(enc.mean)) for c in TARGET_ENCODED}
    out = _encoded(rows, enc.levels, known)
    out = out.toDF(*[c.replace(".", "_") for c in out.columns])
    return minmax_apply(out, {f"x_{c.replace('.', '_')}": b for c, b in enc.bounds.items()},
                        [f"x_{c.replace('.', '_')}" for c in enc.bounds])
