"""Survival estimation and scoring.

* risk set / Nelson–Aalen baseline: the per-time aggregate is taken first,
  so every cumulative step runs on *distinct times* (bounded by the time
  domain — months — not by the number of entities);
* horizon lookups reduce the curve to one value per horizon with
  ``min_by``/``max_by`` aggregates; these few numbers enter the entity side as
  literals (no join);
* scoring is a column expression (whole-stage codegen).
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import HORIZONS_MONTHS, THEME_EXACT, THEME_PREFIX
from .features import minmax_apply, minmax_fit, ordinal_encode

SERIES_FROM = 32  # from here on the series below is exact in double precision


def tie_smoothed_increment(n: Column, d: Column) -> Column:
    """sum_{i=0}^{d-1} 1 / (n - i): the hazard step with tied events smoothed.

    That is H(n) - H(n - d) of the harmonic numbers, by one rule at every
    size: the terms up to ``SERIES_FROM`` are added, the rest is the logarithm
    of the ratio plus the differences of the Euler-Maclaurin terms.
    """
    m = n - d
    top = F.greatest(m, F.least(n, F.lit(SERIES_FROM)))
    terms = F.aggregate(F.array(*[F.lit(i) for i in range(1, SERIES_FROM + 1)]), F.lit(0.0),
                        lambda acc, i: acc + F.when((i > m) & (i <= top), 1.0 / i).otherwise(0.0))

    def tail(k: Column) -> Column:
        x = 1.0 / k.cast("double")
        return x / 2 - x * x / 12 + F.pow(x, 4) / 120 - F.pow(x, 6) / 252

    rest = F.log1p((n - top) / top) + tail(n) - tail(top)
    return F.when(d <= 0, F.lit(0.0)).otherwise(terms + rest)


def risk_set(df: DataFrame, time: str = "years_at_company", event: str = "attrition") -> DataFrame:
    """Entities at risk and events at each distinct time (plus the origin).

    The per-time aggregate is combined map-side; the reverse cumulative sum
    then runs over the distinct times only (a window without partition over
    a table bounded by the time domain).
    """
    per_t = df.groupBy(F.col(time).cast("double").alias("t")).agg(
        F.count(F.lit(1)).alias("n_t"), F.sum(F.col(event).cast("bigint")).alias("d"))
    origin = df.sparkSession.range(1).select(F.lit(0.0).alias("t"), F.lit(0).cast("bigint").alias("n_t"),
                                             F.lit(0).cast("bigint").alias("d"))
    per_t = per_t.unionByName(origin).groupBy("t").agg(F.sum("n_t").alias("n_t"), F.sum("d").alias("d"))
    w = Window.orderBy(F.col("t").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return per_t.select("t", F.sum("n_t").over(w).alias("n_at_risk"), F.col("d").alias("d"))


def nelson_aalen(df: DataFrame, time: str = "years_at_company", event: str = "attrition") -> DataFrame:
    """Baseline cumulative hazard H(t) and survival S0(t) = exp(-H(t))."""
    rs = risk_set(df, time, event)
    rs = rs.withColumn("h", tie_smoothed_increment(F.col("n_at_risk"), F.col("d")))
    w = Window.orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (rs.withColumn("cum_hazard", F.sum("h").over(w))
            .withColumn("s0", F.exp(-F.col("cum_hazard"))))


# ---------------------------------------------------------------------------
# as-of lookups on the curve
# ---------------------------------------------------------------------------
def nearest_lookup(curve: DataFrame, horizons=HORIZONS_MONTHS) -> DataFrame:
    """One row: for each horizon the curve point closest in time (ties → the
    earlier point), as columns ``t_h{h}`` and ``s0_h{h}``."""
    aggs = []
    for h in horizons:
        key = F.struct(F.abs(F.col("t") - F.lit(float(h))), F.col("t"))
        aggs += [F.min_by("t", key).alias(f"t_h{h}"), F.min_by("s0", key).alias(f"s0_h{h}")]
    return curve.agg(*aggs)


def interp_lookup(curve: DataFrame, horizons=HORIZONS_MONTHS) -> DataFrame:
    """One row: linear interpolation of S0 at each horizon; 1.0 left of the
    first point, the last value right of the last point."""
    aggs = []
    for h in horizons:
        hl = F.lit(float(h))
        le, ge = F.col("t") <= hl, F.col("t") >= hl
        aggs += [F.max_by(F.when(le, F.col("t")), F.when(le, F.col("t"))).alias(f"lo_t{h}"),
                 F.max_by(F.when(le, F.col("s0")), F.when(le, F.col("t"))).alias(f"lo_s{h}"),
                 F.min_by(F.when(ge, F.col("t")), F.when(ge, F.col("t"))).alias(f"hi_t{h}"),
                 F.min_by(F.when(ge, F.col("s0")), F.when(ge, F.col("t"))).alias(f"hi_s{h}")]
    aggs.append(F.max_by("s0", "t").alias("last_s0"))
    r = curve.agg(*aggs)
    outs = []
    for h in horizons:
        lo_t, lo_s, hi_t, hi_s = (F.col(f"lo_t{h}"), F.col(f"lo_s{h}"), F.col(f"hi_t{h}"), F.col(f"hi_s{h}"))
        val = (F.when(lo_t.isNull(), F.lit(1.0))
               .when(hi_t.isNull(), F.col("last_s0"))
               .when(hi_t == lo_t, lo_s)
               .otherwise(lo_s + (hi_s - lo_s) * (F.lit(float(h)) - lo_t) / (hi_t - lo_t)))
        outs.append(val.alias(f"s0_h{h}"))
    return r.select(*outs)


# ---------------------------------------------------------------------------
# scoring with a fixed coefficient table
# ---------------------------------------------------------------------------
# FIXED VALUES — coefficients of the reference-free scoring model used to
# make every downstream key checkable without a trained model (feature → beta
# on min-max scaled features).
FIXED_COEFFICIENTS = {
    "age": -0.8,
    "monthly_income": -1.2,
    "job_level": -0.6,
    "over_time_yes": 0.9,
    "business_travel": 0.5,
    "work_life_balance": -0.7,
    "job_satisfaction": -0.9,
}
# FIXED VALUES — intercept of the scoring model (shifts every multiplier so
# that 6/12-month probabilities spread over (0, 1) on the driver's data)
FIXED_INTERCEPT = 7.0
def theme_of(feature: str) -> str:
    """Theme of a feature name by the fixed rule: exact names, then name
    prefixes (case and underscores ignored); anything else is tenure."""
    name = feature.lower().replace("_", "")
    for theme, names in THEME_EXACT.items():
        if name in names:
            return theme
    for theme, prefixes in THEME_PREFIX.items():
        if any(name.startswith(pfx) for pfx in prefixes):
            return theme
    return "tenure"


# theme of each scoring feature, by the fixed naming rule
FEATURE_THEME = {f: theme_of(f) for f in FIXED_COEFFICIENTS}
SCORE_FEATURES = tuple(FIXED_COEFFICIENTS)


def feature_matrix(cohort: DataFrame) -> DataFrame:
    """Numeric features of the scoring model (before scaling)."""
    return cohort.select(
        "*",
        F.col("age").cast("double").alias("f_age"),
        F.col("monthly_income").alias("f_monthly_income"),
        F.col("job_level_rank").cast("double").alias("f_job_level"),
        (F.col("over_time") == "Yes").cast("double").alias("f_over_time_yes"),
        ordinal_encode(F.col("business_travel"), "BusinessTravel").cast("double").alias("f_business_travel"),
        ordinal_encode(F.col("work_life_balance"), "WorkLifeBalance").cast("double").alias("f_work_life_balance"),
        ordinal_encode(F.col("job_satisfaction"), "JobSatisfaction").cast("double").alias("f_job_satisfaction"),
    )


def scaled_features(cohort: DataFrame, fit: DataFrame | None = None) -> DataFrame:
    """Features min-max scaled on ``fit`` (default: the cohort itself)."""
    fm = feature_matrix(cohort)
    cols = [f"f_{c}" for c in SCORE_FEATURES]
    stats = minmax_fit(feature_matrix(fit) if fit is not None else fm, cols)
    return minmax_apply(fm, stats, cols, suffix="")


def margin_expr() -> Column:
    return sum((F.col(f"f_{c}") * F.lit(b) for c, b in FIXED_COEFFICIENTS.items()), F.lit(FIXED_INTERCEPT))


def score(cohort: DataFrame, fit: DataFrame | None = None) -> DataFrame:
    """Adds ``margin`` (log partial hazard) to the cohort."""
    return scaled_features(cohort, fit).withColumn("margin", margin_expr())


def multiplier(margin: Column, clip: float = 15.0) -> Column:
    return F.exp(F.least(F.greatest(margin, F.lit(-clip)), F.lit(clip)))


def horizon_probabilities(scored: DataFrame, curve: DataFrame, kind: str = "nearest",
                          horizons=HORIZONS_MONTHS, clip: float | None = None,
                          extra_multiplier: Column | None = None) -> DataFrame:
    """Adds ``prob_{h}m`` columns (and ``general_risk_score`` = 100 * last).

    ``nearest``: production writer, margin clipped to +-15;
    ``interp``: interpolated curve, margin clipped to +-20, clamped to [0, 1].
    """
    if kind == "nearest":
        look, clip = nearest_lookup(curve, horizons), clip or 15.0
    else:
        look, clip = interp_lookup(curve, horizons), clip or 20.0
    m = multiplier(F.col("margin"), clip)
    if extra_multiplier is not None:
        m = m * extra_multiplier
    outs = {}
    row = look.first()  # one row: S0 at each horizon (fit step)
    for h in horizons:
        s0 = F.lit(float(row[f"s0_h{h}"]))
        p = 1.0 - F.pow(s0, m)
        if kind != "nearest":
            p = F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))
        outs[f"prob_{h}m"] = p
    res = scored.withColumns(outs)
    return res.withColumn("general_risk_score", F.col(f"prob_{horizons[-1]}m") * 100.0)


def individual_curves(scored: DataFrame, curve: DataFrame, clip: float = 20.0) -> DataFrame:
    """S_i(t) = S0(t) ** exp(clip(margin)) at every curve time.

    The curve (bounded by the time domain) travels as one array-valued scalar
    subquery and is exploded per entity: output is entities x curve points,
    produced without a join.
    """
    pts = curve.agg(F.array_sort(F.collect_list(F.struct("t", "s0"))).alias("pts")).select("pts").scalar()
    m = multiplier(F.col("margin"), clip)
    return (scored.select("emp_key", "employee_id", m.alias("_m"), F.explode(pts).alias("p"))
            .select("emp_key", "employee_id", F.col("p.t").alias("t"),
                    F.pow(F.col("p.s0"), F.col("_m")).alias("survival")))


def mean_curves(scored: DataFrame, curve: DataFrame, group: str, clip: float = 20.0) -> DataFrame:
    """(group, t, mean_survival): individual curves summed as whole vectors.

    A task turns its rows into sums of curves, one vector per group, so that
    tasks x groups x times numbers are shuffled and no row per entity and time.
    """
    points = sorted((p["t"], p["s0"]) for p in curve.select("t", "s0").collect())  # bounded by the time domain
    t, s0 = np.array([p[0] for p in points]), np.array([p[1] for p in points])

    def run(batches):
        sums: dict = {}
        for batch in batches:
            names = np.array(batch[group].to_pylist(), dtype=object)
            m = batch["_m"].to_numpy()
            for name in set(names.tolist()):
                mine = m[names == name]
                total = sum(np.power(s0[None, :], part[:, None]).sum(axis=0) for part in np.array_split(mine, len(mine) // 4096 + 1))
                old = sums.get(name, (0.0, 0))
                sums[name] = old[0] + total, old[1] + len(mine)
        for name, (total, n) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(t), pa.string()), pa.array(t), pa.array(total), pa.array([n] * len(t), pa.int64())],
                                             names=[group, "t", "total", "n"])

    rows = scored.select(F.col(group).cast("string").alias(group), multiplier(F.col("margin"), clip).alias("_m"))
    return (rows.mapInArrow(run, f"{group} string, t double, total double, n long").groupBy(group, "t")
            .agg((F.sum("total") / F.sum("n")).alias("mean_survival")))


# ---------------------------------------------------------------------------
# theme contributions
# ---------------------------------------------------------------------------
def theme_contributions(scaled: DataFrame) -> DataFrame:
    """Share (%) of each theme in the positive beta*x terms; 20 each if none.

    The coefficient table is a literal (7 features), so the unpivot → join →
    pivot of the reference collapses into column arithmetic per row.
    """
    themes = ("identity", "environment", "compensation", "sentiment", "tenure")
    parts = {t: F.lit(0.0) for t in themes}
    for feat, beta in FIXED_COEFFICIENTS.items():
        term = F.col(f"f_{feat}") * F.lit(beta)
        parts[FEATURE_THEME.get(feat, "tenure")] = parts[FEATURE_THEME.get(feat, "tenure")] + F.greatest(term, F.lit(0.0))
    total = sum(parts.values(), F.lit(0.0))
    outs = {f"contrib_{t}": F.when(total > 0, parts[t] / total * 100.0).otherwise(F.lit(20.0)) for t in themes}
    return scaled.withColumns(outs)
