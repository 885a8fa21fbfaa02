"""Data-quality rules evaluated in one aggregate pass.

Every rule becomes a ``count_if`` in a single ``agg`` (one scan, partial
aggregation, a one-row result), unpivoted into (rule, violations) rows.
Strict mode raises on any violation, as the reference's guards do.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class DataQualityError(ValueError):
    pass


def dq_report(df: DataFrame, required: list[str], consistency: list[tuple[str, str]],
              domains: dict[str, tuple], strict: bool = False) -> DataFrame:
    """Rows (rule, violations) for: row count, empty table, columns that are
    missing (1 each, 0 if there), NULLs per required column, ``a <= b``
    consistency, domain membership.  Rules over a missing column are left
    out but for that one."""
    absent = missing_columns(df, [*required, *(c for pair in consistency for c in pair), *domains])
    rules: list[tuple[str, Column]] = [("row_count", F.count(F.lit(1))), ("empty_table", F.when(F.count(F.lit(1)) == 0, 1).otherwise(0).cast("long"))]
    for c in dict.fromkeys([*required, *absent]):
        rules.append((f"missing:{c}", F.lit(int(c in absent)).cast("long")))
    required = [c for c in required if c not in absent]
    consistency = [p for p in consistency if not set(p) & set(absent)]
    domains = {c: v for c, v in domains.items() if c not in absent}
    for c in required:
        rules.append((f"null:{c}", F.count_if(F.col(c).isNull())))
    for a, b in consistency:
        rules.append((f"order:{a}<={b}", F.count_if(F.col(a) > F.col(b))))
    for c, allowed in domains.items():
        rules.append((f"domain:{c}", F.count_if(F.col(c).isNotNull() & ~F.col(c).cast("string").isin(*allowed))))
    agg = df.agg(*[e.alias(f"r{i}") for i, (_, e) in enumerate(rules)])
    stack = ", ".join(f"'{name}', r{i}" for i, (name, _) in enumerate(rules))
    out = agg.selectExpr(f"stack({len(rules)}, {stack}) AS (rule, violations)")
    if strict:
        bad = out.where((F.col("rule") != "row_count") & (F.col("violations") > 0)).limit(1).collect()
        if bad:
            raise DataQualityError(f"data-quality rule failed: {bad[0]['rule']}")
    return out


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    """Schema check (no data touched)."""
    have = {c.lower() for c in df.columns}
    return [c for c in required if c.lower() not in have]


def horizon_monotonic(scores: DataFrame, cols=("prob_1m", "prob_3m", "prob_6m", "prob_12m"),
                      tolerance: float = 0.01) -> DataFrame:
    """Counts of rows whose probability falls by more than ``tolerance`` from
    one horizon to the next, and of probabilities outside [0, 1]."""
    drops = F.lit(False)
    for a, b in zip(cols, cols[1:]):
        drops = drops | (F.col(b) < F.col(a) - tolerance)
    bounds = F.lit(False)
    for c in cols:
        bounds = bounds | (F.col(c) < 0) | (F.col(c) > 1)
    return scores.agg(F.count(F.lit(1)).alias("rows"),
                      F.count_if(drops).alias("non_monotonic"),
                      F.count_if(bounds).alias("out_of_bounds"),
                      F.coalesce(F.bool_and(~drops & ~bounds), F.lit(True)).alias("all_ok"))
