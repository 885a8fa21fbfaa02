"""Exact grouped quantiles (linear interpolation, numpy/quantile_cont rule)
without holding a group in one task.

Spark's exact ``percentile`` keeps every distinct value of a group in one
aggregation buffer.  Here values are first placed into buckets cut at
approximate per-group quantiles, where every split value also gets its own
"point" bucket: a value holding a third of the group lands in a point
bucket (constant, no sorting needed) and the open buckets between splits
hold about n/B rows each.  A target rank resolves to one bucket through the
per-bucket counts; only rows of non-constant target buckets are ranked.
The whole computation is one lazy plan of equi-joins and windows over
(group, bucket).
"""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

N_SPLITS = 64


def _split_level(x: DataFrame, keys: list[str], n_splits: int, out: str, broadcast_stats: bool) -> DataFrame:
    """Adds ``out``: 2j for values strictly between split j-1 and j, 2j+1 for
    a value equal to split j (a point bucket), with split points taken at
    approximate quantiles per ``keys`` group.  Monotone in the value."""
    sp = [i / n_splits for i in range(1, n_splits)]
    split_agg = F.array_distinct(F.array_sort(F.percentile_approx("_x", sp, 10_000)))
    if keys == ["_g"]:
        # one global group: the fitted split points (<= n_splits numbers) become a literal
        got = x.agg(split_agg).first()[0] or []
        xs = x.withColumn("_sp", F.array(*[F.lit(float(v)) for v in got]) if got
                          else F.array().cast("array<double>"))
    else:
        stats = x.groupBy(*keys).agg(split_agg.alias("_sp"))
        xs = x.join(F.broadcast(stats) if broadcast_stats else stats, keys)
    j = F.size(F.filter("_sp", lambda v: v < F.col("_x")))
    is_point = (j < F.size("_sp")) & (F.element_at("_sp", j + 1) == F.col("_x"))
    return xs.withColumn(out, F.when(is_point, j * 2 + 1).otherwise(j * 2)).drop("_sp")


def value_buckets(x: DataFrame, g: list[str], n_splits: int, ungrouped: bool) -> DataFrame:
    """Two nested levels of quantile buckets → ``_b`` (monotone in ``_x``):
    about n_splits² open buckets per group, so an open bucket of a group with
    billions of rows still fits one task, at ~2·n_splits comparisons a row."""
    x1 = _split_level(x, g, n_splits, "_b1", ungrouped)
    x2 = _split_level(x1, [*g, "_b1"], n_splits, "_b2", ungrouped)  # ungrouped: <= 2·n_splits+1 stats rows
    return x2.withColumn("_b", F.col("_b1") * (2 * n_splits + 1) + F.col("_b2")).drop("_b1", "_b2")


def grouped_quantiles(df: DataFrame, group: list[str], value: str, probs, n_splits: int = N_SPLITS,
                      prefix: str = "p", materialize: bool = True) -> DataFrame:
    """One row per group with columns ``{prefix}{round(100*p)}``."""
    g = list(group) if group else ["_g"]
    x = df.select(*group, F.col(value).cast("double").alias("_x")).where(F.col("_x").isNotNull())
    if not group:
        x = x.withColumn("_g", F.lit(0))
    if materialize and x.sparkSession.sparkContext.getCheckpointDir():
        # the input is read by several branches below; cut it to the
        # projected columns once instead of re-running its lineage per branch
        x = x.checkpoint(eager=True)
    stats = x.groupBy(*g).agg(F.count(F.lit(1)).alias("_n"))
    xb = value_buckets(x, g, n_splits, not group).select(*g, "_x", "_b")

    bk = xb.groupBy(*g, "_b").agg(F.count(F.lit(1)).alias("_cnt"), F.min("_x").alias("_lo"),
                                  F.max("_x").alias("_hi"))
    w = Window.partitionBy(*g).orderBy("_b")
    bk = bk.withColumn("_off", F.coalesce(F.sum("_cnt").over(w.rowsBetween(Window.unboundedPreceding, -1)),
                                          F.lit(0)))

    # target ranks (0-based): floor and ceil of (n-1)p for every p
    tgt = []
    for p in probs:
        pos = (F.col("_n") - 1) * F.lit(float(p))
        tgt += [F.struct(F.lit(float(p)).alias("p"), F.floor(pos).alias("r"), pos.alias("pos")),
                F.struct(F.lit(float(p)).alias("p"), F.ceil(pos).alias("r"), pos.alias("pos"))]
    targets = stats.select(*g, F.explode(F.array(*tgt)).alias("t")).select(*g, "t.p", "t.r", "t.pos").distinct()
    hit = targets.join(bk, g).where((F.col("r") >= F.col("_off")) & (F.col("r") < F.col("_off") + F.col("_cnt")))
    const = hit.where(F.col("_lo") == F.col("_hi")).select(*g, "p", "r", "pos", F.col("_lo").alias("v"))
    open_t = hit.where(F.col("_lo") != F.col("_hi")).select(*g, "_b", "p", "r", "pos", "_off")
    rows = xb.join(open_t.select(*g, "_b").distinct(), [*g, "_b"])
    rows = rows.withColumn("_rk", F.row_number().over(Window.partitionBy(*g, "_b").orderBy("_x")) - 1)
    ranked = open_t.join(rows, [*g, "_b"]).where(F.col("_rk") == F.col("r") - F.col("_off")).select(
        *g, "p", "r", "pos", F.col("_x").alias("v"))
    vals = const.unionByName(ranked)
    lo = vals.where(F.col("r") == F.floor("pos")).select(*g, "p", "pos", F.col("v").alias("vlo"))
    hi = vals.where(F.col("r") == F.ceil("pos")).select(*g, "p", F.col("v").alias("vhi"))
    q = lo.join(hi, [*g, "p"]).select(*g, "p", (F.col("vlo") + (F.col("vhi") - F.col("vlo"))
                                               * (F.col("pos") - F.floor("pos"))).alias("q"))
    aggs = [F.max(F.when(F.col("p") == F.lit(float(p)), F.col("q"))).alias(f"{prefix}{int(round(p * 100))}")
            for p in probs]
    out = q.groupBy(*g).agg(*aggs)
    return out if group else out.drop("_g")


BRACKET_ROWS = 100_000  # aimed at, inside the bracket of a quantile


def global_quantiles(df: DataFrame, value: str, probs) -> tuple[list[float | None], dict]:
    """(exact quantiles of all rows, {n, mean, min, max}).

    One pass finds values that bracket each wanted rank (approximate quantiles
    a little below and above it), a second counts the rows below each bracket,
    a third ranks the values inside, equal ones as one row with a number.  Only
    rows inside brackets are shuffled.  A bracket that misses its rank is widened.
    """
    x = df.select(F.col(value).cast("double").alias("x")).where("x IS NOT NULL")
    sums = x.agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.min("x").alias("min"), F.max("x").alias("max")).first().asDict()
    n = sums["n"]
    found: dict[int, float | None] = {i: None for i in range(len(probs))}
    open_, slack = list(found) if n else [], min(0.5, BRACKET_ROWS / max(n, 1) / 2)
    while open_:
        ends = [min(1.0, max(0.0, probs[i] + d)) for i in open_ for d in (-slack, slack)]
        at = x.agg(F.percentile_approx("x", ends, max(1_000, min(1_000_000, int(4 / slack)))).alias("q")).first()["q"]
        # a bracket that reaches an end of the ranks takes in the extreme value
        pairs = [(sums["min"] if ends[2 * k] <= 0 else at[2 * k], sums["max"] if ends[2 * k + 1] >= 1 else at[2 * k + 1]) for k in range(len(open_))]
        below = x.agg(*[F.count_if(F.col("x") < lo).alias(f"b{k}") for k, (lo, _) in enumerate(pairs)]).first()
        inside = F.array(*[F.when((F.col("x") >= lo) & (F.col("x") <= hi), F.lit(k)) for k, (lo, hi) in enumerate(pairs)])
        counts = (x.select("x", F.explode(F.array_compact(inside)).alias("k")).groupBy("k", "x").agg(F.count(F.lit(1)).alias("c"))
                  .withColumn("upto", F.sum("c").over(Window.partitionBy("k").orderBy("x"))))
        wanted = {(k, r): below[f"b{k}"] for k, i in enumerate(open_) for r in {math.floor((n - 1) * probs[i]), math.ceil((n - 1) * probs[i])}}
        hits = F.array(*[F.when((F.col("k") == k) & (F.lit(r - b) >= F.col("upto") - F.col("c")) & (F.lit(r - b) < F.col("upto")), F.lit(r))
                         for (k, r), b in wanted.items()])
        got = {(row.k, row.r): row.x for row in counts.select("k", "x", F.explode(F.array_compact(hits)).alias("r")).collect()}
        for k, i in enumerate(list(open_)):
            pos = (n - 1) * probs[i]
            if (k, math.floor(pos)) in got and (k, math.ceil(pos)) in got:
                lo, hi = got[k, math.floor(pos)], got[k, math.ceil(pos)]
                found[i] = lo + (hi - lo) * (pos - math.floor(pos))
                open_.remove(i)
        slack = min(0.5, slack * 8)
    return [found[i] for i in range(len(probs))], sums


def rows_at_ranks(df: DataFrame, value: str, tie_hex: str, ranks, n_splits: int = N_SPLITS) -> DataFrame:
    """The rows at 0-based global positions ``ranks`` of the order
    (value, tie_hex), where ``tie_hex`` is a hex digest column (e.g. md5 of
    the id).  Same bucketing as ``grouped_quantiles``: open buckets are
    ranked with a window over ~n/B rows; a point bucket (one value, possibly
    a third of all rows) is ranked by the hash-prefix group rank."""
    from .ranking import group_rank, hex_sub_bucket
    x = df.withColumn("_x", F.col(value).cast("double")).where(F.col("_x").isNotNull()).withColumn("_g", F.lit(0))
    xb = value_buckets(x, ["_g"], n_splits, True).drop("_g")
    bk = xb.groupBy("_b").agg(F.count(F.lit(1)).alias("_cnt"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    bk = bk.withColumn("_off", F.coalesce(F.sum("_cnt").over(
        Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # <= 2B+1 rows
    spark = df.sparkSession
    tgt = spark.createDataFrame([(int(r),) for r in ranks], "r long")
    hit = tgt.join(F.broadcast(bk), (F.col("r") >= F.col("_off")) & (F.col("r") < F.col("_off") + F.col("_cnt")))
    hit = F.broadcast(hit.select("r", "_b", "_off", (F.col("_lo") == F.col("_hi")).alias("_const")))
    rows = xb.join(hit.select("_b", "_const").distinct(), "_b")
    open_rows = rows.where(~F.col("_const")).withColumn(
        "_rk", F.row_number().over(Window.partitionBy("_b").orderBy("_x", tie_hex)) - 1)
    point_rows = group_rank(rows.where(F.col("_const")), ["_b"], tie_hex, tie_hex, hex_sub_bucket(F.col(tie_hex)),
                            rank_col="_rk1", size_col="_sz").withColumn("_rk", F.col("_rk1") - 1).drop("_rk1", "_sz")
    ranked = open_rows.unionByName(point_rows)
    out = ranked.join(hit.select("r", "_b", "_off"), "_b").where(F.col("_rk") == F.col("r") - F.col("_off"))
    return out.drop("_x", "_b", "_const", "_rk", "_off")
