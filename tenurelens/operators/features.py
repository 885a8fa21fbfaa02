"""Feature engineering: ordinal / one-hot / leave-one-out encoders, min-max
scaling, in-group normalisation, stratified split and the survival target.

Fitted statistics are small aggregates (one row, or one row per category).
One-row fits are collected once and enter the plan as literals (the
fit/transform split of Spark ML); per-category fits reach the rows through
equi-joins.  No driver-side loop ever touches the data rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import md5_mod
from ..functions.labels import EVENT_TRUE, ORDINAL_MAPPINGS


def ordinal_encode(col: Column, attribute: str) -> Column:
    """Label → rank through a literal map (unknown labels → NULL)."""
    mapping = ORDINAL_MAPPINGS[attribute]
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    return F.element_at(m, col)


def event_flag(col: Column) -> Column:
    """Yes/1/1.0/True → 1, any other non-NULL → 0."""
    return F.when(col.isNull(), None).otherwise(col.cast("string").isin(*EVENT_TRUE).cast("int"))


def repair_zero_duration(duration: Column, event: Column) -> Column:
    """An event at time 0 is moved to 0.01 (hazard maths needs t > 0)."""
    return F.when((duration == 0) & (event == 1), F.lit(0.01)).otherwise(duration.cast("double"))


def signed_duration(duration: Column, event: Column) -> Column:
    """Survival target: +t for an observed event, -t when censored."""
    return F.when(event == 1, duration).otherwise(-duration).cast("double")


# ---------------------------------------------------------------------------
# one-hot, first level dropped
# ---------------------------------------------------------------------------
def one_hot_levels(df: DataFrame, cols: list[str], max_levels: int = 1000) -> dict[str, list[str]]:
    """Sorted distinct levels of low-cardinality columns, found in one pass (a
    bounded collect: the level lists, never the data).  A column of more than
    ``max_levels`` levels is refused."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in cols]))
    found = (df.select(pairs.alias("p")).select("p.c", "p.v").where(F.col("v").isNotNull()).distinct()
             .limit(len(cols) * max_levels + 1).collect())
    levels = {c: sorted(r["v"] for r in found if r["c"] == c) for c in cols}
    for c, some in levels.items():
        if len(some) > max_levels:
            raise ValueError(f"{c}: too many levels for one-hot; use leave-one-out encoding")
    return levels


def one_hot(df: DataFrame, cols: dict, levels: dict | None = None) -> DataFrame:
    """``cols`` maps a source column to the dummy prefix (``Col_value``).

    ``levels`` (prefix → list) fixes the dummy set fitted on a training frame,
    an empty list too; levels missing from ``df`` become all-zero columns and
    levels that only ``df`` has get none (schema alignment).
    """
    fitted = dict(levels or {})
    missing = [src for src, prefix in cols.items() if prefix not in fitted]
    if missing:
        own = one_hot_levels(df, missing)
        fitted.update({cols[src]: own[src] for src in missing})
    out = [(F.col(src).cast("string") == F.lit(str(v))).cast("int").alias(f"{prefix}_{v}")
           for src, prefix in cols.items() for v in fitted[prefix][1:]]
    return df.select("*", *out)


BROADCAST_ROWS = 10_000


def small_join(df: DataFrame, stats: DataFrame, key: str | list[str]) -> DataFrame:
    """``df`` left joined to one row of ``stats`` per key.  Stats of at most
    ``BROADCAST_ROWS`` rows are broadcast, so that rows do not meet by a few
    keys; the number is checked first."""
    few = stats.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(F.broadcast(stats) if few else stats, key, "left")


# ---------------------------------------------------------------------------
# leave-one-out target encoding
# ---------------------------------------------------------------------------
def target_stats(df: DataFrame, col: str, target: str) -> DataFrame:
    """Per-category sum and count of the target (map-side combined)."""
    return df.groupBy(col).agg(F.sum(target).cast("double").alias("t_sum"),
                               F.count(F.lit(1)).alias("t_count"))


def _global_mean(df: DataFrame, target: str) -> Column:
    """The fitted global mean (one number) as a literal."""
    return F.lit(df.agg(F.avg(F.col(target).cast("double"))).first()[0]).cast("double")


def loo_encode_train(df: DataFrame, col: str, target: str, out: str) -> DataFrame:
    """(sum - y) / (count - 1); singletons take the global mean."""
    st = target_stats(df, col, target)
    mu = _global_mean(df, target)
    j = small_join(df, st, col)
    val = F.when(F.col("t_count") > 1,
                 (F.col("t_sum") - F.col(target)) / (F.col("t_count") - 1)).otherwise(mu)
    return j.withColumn(out, val).drop("t_sum", "t_count")


def loo_encode_infer(df: DataFrame, fit_df: DataFrame, col: str, target: str, out: str) -> DataFrame:
    """sum / count from the fitted frame; unseen or singleton → global mean."""
    st = target_stats(fit_df, col, target)
    mu = _global_mean(fit_df, target)
    j = small_join(df, st, col)
    val = F.when(F.col("t_count") > 1, F.col("t_sum") / F.col("t_count")).otherwise(mu)
    return j.withColumn(out, val).drop("t_sum", "t_count")


# ---------------------------------------------------------------------------
# scaling
# ---------------------------------------------------------------------------
def minmax_fit(df: DataFrame, cols) -> DataFrame:
    """One-row frame of per-column minimum and maximum."""
    aggs = []
    for c in cols:
        aggs += [F.min(F.col(c).cast("double")).alias(f"{c}__min"),
                 F.max(F.col(c).cast("double")).alias(f"{c}__max")]
    return df.agg(*aggs)


def minmax_bounds(stats: DataFrame, cols) -> dict:
    """Collect the fitted bounds: one row of 2·len(cols) numbers (the
    fit/transform split of a Spark ML scaler)."""
    row = stats.first()
    return {c: (row[f"{c}__min"], row[f"{c}__max"]) for c in cols}


def minmax_apply(df: DataFrame, stats, cols, suffix: str = "") -> DataFrame:
    """(x - min) / (max - min) with the fitted bounds; a constant column → 0.

    ``stats`` is the one-row fitted frame (collected once) or a dict of
    bounds; the bounds enter the plan as literals.
    """
    bounds = stats if isinstance(stats, dict) else minmax_bounds(stats, cols)
    outs = {}
    for c in cols:
        lo, hi = bounds[c]
        if lo is None or hi is None or hi - lo <= 0:
            outs[f"{c}{suffix}"] = F.lit(0.0)
        else:
            outs[f"{c}{suffix}"] = (F.col(c).cast("double") - F.lit(float(lo))) / F.lit(float(hi - lo))
    return df.withColumns(outs)


def group_normalise(df: DataFrame, col: str, group: str, out: str) -> DataFrame:
    """In-group min-max; a constant group → 0.5.

    Group bounds are a per-group aggregate joined back on the group key, not
    a window over the raw rows, so a group holding a third of the rows is
    still combined map-side.
    """
    b = df.groupBy(group).agg(F.min(F.col(col).cast("double")).alias("_lo"),
                              F.max(F.col(col).cast("double")).alias("_hi"))
    j = small_join(df, b, group)
    val = F.when(F.col("_hi") - F.col("_lo") == 0, F.lit(0.5)).otherwise(
        (F.col(col).cast("double") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    return j.withColumn(out, val).drop("_lo", "_hi")


# ---------------------------------------------------------------------------
# stratified split by repeatable hash order
# ---------------------------------------------------------------------------
HASH_SPACE = 1 << 30
SPLIT_BUCKETS = 1024


def _bucket_offsets(x: DataFrame, stratum: str, bucket: str, start: str | None) -> DataFrame:
    """Per (stratum, bucket): rows, rows before the bucket (plus ``start``)."""
    keys = [stratum, bucket] if start is None else [stratum, bucket, start]
    counts = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nb"))
    w = Window.partitionBy(stratum).orderBy(bucket)  # <= 1024 rows per stratum
    before = F.coalesce(F.sum("_nb").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if start is not None:
        before = before + F.col(start)
    return counts.withColumn("_before", before)


def stratified_split(df: DataFrame, id_col: str, stratum: str, test_size: float = 0.2,
                     seed: int = 42, out: str = "split") -> DataFrame:
    """Exact per-stratum split: the first n - ceil(test_size * n) rows in
    (md5(seed|id), id) order are 'train', the rest 'test'.

    Exact without sorting a stratum in one task: rows fall in 1024 hash-range
    buckets; a (stratum, bucket) count table locates the one boundary bucket
    per stratum, its rows fall in 1024 finer sub-buckets, and only the rows
    of the one boundary sub-bucket (about 1/2^20 of the stratum) are ranked.
    """
    h = md5_mod(F.concat(F.lit(f"{seed}|"), F.col(id_col).cast("string")), HASH_SPACE)
    x = df.withColumn("_h", h).withColumn("_b", (F.col("_h") / (HASH_SPACE // SPLIT_BUCKETS)).cast("int"))
    n = x.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n"))
    n = n.withColumn("_ntrain", F.col("_n") - F.ceil(F.col("_n") * F.lit(float(test_size)))).drop("_n")
    c1 = _bucket_offsets(x, stratum, "_b", None).join(n, stratum)
    x = x.join(c1, [stratum, "_b"])

    def boundary():
        return (F.col("_before") < F.col("_ntrain")) & (F.col("_before") + F.col("_nb") > F.col("_ntrain"))

    def decided(d):
        return d.withColumn("_r", F.when(F.col("_before") < F.col("_ntrain"), F.lit(0))
                            .otherwise(F.col("_ntrain") + 1).cast("bigint"))

    outer1 = decided(x.where(~boundary()))
    fine = SPLIT_BUCKETS * SPLIT_BUCKETS
    x2 = (x.where(boundary()).withColumnRenamed("_before", "_start").drop("_nb")
          .withColumn("_b2", ((F.col("_h") / (HASH_SPACE // fine)).cast("bigint") % SPLIT_BUCKETS).cast("int")))
    c2 = _bucket_offsets(x2, stratum, "_b2", "_start")
    x2 = x2.join(c2.drop("_start"), [stratum, "_b2"])
    outer2 = decided(x2.where(~boundary()))
    inner = x2.where(boundary())
    rank = F.row_number().over(Window.partitionBy(stratum, "_b2").orderBy("_h", id_col))
    inner = inner.withColumn("_r", F.col("_before") + rank)
    cols = [c for c in df.columns] + ["_r", "_ntrain"]
    res = outer1.select(cols).unionByName(outer2.select(cols)).unionByName(inner.select(cols))
    return res.withColumn(out, F.when(F.col("_r") <= F.col("_ntrain"), "train").otherwise("test")).drop(
        "_r", "_ntrain")
