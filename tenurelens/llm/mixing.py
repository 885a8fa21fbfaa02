"""Mixing sources to target weights with a time-varying curriculum.

Sources in code-point order (null last) weigh ``WEIGHTS`` in turn and share
``SHARE`` times all words; no target exceeds ``MAX_EPOCHS`` times its source,
and what is cut off is shared again by weight.  That fixed point is found in
one pass over the sources sorted by cap / weight.

Every source is a stream: its documents in MD5 order, as often as its target
asks.  Whole passes are taken first; the last pass stops at the target, in
the document that crosses it (``taken`` counts words).  The position of a
document on the training axis [0, 1] inverts its source's integrated weight
schedule w(t) = 1 + tilt * (2t - 1) at the share of the source's demand that
lies before its middle word, and the result is range-sorted by position.

A source may hold most rows, so its prefix sums come from 4,096 hash buckets:
the bucket table gives offsets, rows are summed only inside their bucket.

Cases: null text has size 0; a null source is a source; rows without words
are never taken (position null, sorted last); repeated rows are summed one
after the other in the order of their id; an empty table stays empty.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import WORD

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
TILTS = (0.5, 0.0, -0.5)  # change of a source's weight over the run, in turn


def source_targets(sizes: DataFrame) -> DataFrame:
    """``sizes``: one row per source (source, source_size).  Adds n (place in
    code-point order), target and tilt."""
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source
    placed = sizes.withColumn("n", F.row_number().over(order) - 1)
    pick = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]),
                                       (F.col("n") % len(values) + 1).cast("int"))
    caps = (placed.withColumn("weight", pick(WEIGHTS)).withColumn("tilt", pick(TILTS))
            .withColumn("cap", F.col("source_size") * float(MAX_EPOCHS)))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "n")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = ((F.sum("source_size").over(everything) * SHARE - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
             / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    levels = caps.withColumn("level", level)
    final = F.min_by("level", F.when(F.col("cap") / F.col("weight") > F.col("level"),
                                     F.col("cap") / F.col("weight"))).over(everything)
    return (levels.withColumn("target", F.least(F.col("cap"), F.coalesce(final, F.lit(0.0)) * F.col("weight")))
            .select("source", "source_size", "n", "target", "tilt"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken,
    position; sorted by position."""
    words = F.coalesce(F.regexp_count(docs[text_col].cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    key = F.md5(F.coalesce(docs[id_col].cast("string"), F.lit("")))
    rows = docs.select(docs[id_col].alias("doc_id"), docs[source_col].alias("source"), words.alias("size"),
                       key.alias("key")).withColumn("bucket", F.substring("key", 1, 3))
    earlier = Window.partitionBy("source").orderBy("bucket")
    buckets = (rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
               .withColumn("before", F.sum("bucket_size").over(earlier) - F.col("bucket_size"))
               .withColumnRenamed("source", "s").withColumnRenamed("bucket", "b"))
    targets = source_targets(buckets.groupBy(F.col("s").alias("source"))
                             .agg(F.sum("bucket_size").alias("source_size")))
    targets = targets.withColumnRenamed("source", "t")
    plan = buckets.join(targets, F.col("s").eqNullSafe(F.col("t"))).drop("t", "n", "bucket_size")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    asked = F.round("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(asked / F.col("source_size"))).otherwise(F.lit(0))
    taken = (rows.withColumn("upto", F.sum("size").over(inside))
             .join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
             .withColumn("start", F.col("before") + F.col("upto") - F.col("size"))
             .withColumn("passes", passes.cast("long"))
             .withColumn("rest", asked - F.col("passes") * F.col("source_size"))
             .withColumn("taken", F.col("passes") * F.col("size")
                         + F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("start"))))
             .withColumn("share", (F.col("start") + F.col("size") / 2) / F.greatest(asked, F.lit(1))))
    even = 1 - F.col("tilt")
    inverse = F.when(F.col("tilt") == 0, F.col("share")).otherwise(
        (F.sqrt(even * even + 4 * F.col("tilt") * F.least(F.col("share"), F.lit(1.0))) - even) / (2 * F.col("tilt")))
    return (taken.withColumn("position", F.when(F.col("taken") > 0, F.least(inverse, F.lit(1.0))))
            .select("doc_id", "source", "size", "source_size", "target", "taken", "position")
            .sort(F.col("position").asc_nulls_last(), "doc_id"))


def take_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, by position; a
    document that is cut counts if at least half of it is taken.  Rows repeated
    under an id, or without one, are taken alike."""
    copies = F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size"))).cast("int")
    taken = (mix(docs, id_col, text_col, source_col).where("taken > 0")
             .groupBy(F.col("doc_id").alias("__id"))
             .agg(F.max(copies).alias("__copies"), F.min("position").alias("__position")).where("__copies > 0"))
    rows = docs.join(taken, docs[id_col].eqNullSafe(taken["__id"]))
    return (rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), "__copies")))
            .sort("__position", "__id", "__copy").select(*[rows[c] for c in docs.columns]))
