"""Exact concordance index without forming pairs.

A pair (i, j) is comparable when i has the event and either t_i < t_j or
t_i = t_j with j censored; it is concordant when score_i > score_j (higher
risk leaves first) and counts 1/2 when the scores tie.

Rows collapse to cells (t, event, score) with a number of rows.  Two orders of
the cells decide everything: by score (equal scores: later ones first, censored
before events) and by time (events before censored at one time).  A comparable
pair whose j comes first by score is concordant or tied, and the tied ones are
the cells of the same score before an event.  So both counts come from the
number of pairs that the two orders put the other way round:

1. the cells are dealt into ranges of the first order; inside a range the pairs
   are counted by merging (``inverted``), and a running number of rows, carried
   from range to range, gives the ties;
2. the same cells are dealt into ranges of the second order; pairs of different
   score ranges are counted inside a time range by merging the numbers of the
   score ranges, and across time ranges from the table of rows per (time range,
   score range), summed over both.

Scores and times may be continuous, and any of them may hold most of the rows:
ranges are cut by rows, equal values may lie in several.  A task holds the
arrays of one range; tables have one row per range or pair of ranges.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

CELLS_PER_RANGE = 1 << 18
_SMALL = 64


def inverted(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """For each element the weight of those with a smaller x and a larger y."""
    order = np.lexsort((y, x))  # of equal x the smaller y first: such pairs never count
    y, w, out = y[order], w[order].astype(float), np.zeros(len(x))
    width = _SMALL
    for at in range(0, len(y), width):
        part = slice(at, at + width)
        before = np.tri(len(y[part]), k=-1, dtype=bool) & (y[part][None, :] > y[part][:, None])
        out[part] += before @ w[part]
    while width < len(y):  # left halves, sorted by y, against right halves
        for at in range(0, len(y) - width, 2 * width):
            left, right = slice(at, at + width), slice(at + width, at + 2 * width)
            by = np.argsort(y[left], kind="stable")
            upto = np.concatenate(([0.0], np.cumsum(w[left][by])))
            out[right] += upto[-1] - upto[np.searchsorted(y[left][by], y[right], side="right")]
        width *= 2
    found = np.empty(len(x))
    found[order] = out
    return found


def _whole(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray] | None:
    held = [b for b in batches if len(b)]
    if not held:
        return None
    table = pa.Table.from_batches(held)
    return {c: table[c].to_numpy() for c in table.column_names}


def _time_key(t: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Numbers in the order of time, events before censored at one time."""
    pairs = np.stack([t, 1.0 - e], axis=1)
    return np.unique(pairs, axis=0, return_inverse=True)[1].reshape(-1)


def score_ranges(cells: DataFrame, ranges: int) -> DataFrame:
    """The cells (t, e, s, w) with the number ``b`` of their score range, the
    pairs ``d`` inside it that the orders invert (events), and the place in
    their score's run: ``run`` rows of the range with that score before them."""
    order = [F.col("s"), F.col("t").desc(), F.col("e")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _whole(batches)
        if c is None:
            return
        n = len(c["s"])
        d = inverted(np.arange(n), _time_key(c["t"], c["e"]), c["w"])
        before = np.cumsum(c["w"]) - c["w"]
        start = np.flatnonzero(np.concatenate(([True], c["s"][1:] != c["s"][:-1])))
        own = before - np.repeat(before[start], np.diff(np.concatenate((start, [n]))))
        part = np.full(n, TaskContext.get().partitionId())
        yield pa.RecordBatch.from_arrays([pa.array(c["t"]), pa.array(c["e"]), pa.array(c["s"]), pa.array(c["w"]), pa.array(part, pa.int32()),
                                          pa.array(d), pa.array(own)], names=["t", "e", "s", "w", "b", "d", "run"])

    return (cells.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
            .mapInArrow(run, "t double, e int, s double, w double, b int, d double, run double"))


def tie_pairs(placed: DataFrame) -> float:
    """Comparable pairs of equal scores: events times the rows of their score
    before them, those of earlier ranges too."""
    ends = placed.groupBy("b").agg(F.min("s").alias("first"), F.max("s").alias("last"))
    sides = placed.join(F.broadcast(ends), "b").groupBy("b", "first", "last").agg(
        F.sum(F.when(F.col("e") == 1, F.col("w") * F.col("run")).otherwise(0.0)).alias("own"),
        F.sum(F.when((F.col("e") == 1) & (F.col("s") == F.col("first")), F.col("w")).otherwise(0.0)).alias("events"),
        F.sum(F.when(F.col("s") == F.col("last"), F.col("w")).otherwise(0.0)).alias("rows")).orderBy("b")
    total, score, carried = 0.0, None, 0.0
    for r in sides.collect():  # one row per range
        carried = carried if r["first"] == score else 0.0
        total += r["own"] + r["events"] * carried
        carried = r["rows"] + (carried if r["first"] == r["last"] else 0.0)
        score = r["last"]
    return total


def cross_pairs(placed: DataFrame, ranges: int) -> DataFrame:
    """One row: ``inverted``, pairs of different score ranges that the orders
    invert, and ``comparable``, all comparable pairs."""
    order = [F.col("t"), F.col("e").desc()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _whole(batches)
        if c is None:
            return
        key = _time_key(c["t"], c["e"])
        d = inverted(c["b"], key, c["w"])
        order = np.argsort(key, kind="stable")
        upto = np.cumsum(c["w"][order])
        after = np.empty(len(key))
        after[order] = upto[-1] - upto[np.searchsorted(key[order], key[order], side="right") - 1]
        part = np.full(len(key), TaskContext.get().partitionId())
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(c["b"]), pa.array(c["t"]), pa.array(c["e"]), pa.array(c["w"]),
                                          pa.array(d), pa.array(after), pa.array(key == 0), pa.array(key == key.max())],
                                         names=["r", "b", "t", "e", "w", "d", "after", "low", "high"])

    ranged = cut_lineage(placed.select("b", "t", "e", "w").withColumn("_salt", F.xxhash64("b", F.monotonically_increasing_id()))
                         .repartitionByRange(ranges, *order, F.col("_salt")).drop("_salt")
                         .mapInArrow(run, "r int, b int, t double, e int, w double, d double, after double, low boolean, high boolean"))
    key = lambda which: F.max(F.when(F.col(which), F.struct("t", "e")))
    ends = ranged.groupBy("r").agg(key("low").alias("first"), key("high").alias("last"))
    grid = ranged.groupBy("r", "b").agg(F.sum("w").alias("n"), F.sum(F.when(F.col("low"), F.col("w")).otherwise(0.0)).alias("n_low"))
    last = grid.agg(F.max("b")).first()[0]
    numbers = ends.select("r", F.explode(F.sequence(F.lit(0), F.lit(last or 0))).alias("b"))  # pairs of ranges
    dense = numbers.join(grid, ["r", "b"], "left").na.fill(0.0, ["n", "n_low"]).join(F.broadcast(ends), "r")
    later = Window.partitionBy("b").orderBy(F.col("r").desc()).rowsBetween(Window.unboundedPreceding, -1)
    sums = dense.select("r", "b", F.coalesce(F.sum("n").over(later), F.lit(0.0)).alias("more"))
    same = (dense.select("r", "b", "last").join(dense.select(F.col("r").alias("r2"), F.col("b"), F.col("first").alias("last"), "n_low"), ["b", "last"])
            .where("r2 > r").groupBy("r", "b").agg(F.sum("n_low").alias("alike")))
    below = Window.partitionBy("r").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("r")
    carry = sums.join(same, ["r", "b"], "left").na.fill(0.0, ["alike"]).select(
        "r", "b", *[F.coalesce(F.sum(c).over(below), F.lit(0.0)).alias(f"{c}_below") for c in ("more", "alike")],
        *[F.sum(c).over(every).alias(f"{c}_all") for c in ("more", "alike")])
    at = lambda what: F.col(f"more_{what}") - F.when(F.col("high"), F.col(f"alike_{what}")).otherwise(0.0)
    events = ranged.where("e = 1").groupBy("r", "b", "high").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("d")).alias("d"),
                                                               F.sum(F.col("w") * F.col("after")).alias("after"))
    return events.join(carry, ["r", "b"]).agg(
        F.coalesce(F.sum(F.col("d") + F.col("w") * at("below")), F.lit(0.0)).alias("inverted"),
        F.coalesce(F.sum(F.col("after") + F.col("w") * at("all")), F.lit(0.0)).alias("comparable"))


def concordance(df: DataFrame, time: str, event: str, score: str, cells_per_range: int | None = None) -> DataFrame:
    """One row: concordance, comparable pairs, concordant, tied."""
    cells = cut_lineage(df.select(F.col(time).cast("double").alias("t"), F.col(event).cast("int").alias("e"),
                                  F.col(score).cast("double").alias("s"))
                        .groupBy("t", "e", "s").agg(F.count(F.lit(1)).cast("double").alias("w")))
    ranges = max(1, math.ceil(cells.count() / (cells_per_range or CELLS_PER_RANGE)))
    placed = cut_lineage(score_ranges(cells, ranges))
    inside = F.lit(placed.where("e = 1").agg(F.sum(F.col("w") * F.col("d"))).first()[0] or 0.0)
    tied = F.lit(tie_pairs(placed))
    found = cross_pairs(placed, ranges).select("comparable", (F.col("inverted") + inside - tied).alias("concordant"), tied.alias("tied"))
    return found.select(((F.col("concordant") + F.lit(0.5) * F.col("tied")) / F.nullif("comparable", F.lit(0.0))).alias("c_index"),
                        F.round("comparable").cast("bigint").alias("comparable_pairs"),
                        F.round("concordant").cast("bigint").alias("concordant_pairs"), F.round("tied").cast("bigint").alias("tied_pairs"))
