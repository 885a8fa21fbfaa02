"""Observed monthly exit rates, the rate-compounding fold, inter-exit gaps
and the exit-clustering permutation test."""
from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

HASHES = 1 << 22  # md5 draws of a task, about
SPACE = 1 << 64


def monthly_rates(cohort: DataFrame, as_of: str, months: int = 12) -> DataFrame:
    """Per department and calendar month of the ``months`` before ``as_of``:
    exits, entities at risk at the month start (hired before the month ends,
    not exited before it starts) and their ratio.

    Each entity explodes only over the months it is at risk inside the
    window (at most ``months`` rows), then a grouped count — no join of
    entities with a calendar.
    """
    end = F.trunc(F.lit(as_of).cast("date"), "month")
    start = F.add_months(end, -months)
    e = cohort.select("department", F.trunc("hire_date", "month").alias("h"),
                      F.trunc(F.to_date("date_of_leaving"), "month").alias("x"))
    first = F.greatest(F.col("h"), start)
    last = F.least(F.coalesce(F.col("x"), F.add_months(end, -1)), F.add_months(end, -1))
    span = F.when(first <= last, F.sequence(first, last, F.expr("INTERVAL 1 MONTH")))
    m = e.select("department", "x", F.explode_outer(span).alias("month")).where(F.col("month").isNotNull())
    agg = m.groupBy("department", "month").agg(F.count(F.lit(1)).alias("at_risk"),
                                               F.count_if(F.col("x") == F.col("month")).alias("exits"))
    return agg.withColumn("rate", F.col("exits") / F.col("at_risk"))


def compound_projection(rates: DataFrame, start: DataFrame) -> DataFrame:
    """h <- h - rint(h * r) over the department's rates in month order,
    starting from ``start`` (department, headcount)."""
    arr = rates.groupBy("department").agg(
        F.array_sort(F.collect_list(F.struct("month", "rate"))).alias("_r"))  # <= months entries each
    j = start.join(arr, "department")
    fold = F.aggregate(F.col("_r"), F.col("headcount").cast("double"),
                       lambda h, x: h - F.rint(h * x["rate"]))
    return j.select("department", "headcount", fold.cast("bigint").alias("projected_headcount"))


def exit_gaps(exits: DataFrame, group: str, date_col: str) -> DataFrame:
    """Mean days between consecutive exits per group.  The consecutive gaps
    of a sorted sequence telescope to (last - first), so the mean gap is
    (max - min) / (n - 1): an aggregate, no window over the group."""
    d = F.to_date(F.col(date_col))
    return exits.groupBy(group).agg(F.count(F.lit(1)).alias("n_exits"),
                                    F.datediff(F.max(d), F.min(d)).alias("span_days")) \
        .withColumn("mean_gap_days", F.when(F.col("n_exits") > 1,
                                            F.col("span_days") / (F.col("n_exits") - 1)))


def dealt_ends(sizes: list[int], total: int, key: str) -> list[tuple[int, int]]:
    """First and last place of each group when its ``sizes`` members are dealt
    to ``total`` places at random.

    Places get their group from both ends by turns, each draw without
    replacement from what is left (``key`` and the draw's number decide), until
    every group has been met from both sides or is used up.
    """
    left = list(sizes)
    front: list[int | None] = [None] * len(sizes)
    back, front_end, back_end = front[:], front[:], front[:]
    low, high, draw = 0, total - 1, 0
    while any(n and (f is None or b is None) for n, f, b in zip(left, front, back, strict=True)):
        pick = int(hashlib.md5(f"{key}|{draw}".encode()).hexdigest()[:8], 16) * (high - low + 1) >> 32
        g = 0
        while pick >= left[g]:
            pick -= left[g]
            g += 1
        left[g] -= 1
        if draw % 2:
            place, high = high, high - 1
            back[g], back_end[g] = place if back[g] is None else back[g], place
        else:
            place, low = low, low + 1
            front[g], front_end[g] = place if front[g] is None else front[g], place
        draw += 1
    return [(b if f is None else f, x if y is None else y) for f, b, x, y in zip(front, back_end, front_end, back, strict=True)]


def permutation_test(exits: DataFrame, group: str, date_col: str, n_perm: int = 1000, seed: int = 7) -> DataFrame:
    """Observed pooled inter-exit gap vs the same statistic after shuffling
    group labels among exits (group sizes kept).  Returns observed, expected
    (mean over permutations), lift = observed / expected and the one-sided
    p-value P(permuted <= observed).

    A mean gap needs the first and the last exit of each group only, and a
    random dealing of labels shows those after a few draws from both ends of
    the dates (``dealt_ends``).  So the exits are counted by day and by group
    once, and the permutations are rows of their own: their number, not the
    exits, is what is distributed.
    """
    ex = exits.select(F.col(group).alias("_grp"), F.to_date(F.col(date_col)).alias("_d"))
    groups = [r.n_exits for r in exit_gaps(ex, "_grp", "_d").orderBy("_grp").collect()]  # one row per group
    days = ex.groupBy("_d").agg(F.count(F.lit(1)).alias("n")).orderBy("_d").collect()  # one row per day
    upto, dates = np.cumsum([r.n for r in days]), np.array([r["_d"].toordinal() for r in days])
    total, pairs = sum(groups), sum(groups) - len(groups)

    def run(batches):
        for batch in batches:
            gaps = []
            for p in batch["id"].to_pylist():
                ends = np.array(dealt_ends(groups, total, f"{seed}|{p}"))
                gaps.append(float(np.diff(dates[np.searchsorted(upto, ends, side="right")], axis=1).sum()) / pairs)
            yield pa.RecordBatch.from_arrays([pa.array(gaps, pa.float64())], names=["g"])

    per_group = exit_gaps(ex, "_grp", "_d")
    observed = per_group.agg((F.sum("span_days") / F.sum(F.col("n_exits") - 1)).alias("o")).first()["o"] if pairs else None
    stat = ex.sparkSession.range(n_perm if pairs else 0).mapInArrow(run, "g double")
    known = F.lit(observed).cast("double")
    return stat.agg(known.alias("observed"), F.avg("g").alias("expected"), (known / F.avg("g")).alias("lift"),
                    (F.count_if(F.col("g") <= known) / F.lit(float(n_perm))).alias("p_value"), F.lit(n_perm).alias("permutations"))


def _windows(bounds: list[int], total: int, width: float) -> list[tuple[int, int, int, int]]:
    """(first hash, hash after the last, first bound, last bound) of stretches
    of the hash space that hold the places ``bounds`` of ``total`` hashes but
    for a deviation of more than ``width``."""
    out: list[tuple[int, int, int, int]] = []
    for b in bounds:
        off = int(width * math.sqrt(b * (total - b) / total) + 2) * SPACE // total
        low, high = max(b * SPACE // total - off, 0), min(b * SPACE // total + off, SPACE)
        if out and low <= out[-1][1]:
            out[-1] = (min(out[-1][0], low), max(out[-1][1], high), out[-1][2], b)
        else:
            out.append((low, high, b, b))
    return out


def shuffle_test(exits: DataFrame, group: str, date_col: str, id_col: str, n_perm: int = 1000, seed: int = 7,
                 width: float = 4.5) -> DataFrame:
    """The columns of ``permutation_test`` with every exit dealt anew in every
    permutation: exits in the order of md5(seed|p|id), those without an id
    last, fill the places of the groups (in name order, those without a name
    last), one group after the other.

    Hashes are uniform, so the hash at which a group ends is known but for a
    few deviations: rows outside these windows have their group at once and
    leave counts and ends of dates, one row per task, permutation and stretch;
    only rows inside (about ``width`` times the root of the number of exits)
    are ranked.  Counts tell whether a window holds its bounds; permutations
    where one does not are dealt again with wider windows, in the end the whole
    space.
    """
    spark = exits.sparkSession
    ex = cut_lineage(exits.select(F.col(group).alias("_grp"), F.to_date(F.col(date_col)).alias("_d"), F.col(id_col).cast("string").alias("_id")))
    per_group = exit_gaps(ex, "_grp", "_d")
    sizes = [r.n_exits for r in per_group.orderBy(F.col("_grp").asc_nulls_last()).collect()]  # one row per group
    total, ends = sum(sizes), np.cumsum(sizes).tolist()
    pairs = total - len(sizes)
    observed = per_group.agg((F.sum("span_days") / F.sum(F.col("n_exits") - 1)).alias("o")).first()["o"] if pairs else None
    rows = ex.select("_id", F.unix_date("_d").alias("_d")).repartition(max(1, math.ceil(total * n_perm / HASHES)))
    todo, dealt = list(range(n_perm)) if pairs else [], None
    while todo:
        windows = _windows(ends[:-1], total, width)
        kept = cut_lineage(_stretches(rows, todo, windows, seed))
        counts = np.zeros((n_perm, 2 * len(windows) + 1), np.int64)
        for r in kept.groupBy("p", "stretch").agg(F.sum("n").alias("n")).collect():  # permutations x stretches
            counts[r.p, r.stretch] = r.n
        upto = np.cumsum(counts, axis=1)
        whole = [low == 0 and high == SPACE for low, high, _, _ in windows]
        held = np.all([whole[k] | ((upto[:, 2 * k] <= first) & (last <= upto[:, 2 * k + 1])) for k, (_, _, first, last) in enumerate(windows)]
                      or [np.ones(n_perm, bool)], axis=0)
        done = [p for p in todo if held[p]]
        mine = spark.createDataFrame([(p, j, int(upto[p, j] - counts[p, j])) for p in done for j in range(counts.shape[1])],
                                     "p int, stretch int, before long")
        inside = kept.join(F.broadcast(mine), ["p", "stretch"])
        rank = F.row_number().over(Window.partitionBy("p", "stretch").orderBy("hash", F.col("low").asc_nulls_last()))
        place = F.when(F.col("hash").isNull(), F.col("before") + 1).otherwise(F.col("before") + F.col("rank"))
        ranked = inside.where("hash IS NOT NULL").withColumn("rank", rank).unionByName(inside.where("hash IS NULL").withColumn("rank", F.lit(0)))
        mates = ranked.withColumn("g", F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e < place)))
        per = mates.groupBy("p", "g").agg((F.max("high") - F.min("low")).alias("span"))
        some = per.groupBy("p").agg((F.sum("span") / F.lit(pairs)).alias("g"))
        dealt = some if dealt is None else dealt.unionByName(some)
        todo, width = [p for p in todo if not held[p]], width * 8
    stat = dealt if dealt is not None else spark.createDataFrame([], "p int, g double")
    known = F.lit(observed).cast("double")
    return stat.agg(known.alias("observed"), F.avg("g").alias("expected"), (known / F.avg("g")).alias("lift"),
                    (F.count_if(F.col("g") <= known) / F.lit(float(n_perm))).alias("p_value"), F.lit(n_perm).alias("permutations"))


def _stretches(rows: DataFrame, numbers: list[int], windows: list[tuple[int, int, int, int]], seed: int) -> DataFrame:
    """(p, stretch, n, low, high, hash): number and ends of dates of the rows
    of each stretch between windows, even ones; every row inside a window, odd
    stretches, by itself and with its hash."""
    edges = np.array([e for w in windows for e in w[:2] if e < SPACE], np.uint64)
    names = ["p", "stretch", "n", "low", "high", "hash"]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    parts, none = 2 * len(windows) + 1, np.iinfo(np.int32)

    def run(batches):
        count = np.zeros((len(numbers), parts), np.int64)
        low, high = np.full(count.shape, none.max, np.int32), np.full(count.shape, none.min, np.int32)
        for batch in batches:
            ids = batch["_id"].to_pylist()
            last = np.array([i is None for i in ids], bool)
            known = [i.encode() for i in ids if i is not None]
            days = np.array([none.max if d is None else d for d in batch["_d"].to_pylist()], np.int32)
            dated = days != none.max
            for k, p in enumerate(numbers):
                start = f"{seed}|{p}|".encode()
                digests = [hashlib.md5(start + i).digest() for i in known]
                place = np.full(len(ids), SPACE - 1, np.uint64)
                place[~last] = np.frombuffer(b"".join(digests), ">u8")[::2]
                at = np.searchsorted(edges, place, side="right")
                for j in range(0, parts, 2):
                    use = at == j
                    count[k, j] += np.count_nonzero(use)
                    use &= dated
                    if use.any():
                        low[k, j], high[k, j] = min(low[k, j], days[use].min()), max(high[k, j], days[use].max())
                inside = np.flatnonzero(at % 2)
                if len(inside):
                    row = np.cumsum(~last) - 1  # of the digest
                    whole = [b"\xff" * 17 if last[i] else digests[row[i]] for i in inside]
                    day = pa.array(days[inside], pa.int32(), mask=~dated[inside])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(inside), p), types[0]), pa.array(at[inside], types[1]),
                                                      pa.array(np.ones(len(inside)), types[2]), day, day, pa.array(whole, types[5])], names=names)
        k, j = np.nonzero(count)
        no = low[k, j] == none.max
        yield pa.RecordBatch.from_arrays([pa.array(np.array(numbers)[k], types[0]), pa.array(j, types[1]), pa.array(count[k, j]),
                                          pa.array(low[k, j], types[3], mask=no), pa.array(high[k, j], types[4], mask=no),
                                          pa.nulls(len(k), types[5])], names=names)

    return rows.mapInArrow(run, "p int, stretch int, n long, low int, high int, hash binary")
