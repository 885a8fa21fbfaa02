"""Exact k-nearest neighbours under the composite similarity distance,
without forming all pairs inside a department.

Members of a department are sorted by project, gender, tier and their place on
a Z-order curve over normalised age and risk, and cut into blocks of ``BLOCK``
rows.  A block knows the box of its ages and risks and the attributes that all
its members share, and, from the distances inside it, an upper bound ``tau`` on
every member's k-th distance.  Another block can only matter if the least
distance between the two boxes and attributes is no more than the largest tau.

Pairs of blocks are found from the top: ranges of the sort, then runs of 32
blocks, then blocks, each level joining the children of the pairs that the
level above left.  Pairs of blocks that remain are compared as arrays and give
only neighbours within tau, so a member yields a few times k candidates
whatever the size of its department.

Members under one manager are 0.2 nearer and lie anywhere in that sort, so they
are paired by themselves: up to ``BLOCK`` of them by a join, more in a second
family of blocks, sorted by manager first, whose members get a tau from it too.
The first family then only looks for members of other managers, whose bound is
0.2 higher.  A
department, project or manager with a third of all rows is many blocks, and no
task holds more than two of them.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import KNN_MAX, KNN_MIN, KNN_SHARE
from ..session import cut_lineage
from .similarity import W_CAT, W_CONT, W_HIER, distance_expr

BLOCK = 128
RUN = 32  # blocks that the level above treats as one
EPS = 1e-9
HELD = 256  # blocks that a task keeps as arrays
_ATTRIBUTES = ("manager_id", "project", "gender", "tier")
_NUMBERS = ("age_norm", "risk_norm")
_BOX = ("age_lo", "age_hi", "risk_lo", "risk_hi")
_PACKED = ("department string, manager string, part int, number int, k int, project string, gender string, tier string, "
           + ", ".join(f"{c} double" for c in _BOX) + ", reach double, reach_id string, ids array<string>, tau_ids array<string>, "
           + ", ".join(f"{c}s array<string>" for c in _ATTRIBUTES) + ", " + ", ".join(f"{c}s array<double>" for c in (*_NUMBERS, "tau")))
_ARROW = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "array<string>": pa.list_(pa.string()),
          "array<double>": pa.list_(pa.float64())}
_FIELDS = [tuple(c.split()) for c in _PACKED.split(", ")]


def z_order(a: Column, b: Column) -> Column:
    """Bits of two values in [0, 1] by turns, 16 of each."""
    def spread(v: Column) -> Column:
        x = F.least(F.greatest(F.floor(v * 65535), F.lit(0)), F.lit(65535)).cast("long")
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
        return x
    return spread(a).bitwiseOR(F.shiftleft(spread(b), 1))


class _Members:
    """Arrays of a block."""

    def __init__(self, row: dict):
        self.ids = np.array(row["ids"], dtype=object)
        self.attributes = {c: row[f"{c}s"] for c in _ATTRIBUTES}
        self.numbers = {c: np.array(row[f"{c}s"], dtype=float) for c in _NUMBERS}
        self.k, self.taus, self.tau_ids = row["k"], np.array(row["taus"], dtype=float), np.array(row["tau_ids"], dtype=object)

    def some(self, rows: np.ndarray) -> _Members:
        """The members ``rows``."""
        if len(rows) == len(self.ids):
            return self
        out = object.__new__(_Members)
        out.k, out.ids, out.taus, out.tau_ids = self.k, self.ids[rows], self.taus[rows], self.tau_ids[rows]
        out.attributes = {c: [v[i] for i in rows] for c, v in self.attributes.items()}
        out.numbers = {c: v[rows] for c, v in self.numbers.items()}
        return out


def _equal(a: list, b: list) -> np.ndarray:
    """Which values of ``a`` equal which of ``b``; a missing one equals none."""
    codes: dict = {}
    x = np.array([-1 if v is None else codes.setdefault(v, len(codes)) for v in a])
    y = np.array([-2 if v is None else codes.setdefault(v, len(codes)) for v in b])
    return x[:, None] == y[None, :]


def distances(a: _Members, b: _Members) -> tuple[np.ndarray, np.ndarray]:
    """(distance, same manager) of every member of ``a`` to every of ``b``, of
    one department."""
    own = lambda m: [v or None for v in m.attributes["manager_id"]]
    manager = _equal(own(a), own(b))
    unlike = {c: np.where(_equal(a.attributes[c], b.attributes[c]), 0.0, 1.0) for c in ("project", "gender", "tier")}
    has = lambda m: np.array([v is not None for v in m.attributes["tier"]])
    tiers = has(a)[:, None] & has(b)[None, :]
    hierarchy = np.where(manager, 0.0, 1.0) / 3.0 + 0.0 / 3.0 + unlike["project"] / 3.0
    category = np.where(tiers, 0.5 * unlike["gender"] + 0.5 * unlike["tier"], unlike["gender"])
    gap = {c: np.abs(a.numbers[c][:, None] - b.numbers[c][None, :]) for c in _NUMBERS}
    number = 0.5 * gap["age_norm"] + 0.5 * gap["risk_norm"]
    return W_HIER * hierarchy + W_CAT * category + W_CONT * number, manager


def kth(a: _Members, b: _Members, k: int) -> list[tuple[float, str]]:
    """The k-th least (distance, id) from each member of ``a`` to others of ``b``."""
    d, _ = distances(a, b)
    d[a.ids[:, None] == b.ids[None, :]] = np.inf
    out = []
    for row in d:
        if np.count_nonzero(np.isfinite(row)) < k:
            out.append((np.inf, ""))
            continue
        tau = np.partition(row, k - 1)[k - 1]
        out.append((float(tau), sorted(b.ids[row == tau])[k - 1 - np.count_nonzero(row < tau)]))
    return out


def blocks(rows: DataFrame, by_manager: bool) -> DataFrame:
    """The packed blocks (``_PACKED``) of ``rows``.  Members get their ``tau``
    from the distances inside the block, or keep a lower one."""
    first = ["department", "manager_id"] if by_manager else ["department"]
    order = [*first, "project", "gender", "tier", "_z", "id"]
    sorted_rows = (rows.withColumn("_z", z_order(F.col("age_norm"), F.col("risk_norm"))).repartitionByRange(*order)
                   .sortWithinPartitions(*order).select("department", "id", *_ATTRIBUTES, *_NUMBERS, "_k", "tau", "tau_id"))

    alike: list = [None, None]  # what the members of a block share, if everything; the first block of such

    def packed(held: list[dict], part: int, number: int) -> dict:
        column = {f"{c}s": [r[c] for r in held] for c in (*_ATTRIBUTES, *_NUMBERS, "tau", "tau_id")}
        row = {"department": held[0]["department"], "manager": held[0]["manager_id"] if by_manager else None, "part": part,
               "number": number, "k": held[0]["_k"], "ids": [r["id"] for r in held], **column}
        for c in ("project", "gender", "tier"):
            row[c] = column[f"{c}s"][0] if len(set(column[f"{c}s"])) == 1 else None
        for c, name in zip(_NUMBERS, ("age", "risk"), strict=True):
            row[f"{name}_lo"], row[f"{name}_hi"] = min(column[f"{c}s"]), max(column[f"{c}s"])
        m = _Members(row)
        best = kth(m, m, row["k"])
        shared = {tuple(r[c] for c in (*first, "project", "gender", "tier", *_NUMBERS)) for r in held}
        if len(shared) > 1:
            alike[:] = None, None
        elif alike[0] == shared:
            best = list(map(min, best, kth(m, alike[1], row["k"])))
        else:
            alike[:] = shared, m
        if by_manager:
            best = list(map(min, best, zip(row["taus"], row["tau_ids"], strict=True)))
        row["taus"], row["tau_ids"] = [t for t, _ in best], [i for _, i in best]
        row["reach"], row["reach_id"] = max(row["taus"]), max(row["tau_ids"])
        return row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, ready, out = TaskContext.get().partitionId(), 0, [], [], []
        key = None

        def close(last: bool) -> None:
            """Packs what can be packed; a short rest joins the block before."""
            nonlocal number, held, ready
            if last and ready and len(held) <= KNN_MAX:
                ready, held = ready + held, []
            for some in (ready, held) if last else (ready,):
                if some:
                    out.append(packed(some, part, number))
                    number += 1
            ready, held = ([], []) if last else (held, [])

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], _ARROW[t]) for c, t in _FIELDS], names=[c for c, _ in _FIELDS])
            out.clear()
            return batch

        for batch in batches:
            for row in batch.to_pylist():
                mine = tuple(row[c] for c in first)
                if mine != key:
                    close(True)
                    key = mine
                elif len(held) >= BLOCK or (len(held) > 2 * KNN_MAX and any(row[c] != held[-1][c] for c in ("project", "gender", "tier"))):
                    close(False)
                held.append(row)
            yield flush()
        close(True)
        yield flush()

    return cut_lineage(sorted_rows.mapInArrow(run, _PACKED))


def near_pairs(packed: DataFrame, by_manager: bool) -> DataFrame:
    """(part_a, number_a, part_b, number_b): the blocks b that may hold
    neighbours of members of a."""
    keys = ["department", "manager"] if by_manager else ["department"]
    kept = packed.select(*keys, "part", "number", "project", "gender", "tier", *_BOX, "reach", "reach_id", F.array_min("ids").alias("low_id"))
    one = lambda c: F.when((F.count(c) == F.count(F.lit(1))) & (F.min(c) == F.max(c)), F.min(c)).alias(c)
    merged = [one("project"), one("gender"), one("tier"), *[(F.min if c.endswith("lo") else F.max)(c).alias(c) for c in _BOX],
              F.max("reach").alias("reach"), F.max("reach_id").alias("reach_id"), F.min("low_id").alias("low_id")]
    run = F.floor(F.col("number") / RUN).cast("int").alias("run")
    levels = [kept.groupBy(*keys, "part").agg(*merged), kept.withColumn("run", run).groupBy(*keys, "part", "run").agg(*merged),
              kept.withColumn("run", run)]
    ids = [["part"], ["part", "run"], ["part", "run", "number"]]

    def side(level: DataFrame, x: str) -> DataFrame:
        return level.select(*[F.col(c).alias(c if c in keys else f"{c}_{x}") for c in level.columns])

    unlike = lambda c: F.coalesce((F.col(f"{c}_a") != F.col(f"{c}_b")).cast("int"), F.lit(0))
    gap = lambda c: F.greatest(F.col(f"{c}_lo_a") - F.col(f"{c}_hi_b"), F.col(f"{c}_lo_b") - F.col(f"{c}_hi_a"), F.lit(0.0))
    least = 0.1 * (2 * unlike("project") + unlike("gender") + unlike("tier") + (0 if by_manager else 2) + gap("age") + gap("risk"))
    pairs = None
    for level, own in zip(levels, ids, strict=True):
        a, b = side(level, "a"), side(level, "b")
        if pairs is None:
            found = a.join(b, keys)
        else:
            above = own[:-1]
            found = (pairs.join(a, [*keys, *(f"{c}_a" for c in above)]).join(b, [*keys, *(f"{c}_b" for c in above)]))
        enough = (least < F.col("reach_a") - EPS) | (F.col("low_id_b") <= F.col("reach_id_a"))
        pairs = found.where((least - EPS <= F.col("reach_a")) & (enough | (F.col("reach_a") == float("inf")))).select(*keys, *(f"{c}_{x}" for c in own for x in "ab"))
    return pairs.select("part_a", "number_a", "part_b", "number_b")


def neighbours(packed: DataFrame, pairs: DataFrame, by_manager: bool) -> DataFrame:
    """(a, b, distance, k): members of paired blocks within the tau of a, of
    one manager or of different ones."""
    fields = ["ids", *(f"{c}s" for c in (*_ATTRIBUTES, *_NUMBERS)), "taus", "tau_ids", "k"]
    place = ["part_a", "number_a", "part_b", "number_b"]
    side = lambda x: packed.select(F.col("part").alias(f"part_{x}"), F.col("number").alias(f"number_{x}"),
                                   F.struct(*fields).alias(x))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read: dict[tuple[int, int], _Members] = {}  # the last blocks met

        def block(where: tuple[int, int], cell: pa.Scalar) -> _Members:
            if where not in read:
                if len(read) >= HELD:
                    read.pop(next(iter(read)))
                read[where] = _Members(cell.as_py())
            return read[where]

        for batch in batches:
            places = zip(*(batch[c].to_pylist() for c in place), strict=True)
            for i, (part_a, number_a, part_b, number_b) in enumerate(places):
                a, b = block((part_a, number_a), batch["a"][i]), block((part_b, number_b), batch["b"][i])
                gaps = [np.maximum(np.maximum(a.numbers[c] - b.numbers[c].max(), b.numbers[c].min() - a.numbers[c]), 0.0) for c in _NUMBERS]
                near = np.flatnonzero(~(0.1 * ((0 if by_manager else 2) + gaps[0] + gaps[1]) - EPS > a.taus))
                if not len(near):
                    continue
                a = a.some(near)
                d, manager = distances(a, b)
                tau, last = a.taus[:, None], a.tau_ids[:, None]
                use = d < tau
                tied = np.flatnonzero((d == tau).any(axis=1))
                use[tied] |= (d[tied] == tau[tied]) & (b.ids[None, :] <= last[tied])
                use &= (manager == by_manager) & (a.ids[:, None] != b.ids[None, :])
                for row in np.flatnonzero(np.count_nonzero(use, axis=1) > a.k):  # ties of the k-th stay
                    use[row] &= d[row] <= np.partition(d[row][use[row]], a.k - 1)[a.k - 1]
                p, q = np.nonzero(use)
                yield pa.RecordBatch.from_arrays([pa.array(a.ids[p], pa.string()), pa.array(b.ids[q], pa.string()), pa.array(d[p, q]),
                                                  pa.array(np.full(len(p), a.k), pa.int32())], names=["a", "b", "distance", "k"])

    both = pairs.join(side("a"), ["part_a", "number_a"]).join(side("b"), ["part_b", "number_b"]).select(*place, "a", "b")
    return both.mapInArrow(run, "a string, b string, distance double, k int")


def same_manager(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """(a, b, distance, k): members of one manager within the tau of a, for
    managers of at most ``BLOCK`` members, from a join."""
    keys = ["department", "manager_id"]
    some = members.join(sizes.where((F.col("_n") > 1) & (F.col("_n") <= BLOCK)).drop("_n"), keys)
    x, y = some.alias("x"), some.select(*keys, "id", "project", "gender", "tier", *_NUMBERS).alias("y")
    both = x.join(y, [F.col(f"x.{c}") == F.col(f"y.{c}") for c in keys]).where(~F.col("x.id").eqNullSafe(F.col("y.id")))
    found = both.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), distance_expr("x", "y").alias("distance"), F.col("x._k").alias("k"), "tau", "tau_id")
    return found.where((F.col("distance") < F.col("tau")) | ((F.col("distance") == F.col("tau")) & (F.col("b") <= F.col("tau_id")))).drop("tau", "tau_id")


def knn(att: DataFrame, stats: list | None = None, k_floor: int = KNN_MIN, k_cap: int = KNN_MAX,
        k_share: float = KNN_SHARE) -> DataFrame:
    """``att``: id, department, manager_id, project, gender, tier, age_norm,
    risk_norm.  Returns (a, b, distance, rank) for the k nearest b of every a
    in its department (ties by b's id), k = ``k_share`` of the department's
    members, at least ``k_floor`` and at most ``k_cap``.  ``stats`` gets the
    number of candidate pairs compared."""
    att = cut_lineage(att.select("id", "department", *_ATTRIBUTES, *_NUMBERS))
    n = att.groupBy("department").agg(F.count(F.lit(1)).alias("_n"))
    k = F.greatest(F.lit(k_floor), F.least(F.lit(k_cap), F.ceil(F.col("_n") * k_share))).cast("int")
    rows = att.join(n, "department").withColumn("_k", k).drop("_n").withColumns({"tau": F.lit(None).cast("double"), "tau_id": F.lit(None).cast("string")})
    others = blocks(rows, False)
    members = others.select("department", F.col("k").alias("_k"), F.explode(F.arrays_zip(
        F.col("ids").alias("id"), *[F.col(f"{c}s").alias(c) for c in (*_ATTRIBUTES, *_NUMBERS, "tau", "tau_id")])).alias("m")).select("department", "_k", "m.*")
    managed = members.where("manager_id IS NOT NULL AND manager_id != ''")
    sizes = managed.groupBy("department", "manager_id").agg(F.count(F.lit(1)).alias("_n"))
    own = blocks(managed.join(sizes.where(F.col("_n") > BLOCK).drop("_n"), ["department", "manager_id"]), True)
    found = [same_manager(managed, sizes)]
    for packed, by_manager in ((others, False), (own, True)):
        pairs = cut_lineage(near_pairs(packed, by_manager))
        found.append(neighbours(packed, pairs, by_manager))
        if stats is not None:  # diagnostics only
            size = lambda x: packed.select(F.col("part").alias(f"part_{x}"), F.col("number").alias(f"number_{x}"), F.size("ids").alias(f"n_{x}"))  # noqa: B023, E731
            stats.append(pairs.join(size("a"), ["part_a", "number_a"]).join(size("b"), ["part_b", "number_b"]).agg(F.sum(F.col("n_a") * F.col("n_b"))).first()[0])
    ranked = found[0].union(found[1]).union(found[2]).withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy("distance", "b")))
    return ranked.where(F.col("rank") <= F.col("k")).select("a", "b", "distance", "rank")


def similarity_edges(knn_pairs: DataFrame) -> DataFrame:
    """Undirected edge per kNN pair (each unordered pair once), weight =
    round(1 - distance, 4)."""
    e = knn_pairs.select(F.least("a", "b").alias("source"), F.greatest("a", "b").alias("target"), "distance")
    return e.groupBy("source", "target").agg(F.first("distance").alias("distance")).select(
        "source", "target", F.round(1.0 - F.col("distance"), 4).alias("weight"))
