"""Boosted trees on the Cox partial likelihood, from histograms.

Values are binned once at quantiles.  A round takes margins F to gradients
g = w A - e and Hessians h = w A - w^2 B of the loss (Breslow ties), where
w = exp(F), A = sum of d/S0 and B = sum of d/S0^2 over the event times up to a
row's own; two passes over ranges of time carry S0 down and A, B up.  A tree
grows level by level: one pass adds g and h per node, feature and bin, and the
driver splits each node where the gain of the second-order objective with L1
and L2 penalties is largest.  What comes to the driver has the size of a
few histograms (nodes x features x bins), whatever the number of rows or times.

Margins are written with the rows every ``REWRITE`` rounds, so a lost executor
repeats a few trees at most.
"""
from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .time_ranges import Range, by_time, each_range, vector_sum

BINS = 64
REWRITE = 10
_ALL = 255  # a bin above all: such a node sends every row left
_U = np.uint64


@dataclass
class Params:
    """The defaults are those of the production fit."""
    rounds: int = 120
    learning_rate: float = 0.05
    max_depth: int = 4
    l1: float = 0.0
    l2: float = 1.0
    min_gain: float = 0.0
    min_hessian: float = 1.0  # of a child
    row_sample: float = 1.0  # share of the rows of a tree, by a hash of id and round
    column_sample: float = 1.0
    validation: float = 0.15  # share of the ids that is held out
    patience: int = 30
    seed: int = 42


# FIXED VALUES — the second set of hyper-parameters (batch training)
BATCH = dict(rounds=200, max_depth=3, learning_rate=0.03, row_sample=0.7, column_sample=0.7, min_hessian=10.0, l1=1.0, l2=5.0,
             min_gain=1.0)


@dataclass
class Tree:
    """A complete tree by levels: node i has children 2i+1 and 2i+2; rows above
    ``bin`` of ``feature`` go right.  ``leaf`` holds scaled leaf values."""
    feature: np.ndarray
    bin: np.ndarray
    gain: np.ndarray
    leaf: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = (1 << depth) - 1
        return cls(np.zeros(n, np.int64), np.full(n, _ALL, np.int64), np.zeros(n), np.zeros(1 << depth))

    def place(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """The node of each row after ``levels`` splits."""
        node = np.zeros(len(bins), np.int64)
        flat = bins.ravel()
        row = np.arange(0, flat.size, bins.shape[1])
        for _ in range(levels):
            node = 2 * node + 1 + (flat.take(row + self.feature.take(node)) > self.bin.take(node))
        return node

    def margins(self, bins: np.ndarray) -> np.ndarray:
        depth = len(self.leaf).bit_length() - 1
        return self.leaf[self.place(bins, depth) - len(self.leaf) + 1]


@dataclass
class Model:
    features: list[str]
    edges: list[list[float]]  # of each feature: bin k holds values up to edges[k]
    trees: list[Tree]  # up to the round of the lowest loss
    losses: list[tuple] = field(default_factory=list)  # (round, loss, held-out loss)

    def threshold(self, tree: Tree) -> np.ndarray:
        """The value above which a row goes right, per node."""
        return np.array([self.edges[f][b] if b != _ALL else math.inf for f, b in zip(tree.feature, tree.bin, strict=True)])


def mixed(h: np.ndarray, salt: int) -> np.ndarray:
    """Hashes as numbers in [0, 1), anew for each salt."""
    x = h ^ _U(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return ((x ^ (x >> _U(33))) >> _U(11)).astype(np.float64) / (1 << 53)


def bin_edges(df: DataFrame, features: list[str], bins: int = BINS) -> list[list[float]]:
    """Distinct upper bounds of the bins of each feature, at its quantiles."""
    at = [k / bins for k in range(1, bins + 1)]
    row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), at, 10_000).alias(f"q{j}") for j, c in enumerate(features)]).first()
    return [sorted(set(row[f"q{j}"] or [0.0])) for j in range(len(features))]


def binned(packed: DataFrame, edges: list[list[float]]) -> DataFrame:
    """The packed rows with bins for values and margins of 0."""
    p = len(edges)

    def run(batches):
        for batch in batches:
            cells, margins = [], []
            for n, x in zip(batch["n"].to_pylist(), batch["x"].to_pylist(), strict=True):
                x = np.frombuffer(x).reshape(n, p)
                cells.append(np.column_stack([np.minimum(np.searchsorted(e, x[:, j]), len(e) - 1) for j, e in enumerate(edges)])
                             .astype(np.uint8).tobytes())
                margins.append(bytes(8 * n))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("part", "n", "t", "e", "h")), pa.array(cells, pa.binary()),
                                              pa.array(margins, pa.binary())], names=["part", "n", "t", "e", "h", "x", "margin"])

    return cut_lineage(packed.mapInArrow(run, "part int, n int, t binary, e binary, h binary, x binary, margin binary"))


def rewritten(packed: DataFrame, trees: list[Tree], p: int) -> DataFrame:
    """The packed rows with ``trees`` added to their margins."""

    def run(batches):
        for batch in batches:
            margins = []
            for x, m in zip(batch["x"].to_pylist(), batch["margin"].to_pylist(), strict=True):
                bins = np.frombuffer(x, np.uint8).reshape(-1, p)
                margins.append((np.frombuffer(m) + sum(t.margins(bins) for t in trees)).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(margins, pa.binary())], names=batch.schema.names)

    return cut_lineage(packed.mapInArrow(run, "part int, n int, t binary, e binary, h binary, x binary, margin binary"))


class _State:
    """Margins and risk-set sums of a range in a round."""

    def __init__(self, r: Range, trees: list[Tree], p: Params):
        self.margin = r.extra + sum((t.margins(r.x) for t in trees), np.zeros(len(r.t)))
        self.held = mixed(r.h, p.seed) < p.validation
        self.sets = (~self.held, self.held)
        self.w = np.exp(self.margin)


def risk_sums(packed: DataFrame, trees: list[Tree], p: Params) -> tuple[dict, list[float]]:
    """(carries of the ranges, [loss of the training rows, their number, loss
    of the held-out rows, their number, their events])."""
    over = lambda of, schema: sorted(each_range(packed, of, schema, "uint8", "margin").collect())

    def totals(r: Range) -> list[tuple]:
        s = _State(r, trees, p)
        ends = (slice(None), slice(0, r.end[0]), slice(r.start[-1], None))
        return [(r.part, r.t[0], r.t[-1], np.array([(s.w * k)[x].sum() for k in s.sets for x in ends]).tobytes())]

    rows = over(totals, "part int, first double, last double, sums binary")
    carry, seen = {}, np.zeros(2)
    for part, first, last, sums in rows:
        carry[part] = {"s0": seen.copy(), "more": np.zeros(2), "first": first, "last": last, "a": 0.0, "b": 0.0, "a_first": 0.0, "b_first": 0.0}
        seen += np.frombuffer(sums).reshape(2, 3)[:, 0]
    later, time = np.zeros(2), None  # rows of a time that further ranges hold
    for part, first, last, sums in reversed(rows):
        whole, head, _ = np.frombuffer(sums).reshape(2, 3).T
        carry[part]["more"] = later if time == last else np.zeros(2)
        later = whole + carry[part]["more"] if first == last else head.copy()
        time = first

    def at_risk(r: Range, s: _State) -> list[np.ndarray]:
        out = []
        for k, mine in enumerate(s.sets):
            s0 = carry[r.part]["s0"][k] + np.cumsum(r.sums(s.w * mine))
            s0[-1] += carry[r.part]["more"][k]
            out.append(s0)
        return out

    def steps(r: Range) -> list[tuple]:
        s = _State(r, trees, p)
        train, held = at_risk(r, s)
        d, dh = r.sums(r.e * s.sets[0]), r.sums(r.e * s.sets[1])
        a, b = np.divide(d, train, out=np.zeros(len(d)), where=d > 0), np.divide(d, train**2, out=np.zeros(len(d)), where=d > 0)
        loss = [float((x * np.log(np.where(x > 0, y, 1))).sum() - (r.e * k * s.margin).sum()) for x, y, k in ((d, train, s.sets[0]), (dh, held, s.sets[1]))]
        return [(r.part, np.array([a.sum(), b.sum(), a[-1], b[-1], loss[0], s.sets[0].sum(), loss[1], s.held.sum(), dh.sum()]).tobytes())]

    found = [(part, np.frombuffer(v)) for part, v in over(steps, "part int, v binary")]
    total = np.zeros(5)
    a = b = 0.0
    for part, v in reversed(found):  # events of earlier times
        carry[part]["a"], carry[part]["b"] = a, b
        a, b, total = a + v[0], b + v[1], total + v[4:]
    open_a, open_b, time = 0.0, 0.0, None  # events of a time that further ranges share, in the ranges before
    for part, v in found:
        c = carry[part]
        if c["first"] == time:
            c["a_first"], c["b_first"] = open_a, open_b
        same = c["first"] == c["last"]
        open_a, open_b = v[2] + same * c["a_first"], v[3] + same * c["b_first"]
        time = c["last"]
    return carry, total.tolist()


def derivatives(r: Range, s: _State, c: dict) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of the loss by row (0 for held-out rows)."""
    mine = s.sets[0]
    s0 = c["s0"][0] + np.cumsum(r.sums(s.w * mine))
    s0[-1] += c["more"][0]
    d = r.sums(r.e * mine)
    out = []
    for power, end, first in ((1, "a", "a_first"), (2, "b", "b_first")):
        step = np.divide(d, s0**power, out=np.zeros(len(d)), where=d > 0)
        upto = c[end] + np.cumsum(step[::-1])[::-1]
        upto[0] += c[first]
        out.append(upto[r.group])
    a, b = out
    return (s.w * a - r.e) * mine, np.maximum(s.w * a - s.w**2 * b, 1e-16) * mine


def gradients(packed: DataFrame, trees: list[Tree], p: Params) -> DataFrame:
    """(id, gradient, hessian) of the loss of each row; 0 for held-out rows."""
    carry, _ = risk_sums(packed, trees, p)

    def rows(r: Range) -> list[tuple]:
        g, h = derivatives(r, _State(r, trees, p), carry[r.part])
        return list(zip(r.h.view(np.int64).tolist(), g.tolist(), h.tolist(), strict=True))

    return each_range(packed, rows, "id long, gradient double, hessian double", "uint8", "margin")


def gradients_at(df: DataFrame, time: str, event: str, id_col: str, margin: str) -> DataFrame:
    """(id, gradient, hessian) of the loss of all rows at given margins."""
    packed = by_time(df, time, event, [margin], id_col)
    none = F.expr("CAST(repeat(' ', n) AS BINARY)")  # no values: any byte a row
    return gradients(packed.select("part", "n", "t", "e", "h", none.alias("x"), F.col("x").alias("margin")), [], Params(validation=0.0))


def best_splits(hist: np.ndarray, p: Params, columns: list[int]) -> list[tuple]:
    """Per node (gain, feature, bin, G, H) of its best split; gain -1 if none.
    ``hist``: nodes x features x bins x 2."""
    soft = lambda g: np.sign(g) * np.maximum(np.abs(g) - p.l1, 0.0)
    score = lambda g, h: soft(g) ** 2 / (h + p.l2)
    out = []
    for node in hist:
        total = node[columns[0]].sum(axis=0)
        best = (-1.0, 0, _ALL)
        left = np.cumsum(node[columns], axis=1)
        right = total - left
        allowed = (left[..., 1] >= p.min_hessian) & (right[..., 1] >= p.min_hessian)
        gain = np.where(allowed, score(left[..., 0], left[..., 1]) + score(right[..., 0], right[..., 1]) - score(*total), -1.0)
        k = int(np.argmax(np.round(gain, 12)))
        j, cut = divmod(k, gain.shape[1])
        if gain[j, cut] > max(p.min_gain, 1e-9):
            best = (float(gain[j, cut]), columns[j], cut)
        out.append((*best, *total))
    return out


def leaf_value(g: float, h: float, p: Params) -> float:
    return -math.copysign(max(abs(g) - p.l1, 0.0), g) / (h + p.l2) * p.learning_rate if h > 0 else 0.0


def grow(packed: DataFrame, trees: list[Tree], carry: dict, p: Params, features: int, bins: int, number: int) -> Tree:
    """The tree of round ``number`` on top of ``trees``."""
    tree = Tree.empty(p.max_depth)
    draws = mixed(np.arange(1, features + 1, dtype=_U), p.seed + 7919 * (number + 1))
    columns = sorted(np.argsort(draws, kind="stable")[:max(1, math.ceil(p.column_sample * features - 1e-9))].tolist())
    live = {0: 0}  # node: its place in the histogram
    for level in range(p.max_depth):
        size = len(live) * features * bins * 2
        slot = np.full((1 << (level + 1)) - 1, -1)
        slot[list(live)] = list(live.values())

        def add(r: Range, level=level, slot=slot, size=size) -> np.ndarray:
            s = _State(r, trees, p)
            g, h = derivatives(r, s, carry[r.part])
            use = (mixed(r.h, p.seed + 104729 * (number + 1)) < p.row_sample) & s.sets[0]
            at = slot[tree.place(r.x, level)]
            use &= at >= 0
            at, x, g, h = at[use], r.x[use], g[use], h[use]
            out = np.zeros(size).reshape(-1, features, bins, 2)
            n = out.shape[0]
            for j in columns:
                cell = at * bins + x[:, j]
                out[:, j, :, 0] = np.bincount(cell, weights=g, minlength=n * bins).reshape(n, bins)
                out[:, j, :, 1] = np.bincount(cell, weights=h, minlength=n * bins).reshape(n, bins)
            return out.ravel()

        hist = vector_sum(packed, size, add, len(carry), "uint8", "margin").reshape(-1, features, bins, 2)
        after, leaves = {}, 1 << (p.max_depth - level)
        for node, (gain, feature, cut, g, h) in zip(live, best_splits(hist, p, columns), strict=True):
            first = (node + 1 - (1 << level)) * leaves  # leftmost leaf below the node
            if gain < 0:
                tree.leaf[first] = leaf_value(g, h, p)
                continue
            tree.feature[node], tree.bin[node], tree.gain[node] = feature, cut, gain
            left = hist[live[node], feature, :cut + 1].sum(axis=0)
            for child, (cg, ch) in ((2 * node + 1, left), (2 * node + 2, np.array([g, h]) - left)):
                after[child] = len(after)
                if level + 1 == p.max_depth:
                    tree.leaf[child + 1 - (1 << p.max_depth)] = leaf_value(cg, ch, p)
        live = after
        if not live:
            break
    return tree


def fit(df: DataFrame, features: list[str], time: str, event: str, id_col: str, p: Params | None = None) -> Model:
    """The boosted model.  The share ``validation`` of the ids (by hash) is not
    trained on; rounds end ``patience`` rounds after the lowest held-out loss,
    whose trees are kept.  Without an event among them all rounds run."""
    p = p or Params()
    edges = bin_edges(df, features)
    packed = binned(by_time(df, time, event, features, id_col), edges).persist()
    bins = max(map(len, edges))
    losses, best, since, trees = [], (math.inf, 0), [], []
    for number in range(p.rounds + 1):
        carry, (loss, n, held_loss, held_n, held_events) = risk_sums(packed, since, p)
        held = held_loss / held_n if held_events else None
        losses.append((number, loss / n if n else None, held))
        if held is None or held < best[0]:
            best = (math.inf if held is None else held, number)
        if number == p.rounds or number - best[1] >= p.patience or not n:
            break
        tree = grow(packed, since, carry, p, len(features), bins, number)
        trees.append(tree)
        since = [*since, tree]
        if len(since) == REWRITE:
            before, packed, since = packed, rewritten(packed, since, len(features)).persist(), []
            before.unpersist()
    packed.unpersist()
    return Model(features, edges, trees[:best[1]], losses)


def gain_importance(model: Model) -> dict[str, float]:
    """Mean gain of the splits on each feature that has one."""
    gains: dict[str, list[float]] = {}
    for tree in model.trees:
        for f, gain in zip(tree.feature, tree.gain, strict=True):
            if gain > 0:
                gains.setdefault(model.features[f], []).append(float(gain))
    return {f: sum(g) / len(g) for f, g in gains.items()}
