"""Cox proportional hazards by Newton steps over ranges of time.

Ties are handled after Efron: a time with d deaths contributes with
phi_l = S0 - (l/d) D0 for l < d, where S are sums of w = exp(z b) over the rows
at risk and D over the deaths.  Its part of gradient and Hessian needs five
sums over l (``efron``), so that a time with any number of deaths costs a few
numbers; the second moments of the rows at risk are never kept per time, for

    sum over times of a0(t) * sum over rows at risk of w z z'
      = sum over rows of w z z' * (sum of a0 over times up to the row's own).

Three passes over the ranges give log-likelihood, gradient and Hessian: sums of
each range, the a0 of its times, and the parts themselves.  A time that lies in
several ranges is counted by the last of them.
"""
from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .time_ranges import Range, by_time, each_range, vector_sum

_STEP = 1 << 20  # ties added at once


def efron(s0: np.ndarray, d0: np.ndarray, deaths: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per time the sums over l < d of log(phi), 1/phi, (l/d)/phi, 1/phi^2,
    (l/d)/phi^2 and (l/d)^2/phi^2."""
    out = np.zeros((6, len(s0)))
    used = np.flatnonzero(deaths > 0)
    for at in range(0, len(used), _STEP):
        few = used[at:at + _STEP]
        few = few[deaths[few] <= 64]
        for l in range(int(deaths[few].max()) if len(few) else 0):
            i = few[deaths[few] > l]
            f = l / deaths[i]
            phi = s0[i] - f * d0[i]
            out[:, i] += np.log(phi), 1 / phi, f / phi, 1 / phi**2, f / phi**2, f**2 / phi**2
    for i in used[deaths[used] > 64]:
        d = int(deaths[i])
        for at in range(0, d, _STEP):
            f = np.arange(at, min(d, at + _STEP)) / d
            phi = s0[i] - f * d0[i]
            out[:, i] += [x.sum() for x in (np.log(phi), 1 / phi, f / phi, 1 / phi**2, f / phi**2, f**2 / phi**2)]
    return tuple(out)


class _Carry:
    """What reaches a range from the ranges of later times."""

    def __init__(self, p: int):
        self.s0, self.s1 = 0.0, np.zeros(p)
        self.time, self.deaths, self.d0, self.d1 = None, 0.0, 0.0, np.zeros(p)  # of a time that goes on
        self.goes_on = False  # the last time of this range goes on in the next
        self.a0_after, self.a1_open = 0.0, 0.0


class _Times:
    """The times of a range that end in it, with their sums."""

    def __init__(self, r: Range, beta: np.ndarray, carry: _Carry):
        z, e = r.x, r.e
        self.w = np.exp(z @ beta)
        wz = self.w[:, None] * z
        self.s0 = carry.s0 + np.cumsum(r.sums(self.w))
        self.s1 = carry.s1 + np.cumsum(r.sums(wz), axis=0)
        self.deaths, self.d0, self.d1 = r.sums(e), r.sums(e * self.w), r.sums(e[:, None] * wz)
        if carry.time == r.t[0]:
            self.deaths[0] += carry.deaths
            self.d0[0] += carry.d0
            self.d1[0] += carry.d1
        if carry.goes_on:  # counted by a later range
            self.deaths[-1] = 0
        self.log, self.a0, self.a1, self.b0, self.b1, self.b2 = efron(self.s0, self.d0, self.deaths)


def carried(packed: DataFrame, beta: np.ndarray) -> dict[int, _Carry]:
    """The carries of all ranges, from two passes over them."""
    p = len(beta)

    def totals(r: Range) -> list[tuple]:
        w = np.exp(r.x @ beta)
        ew = r.e * w
        ends = [(r.e[s].sum(), ew[s].sum(), *(ew[s] @ r.x[s])) for s in (slice(0, r.end[0]), slice(r.start[-1], None))]
        return [(r.part, r.t[0], r.t[-1], np.array([w.sum(), *(w @ r.x), *ends[0], *ends[1]]).tobytes())]

    rows = sorted(each_range(packed, totals, "part int, first double, last double, sums binary").collect())
    carries, s0, s1, gone = {}, 0.0, np.zeros(p), _Carry(p)
    for k, (part, first, last, sums) in enumerate(rows):
        v = np.frombuffer(sums)
        c = carries[part] = _Carry(p)
        c.s0, c.s1 = s0, s1
        if gone.time == first:
            c.time, c.deaths, c.d0, c.d1 = gone.time, gone.deaths, gone.d0, gone.d1
        c.goes_on = k + 1 < len(rows) and rows[k + 1].first == last
        s0, s1, end = s0 + v[0], s1 + v[1:p + 1], v[p + 3 + p:]
        gone = _Carry(p)
        gone.time, gone.deaths, gone.d0, gone.d1 = last, end[0], end[1], end[2:]
        if first == last and c.time == first:  # the range lies in one time that began before it
            gone.deaths, gone.d0, gone.d1 = c.deaths + end[0], c.d0 + end[1], c.d1 + end[2:]

    def steps(r: Range) -> list[tuple]:
        x = _Times(r, beta, carries[r.part])
        return [(r.part, x.a0.sum(), x.a1[0])]

    one_time = {row.part for row in rows if row.first == row.last}
    after, a1 = 0.0, 0.0  # a1 of the time that the range just passed begins with
    for part, a0, first_a1 in sorted(each_range(packed, steps, "part int, a0 double, a1 double").collect(), reverse=True):
        c = carries[part]
        c.a0_after, c.a1_open = after, a1 if c.goes_on else 0.0
        after += a0
        if not (c.goes_on and part in one_time):
            a1 = first_a1
    return carries


def likelihood(packed: DataFrame, beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log partial likelihood (Efron), gradient and Hessian at ``beta``."""
    p = len(beta)
    carries = carried(packed, beta)

    def parts(r: Range) -> np.ndarray:
        c = carries[r.part]
        x = _Times(r, beta, c)
        z = r.x
        ll = r.e @ (z @ beta) - x.log.sum()
        grad = r.e @ z - (x.a0 @ x.s1 - x.a1 @ x.d1)
        upto = c.a0_after + np.cumsum(x.a0[::-1])[::-1]  # a0 of all times up to each
        a1 = x.a1.copy()
        if c.goes_on:
            a1[-1] = c.a1_open
        weight = x.w * (upto[r.group] - r.e * a1[r.group])
        cross = (x.b1[:, None] * x.s1).T @ x.d1
        hess = -((weight[:, None] * z).T @ z - (x.b0[:, None] * x.s1).T @ x.s1 + cross + cross.T - (x.b2[:, None] * x.d1).T @ x.d1)
        return np.concatenate(([ll], grad, hess.ravel()))

    v = vector_sum(packed, 1 + p + p * p, parts, len(carries))
    return float(v[0]), v[1:p + 1], v[p + 1:].reshape(p, p)


def standardised(df: DataFrame, features: list[str]) -> tuple[list, np.ndarray]:
    """Standardised columns and their deviations, from one aggregation."""
    one = F.col
    aggs = [f for c in features for f in (F.avg(one(c).cast("double")).alias(f"m_{c}"), F.stddev_samp(one(c).cast("double")).alias(f"s_{c}"))]
    row = df.agg(*aggs).first()
    std = [row[f"s_{c}"] or 1.0 for c in features]
    return [((one(c).cast("double") - F.lit(float(row[f"m_{c}"] or 0.0))) / F.lit(float(s))).alias(c)
            for c, s in zip(features, std, strict=True)], np.array(std)


def fit(df: DataFrame, features: list[str], time: str, event: str, penalizer: float = 0.1, max_iter: int = 25,
        tol: float = 1e-9) -> tuple[DataFrame, int, float]:
    """(coefficients, iterations, penalised log-likelihood) of the ridge fit on
    standardised features; coefficients are per unit of the given features."""
    columns, std = standardised(df, features)
    packed = by_time(df.select(F.col(time).alias("_time"), F.col(event).alias("_event"), *columns), "_time", "_event", features).persist()
    p = len(features)
    beta, step, it, before = np.zeros(p), np.zeros(p), 0, None
    while True:
        ll, grad, hess = likelihood(packed, beta)
        ll -= 0.5 * penalizer * beta @ beta
        if before is not None and ll < before - 1e-9 * abs(before) and it < max_iter:  # overshoot: half the step
            it, step = it + 1, step / 2
            beta = beta - step
            continue
        grad, hess = grad - penalizer * beta, hess - penalizer * np.eye(p)
        if it >= max_iter or (it and np.max(np.abs(step)) < tol):
            break
        before, it, step = ll, it + 1, np.linalg.solve(-hess, grad)
        beta = beta + step
    packed.unpersist()
    se = np.sqrt(np.diag(np.linalg.inv(-hess)))
    rows = []
    for j, c in enumerate(features):
        coef, z = beta[j] / std[j], beta[j] / se[j] if se[j] > 0 else math.nan
        rows.append((c, float(coef), float(math.exp(min(coef, 700.0))), float(se[j] / std[j]), float(z),
                     float(math.erfc(abs(z) / math.sqrt(2.0)))))
    schema = "feature string, coef double, exp_coef double, se double, z double, p_value double"
    return df.sparkSession.createDataFrame(rows, schema), it, float(ll)
