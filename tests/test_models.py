"""Model fits against plain numpy references on small fixtures."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenurelens.operators import boosting, cox, encoding, model_store, models, time_ranges
from tenurelens.operators.cohort import cohort

SF = "/root/testdata/sf0.001"


def _numpy_cox(t, e, z, beta):
    """Log partial likelihood, gradient and Hessian with Efron ties."""
    w = np.exp(z @ beta)
    ll, grad, hess = (e * (z @ beta)).sum(), e @ z, np.zeros((z.shape[1],) * 2)
    for tt in np.unique(t[e == 1]):
        risk, dead = t >= tt, (t == tt) & (e == 1)
        d = int(dead.sum())
        s0, s1, s2 = w[risk].sum(), w[risk] @ z[risk], (w[risk, None] * z[risk]).T @ z[risk]
        d0, d1, d2 = w[dead].sum(), w[dead] @ z[dead], (w[dead, None] * z[dead]).T @ z[dead]
        for l in range(d):
            f = l / d
            phi = s0 - f * d0
            a = (s1 - f * d1) / phi
            ll -= math.log(phi)
            grad = grad - a
            hess -= (s2 - f * d2) / phi - np.outer(a, a)
    return ll, grad, hess


def _rows(seed, n, times):
    rng = np.random.default_rng(seed)
    z = rng.normal(size=(n, 3))
    t = rng.integers(1, times + 1, n).astype(float) if times else rng.random(n)
    return t, (rng.random(n) < 0.5).astype(float), z


def _frame(spark, t, e, z):
    return spark.createDataFrame([(i, float(a), int(b), *map(float, c)) for i, (a, b, c) in enumerate(zip(t, e, z, strict=True))],
                                 "id long, t double, e int, x double, y double, w double").repartition(3)


# few times over many ranges, one time in all ranges, continuous times
CASES = [(500, 12, 40), (300, 2, 30), (300, 1, 20), (400, None, 64)]


@pytest.mark.parametrize("n,times,rows", CASES)
def test_cox_sums_over_ranges(spark, monkeypatch, n, times, rows):
    monkeypatch.setattr(time_ranges, "ROWS", rows)
    t, e, z = _rows(1, n, times)
    beta = np.array([0.4, -0.3, 0.2])
    packed = time_ranges.by_time(_frame(spark, t, e, z), "t", "e", ["x", "y", "w"])
    assert packed.select("part").distinct().count() > 4
    for got, want in zip(cox.likelihood(packed, beta), _numpy_cox(t, e, z, beta), strict=True):
        np.testing.assert_allclose(got, want, rtol=1e-9, atol=1e-9)


def test_many_tied_deaths():
    """Closed sums of 100,000 deaths at one time."""
    d = 100_000
    s0, d0 = 3.0 * d, 1.5 * d
    f = np.arange(d) / d
    phi = s0 - f * d0
    want = [np.log(phi).sum(), (1 / phi).sum(), (f / phi).sum(), (1 / phi**2).sum(), (f / phi**2).sum(), (f**2 / phi**2).sum()]
    got = cox.efron(np.array([s0, 5.0]), np.array([d0, 0.0]), np.array([d, 0]))
    np.testing.assert_allclose([g[0] for g in got], want, rtol=1e-12)
    assert all(g[1] == 0 for g in got)


def test_cox_matches_numpy_newton(spark):
    t, e, z = _rows(11, 200, 15)
    coefs, _, _ = cox.fit(_frame(spark, t, e, z), ["x", "y", "w"], "t", "e", penalizer=0.1)
    sd = z.std(0, ddof=1)
    s, beta = (z - z.mean(0)) / sd, np.zeros(3)
    for _ in range(30):
        _, grad, hess = _numpy_cox(t, e, s, beta)
        beta = beta + np.linalg.solve(0.1 * np.eye(3) - hess, grad - 0.1 * beta)
    got = {r.feature: r.coef for r in coefs.collect()}
    np.testing.assert_allclose([got[c] for c in ("x", "y", "w")], beta / sd, rtol=1e-6, atol=1e-9)


@pytest.mark.parametrize("rows", [20, 100])
def test_vectors_of_ranges_travel_as_arrays(spark, monkeypatch, rows):
    """A vector of 10,000 numbers comes in 3 values, not in 10,000 rows; of many
    ranges their sum only."""
    monkeypatch.setattr(time_ranges, "ROWS", rows)
    t, e, z = _rows(5, 500, 12)
    packed = time_ranges.by_time(_frame(spark, t, e, z), "t", "e", ["x", "y", "w"])
    ranges = packed.select("part").distinct().count()
    assert (ranges > time_ranges.FEW) == (rows == 20)
    seen, read = [], type(packed).toArrow
    monkeypatch.setattr(type(packed), "toArrow", lambda df: seen.append(read(df)) or seen[-1])
    got = time_ranges.vector_sum(packed, 10_000, lambda r: np.arange(10_000) * r.x[:, 0].sum(), ranges)
    np.testing.assert_allclose(got, np.arange(10_000) * z[:, 0].sum(), rtol=1e-9, atol=1e-9)
    assert sum(x.num_rows for x in seen) == (3 if rows == 20 else 3 * ranges)


def _numpy_derivatives(t, e, margin, mine):
    w, g, h = np.exp(margin), np.zeros(len(t)), np.zeros(len(t))
    times = [(tt, ((t == tt) & (e > 0) & mine).sum(), w[(t >= tt) & mine].sum()) for tt in np.unique(t[(e > 0) & mine])]
    for i in np.flatnonzero(mine):
        a, b = (sum(d / s**k for tt, d, s in times if tt <= t[i]) for k in (1, 2))
        g[i], h[i] = w[i] * a - e[i], max(w[i] * a - w[i] ** 2 * b, 1e-16)
    return g, h


@pytest.mark.parametrize("n,times,rows", CASES)
def test_boosting_derivatives_and_first_tree(spark, monkeypatch, n, times, rows):
    """Derivatives by row, losses of both sets, and the first tree against all splits."""
    monkeypatch.setattr(time_ranges, "ROWS", rows)
    t, e, z = _rows(2, n, times)
    p = boosting.Params(rounds=1, max_depth=2, min_hessian=0.5, validation=0.2, learning_rate=0.3, l1=0.05, l2=0.7)
    df, names = _frame(spark, t, e, z), ["x", "y", "w"]
    edges = boosting.bin_edges(df, names)
    packed = boosting.binned(time_ranges.by_time(df, "t", "e", names, "id"), edges)
    bins = np.column_stack([np.minimum(np.searchsorted(c, z[:, j]), len(c) - 1) for j, c in enumerate(edges)])
    mine = ~(boosting.mixed(np.arange(n, dtype=np.uint64), p.seed) < p.validation)
    tree = boosting.Tree(np.array([0, 1, 2]), np.array([30, 20, 10]), np.zeros(3), np.array([0.3, -0.5, 0.2, 0.7]))
    margin = tree.margins(bins)
    got = {r.id: (r.gradient, r.hessian) for r in boosting.gradients(packed, [tree], p).collect()}
    want = _numpy_derivatives(t, e, margin, mine)
    np.testing.assert_allclose([got[i] for i in range(n)], np.column_stack(want), atol=1e-12)
    w = np.exp(margin)
    loss = [sum(math.log(w[(t >= t[i]) & s].sum()) - margin[i] for i in np.flatnonzero((e > 0) & s)) for s in (mine, ~mine)]
    carry, total = boosting.risk_sums(packed, [tree], p)
    np.testing.assert_allclose([total[0], total[2]], loss, rtol=1e-9)

    g, h = _numpy_derivatives(t, e, np.zeros(n), mine)
    carry, _ = boosting.risk_sums(packed, [], p)
    grown = boosting.grow(packed, [], carry, p, 3, max(map(len, edges)), 0)
    soft = lambda x: math.copysign(max(abs(x) - p.l1, 0.0), x)
    value = lambda rows: soft(g[rows].sum()) ** 2 / (h[rows].sum() + p.l2)

    def check(rows, node, level):
        best, at = 1e-9, None
        for j in range(3):
            for k in range(len(edges[j])):
                left, right = rows & (bins[:, j] <= k), rows & (bins[:, j] > k)
                if min(h[left].sum(), h[right].sum()) >= p.min_hessian:
                    gain = value(left) + value(right) - value(rows)
                    if gain > best + 1e-9:
                        best, at = gain, (j, k)
        if level == p.max_depth or at is None:
            if level == p.max_depth or grown.bin[node] == 255:
                first = (node + 1 - (1 << level)) << (p.max_depth - level)
                assert math.isclose(grown.leaf[first], -soft(g[rows].sum()) / (h[rows].sum() + p.l2) * 0.3, abs_tol=1e-9)
            return
        assert math.isclose(grown.gain[node], best, rel_tol=1e-6)
        right = bins[:, grown.feature[node]] > grown.bin[node]
        check(rows & ~right, 2 * node + 1, level + 1)
        check(rows & right, 2 * node + 2, level + 1)

    check(mine.copy(), 0, 0)


def _signal(spark, n=300):
    rnd = random.Random(2)
    rows = [(i, float(rnd.randint(1, 20)), int(rnd.random() < 0.5), rnd.random(), rnd.random()) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, t double, e int, a double, b double")
    return df.withColumn("e", F.when(F.col("a") > 0.7, 1).otherwise(F.col("e")))


def test_boosting_lowers_loss_and_finds_the_driver(spark):
    p = boosting.Params(rounds=12, learning_rate=0.1, max_depth=2, min_hessian=5, row_sample=0.8, column_sample=0.5, validation=0.0)
    model = boosting.fit(_signal(spark), ["a", "b"], "t", "e", "id", p)
    losses = [x for _, x, _ in model.losses]
    assert losses[-1] < losses[0] and len(model.trees) == 12  # margins were rewritten on the way
    assert all(len({int(f) for f, g in zip(t.feature, t.gain, strict=True) if g > 0}) <= 1 for t in model.trees)  # one column a tree
    gains = boosting.gain_importance(model)
    assert gains["a"] > gains.get("b", 0)


def test_boosting_stops_on_the_validation_loss(spark):
    rnd = random.Random(3)
    rows = [(i, float(rnd.randint(1, 20)), int(rnd.random() < 0.5), rnd.random()) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, t double, e int, a double")  # noise
    model = boosting.fit(df, ["a"], "t", "e", "id", boosting.Params(rounds=15, learning_rate=0.5, patience=2, min_hessian=2))
    valid = [x for *_, x in model.losses]
    best = valid.index(min(valid))
    assert len(valid) == best + 3 < 16 and len(model.trees) == best


def test_the_default_rounds_are_those_of_the_reference():
    assert boosting.Params().rounds == 120 and boosting.Params(**boosting.BATCH).rounds == 200


@pytest.fixture(scope="module")
def store(spark):
    return model_store.fit(cohort(spark, SF), boosting.Params(rounds=11, learning_rate=0.3))


def test_stored_model_scores_two_ways(spark, store):
    c = cohort(spark, SF)
    scored, again = model_store.score(c, store).cache(), model_store.rescored(c, store)
    n = c.count()
    assert model_store.reconcile(scored, again).first() == (n, 0, 0)
    wrong = scored.withColumn("margin", F.when(F.col("emp_key") % 7 == 0, F.col("margin") + 1e-6).otherwise(F.col("margin")))
    some = scored.where("emp_key % 7 = 0").count()
    assert model_store.reconcile(wrong, again).first() == (n, some, 0)
    assert model_store.reconcile(scored.where("emp_key % 7 != 0"), again).first() == (n, some, some)
    found = scored.agg(*[F.max(f"contrib_{t}").alias(t) for t in ("identity", "environment", "compensation", "sentiment", "tenure")],
                       F.min(F.round(sum(F.col(f"contrib_{t}") for t in ("identity", "environment", "compensation", "sentiment", "tenure")), 6)).alias("all")).first()
    assert min(found) > 0 and found["all"] == 100
    scored.unpersist()


def test_stored_model_survives_unseen_levels(spark, store):
    c = cohort(spark, SF).limit(20).withColumn("job_role", F.lit("new role")).withColumn("gender", F.lit("other"))
    assert model_store.score(c, store).count() == 20
    assert model_store.score(c.withColumn("age", F.lit(None).cast("long")), store).count() == 0  # incomplete rows go
    assert model_store.score(c.limit(0), store).count() == 0


def test_fields_of_a_request_move_the_encoded_rows(spark, store):
    c = encoding.with_attributes(cohort(spark, SF))
    base = model_store.encoding.inference(c, store.encoders())
    for field, value, feature in (("years_with_curr_manager", F.lit(0), "x_years_with_curr_manager"), ("job_role", F.lit("EUROPE"), "x_job_role")):
        moved = encoding.inference(c.drop("project").withColumn(field, value), store.encoders())
        pairs = base.select("emp_key", F.col(feature).alias("a")).join(moved.select("emp_key", F.col(feature).alias("b")), "emp_key")
        assert pairs.where("a != b").count() > 0


def test_driver_ranking_and_classes_of_a_fixed_table(spark):
    rows = [("monthly_income", 3.0), ("age", 5.0), ("x1", 1.0), ("x2", 0.5), ("x3", 0.4), ("x4", 0.3)]
    got = {r.feature: r for r in models.driver_ranking(spark.createDataFrame(rows, "feature string, importance double")).collect()}
    assert got["monthly_income"].rank == 2 and got["age"].pay_in_top3 and got["age"].first_pay_rank == 2
    assert [f for f, r in got.items() if not r.bottom5] == ["age"] and all(r.top10 for r in got.values())
    coefs = spark.createDataFrame([("a", 0.5, math.exp(0.5), 0.01), ("b", -0.5, math.exp(-0.5), 0.01), ("c", 0.5, math.exp(0.5), 0.2)],
                                  "feature string, coef double, exp_coef double, p_value double")
    found = {r.feature: (r["class"], round(r.risk_change_pct, 4)) for r in models.coefficient_classes(coefs).collect()}
    assert found == {"a": ("killer", 64.8721), "b": ("shield", -39.3469), "c": ("noise", 64.8721)}


def test_scoring_leaves_no_tree_walk_in_the_plan(spark):
    """120 trees on 20,000 rows: walked by batches, not row by row in the plan
    (1.6 ms a row); a missing value on the way leaves no margin, one that is not
    a number goes right."""
    from tenurelens.operators import model_store
    features = ["a", "b"]
    rows = [(i, [feature, 1, 1], [0.5, 0.5, float("inf")], [1.0, 2.0, 4.0, 8.0]) for i, feature in enumerate([0] * 60 + [1] * 60)]
    trees = spark.createDataFrame(rows, "tree int, feature array<int>, threshold array<double>, leaf array<double>")

    class Stored:
        def table(self, name):
            return trees

    x = spark.createDataFrame([(0, 0.1, 0.1), (1, 0.9, 0.9), (2, None, 0.9), (3, 0.1, float("nan")), (4, 0.1, None)], "k int, x_a double, x_b double")
    scored = model_store.margins(x, Stored(), features)
    assert {r.k: r.margin for r in scored.collect()} == {0: 120.0, 1: 480.0, 2: None, 3: 60 * 2.0 + 60 * 8.0, 4: None}
    assert "lambdafunction" not in scored._jdf.queryExecution().toString()
