"""Hand-computed fixtures (FIXTURES.md §3) and brute-force cross-checks."""
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from tenurelens.operators import concordance as conc
from tenurelens.operators import features as feat
from tenurelens.operators import graph, quality, scd2
from tenurelens.operators.quantiles import grouped_quantiles
from tenurelens.operators.ranking import group_rank, hex_sub_bucket
from tenurelens.operators.survival import nelson_aalen, tie_smoothed_increment


def test_tied_deaths_nelson_aalen(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 1), (3, 0)], "t int, e int")
    rows = {r.t: r for r in nelson_aalen(df, "t", "e").collect()}
    h1 = 1 / 5 + 1 / 4
    assert rows[0.0].cum_hazard == 0.0
    assert math.isclose(rows[1.0].cum_hazard, h1, rel_tol=1e-12)
    assert math.isclose(rows[2.0].cum_hazard, h1, rel_tol=1e-12)
    assert math.isclose(rows[3.0].cum_hazard, h1 + 1 / 2, rel_tol=1e-12)
    assert math.isclose(rows[3.0].s0, math.exp(-(h1 + 0.5)), rel_tol=1e-12)


def test_tie_increment_large_counts_use_harmonic_difference(spark):
    df = spark.createDataFrame([(10_000_000, 9_000), (5_000, 4_999)], "n long, d long")
    got = [r.h for r in df.select(tie_smoothed_increment(F.col("n"), F.col("d")).alias("h")).collect()]
    exact0 = math.fsum(1.0 / (10_000_000 - i) for i in range(9_000))
    exact1 = math.fsum(1.0 / (5_000 - i) for i in range(4_999))
    assert math.isclose(got[0], exact0, rel_tol=1e-10)
    assert math.isclose(got[1], exact1, rel_tol=1e-10)


def _brute_concordance(rows):
    num = den = 0.0
    for (ti, ei, si), (tj, ej, sj) in itertools.permutations(rows, 2):
        if ei == 1 and (ti < tj or (ti == tj and ej == 0)):
            den += 1
            num += 1.0 if si > sj else (0.5 if si == sj else 0.0)
    return num / den, den


def test_concordance_fixture(spark):
    rows = [(1, 1, 3.0), (2, 0, 2.0), (2, 1, 2.0), (3, 0, 1.0)]
    df = spark.createDataFrame(rows, "t int, e int, s double")
    r = conc.concordance(df, "t", "e", "s").first()
    assert r.comparable_pairs == 5
    assert math.isclose(r.c_index, 4.5 / 5)


@pytest.mark.parametrize("cells,kind", [(9, "months"), (40, "months"), (10_000, "months"), (25, "continuous"), (20, "hot score"), (20, "hot time")])
def test_concordance_ranges_match_brute_force(spark, cells, kind):
    rnd = random.Random(5)
    rows = []
    for _ in range(300):
        t, s = (rnd.random(), rnd.random()) if kind != "months" else (float(rnd.randint(1, 12)), float(rnd.randint(0, 30)))
        if kind.startswith("hot") and rnd.random() < 0.6:
            t, s = (t, 0.5) if kind == "hot score" else (0.5, s)
        rows.append((t, rnd.randint(0, 1), s))
    df = spark.createDataFrame(rows, "t double, e int, s double").repartition(4)
    want, den = _brute_concordance(rows)
    r = conc.concordance(df, "t", "e", "s", cells_per_range=cells).first()
    assert r.comparable_pairs == den
    assert math.isclose(r.c_index, want, rel_tol=1e-12)


def test_global_quantiles_match_numpy(spark, monkeypatch):
    import numpy as np

    from tenurelens.operators import quantiles
    rnd = random.Random(3)
    for rows, size in ((50, 4000), (3, 4000), (100_000, 500), (5, 1), (5, 0)):
        monkeypatch.setattr(quantiles, "BRACKET_ROWS", rows)
        values = [0.25 if rnd.random() < 0.4 else rnd.choice([rnd.random(), rnd.gauss(0, 9)]) for _ in range(size)]
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(3)
        got, sums = quantiles.global_quantiles(df, "v", [0.0, 0.1, 0.5, 0.9, 1.0])
        assert sums["n"] == size
        want = np.quantile(values, [0.0, 0.1, 0.5, 0.9, 1.0]) if size else [None] * 5
        assert all(g == w or math.isclose(g, w, rel_tol=1e-12) for g, w in zip(got, want, strict=True))


def test_concordance_without_pairs(spark):
    none = spark.createDataFrame([], "t double, e int, s double")
    censored = spark.createDataFrame([(1.0, 0, 2.0), (2.0, 0, 1.0)], "t double, e int, s double")
    for df in (none, censored):
        r = conc.concordance(df, "t", "e", "s").first()
        assert r.c_index is None and r.comparable_pairs == 0


def test_leave_one_out(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), ("a", 1), ("b", 1)], "c string, y int")
    tr = feat.loo_encode_train(df, "c", "y", "enc").orderBy("c", "y").collect()
    assert [round(r.enc, 12) for r in tr] == [1.0, 0.5, 0.5, 0.75]
    test = spark.createDataFrame([("a",), ("b",), ("c",)], "c string").withColumn("y", F.lit(None).cast("int"))
    inf = {r.c: r.enc for r in feat.loo_encode_infer(test, df, "c", "y", "enc").collect()}
    assert math.isclose(inf["a"], 2 / 3) and inf["b"] == 0.75 and inf["c"] == 0.75


def test_minmax_constant_rules(spark):
    df = spark.createDataFrame([("d", 5.0), ("d", 5.0)], "g string, x double")
    st = feat.minmax_fit(df, ["x"])
    assert {r.x for r in feat.minmax_apply(df, st, ["x"]).collect()} == {0.0}
    assert {r.n for r in feat.group_normalise(df, "x", "g", "n").collect()} == {0.5}


def test_stratified_split_exact_counts(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("id"), (F.col("id") % 5 == 0).cast("int")
                                  .alias("e"))
    s = feat.stratified_split(df, "id", "e", 0.2, 42)
    counts = {(r.e, r.split): r["count"] for r in s.groupBy("e", "split").count().collect()}
    assert counts[(0, "test")] == 160 and counts[(0, "train")] == 640
    assert counts[(1, "test")] == 40 and counts[(1, "train")] == 160


def test_scd2_fixture(spark):
    cols = "emp_key long, v string"
    day1 = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], cols)
    day2 = spark.createDataFrame([(1, "a"), (2, "B"), (4, "d")], cols)
    ch = {r.emp_key: r.change_type for r in scd2.classify(day1, day2, ("v",)).collect()}
    assert ch == {1: "same", 2: "update", 3: "delete", 4: "insert"}
    h = scd2.apply_snapshot(scd2.initial_history(day1, "2000-01-01"), day2, "2000-01-02", ("v",))
    active = h.where("is_active").groupBy("emp_key").count().collect()
    assert sorted(r.emp_key for r in active) == [1, 2, 4] and all(r["count"] == 1 for r in active)
    built = scd2.build_history([("2000-01-01", day1), ("2000-01-02", day2)], ("v",))
    assert sorted((r.emp_key, r.v, r.is_active) for r in built.collect()) == sorted(
        (r.emp_key, r.v, r.is_active) for r in h.collect())


def test_exposure_fixture(spark):
    nodes = spark.createDataFrame([("A", True, ""), ("B", False, "2000-07-22")], "id string, is_active boolean, "
                                  "exit_date string").withColumn("job_role", F.lit("r"))
    edges = spark.createDataFrame([("A", "B", 1.0, "inferred", "SAME_MANAGER"), ("B", "A", 1.0, "inferred",
                                   "SAME_MANAGER")], "src string, dst string, weight double, source string, "
                                  "type string")
    c = graph.exposure_contributions(edges, nodes, "2000-08-01")
    x = {r.node: r.exposure_score for r in graph.exposure_scores(c).collect()}
    assert math.isclose(x["A"], 2 * math.exp(-1.0))


def test_pay_cut_penalty(spark):
    from tenurelens.operators.whatif import pay_cut_multiplier
    df = spark.createDataFrame([(100.0, 65.0, 0.2)], "old double, new double, p double")
    r = df.select((F.col("p") * pay_cut_multiplier(F.col("old"), F.col("new"))).alias("x")).first()
    assert math.isclose(r.x, 0.41)


def test_group_rank_matches_plain_window(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("ab"), f"id{i}") for i in range(500)]
    df = spark.createDataFrame(rows, "g string, id string").withColumn("h", F.md5("id"))
    got = {r.id: r["rank"] for r in group_rank(df, ["g"], "h", "id", hex_sub_bucket(F.col("h"))).collect()}
    import hashlib
    for g in "ab":
        ids = sorted((hashlib.md5(i.encode()).hexdigest(), i) for gg, i in rows if gg == g)
        for k, (_, i) in enumerate(ids, 1):
            assert got[i] == k


def test_grouped_quantiles_with_hot_value(spark):
    import numpy as np
    vals = [7.0] * 400 + [float(i) for i in range(600)]
    df = spark.createDataFrame([("g", v) for v in vals], "k string, x double")
    q = grouped_quantiles(df, ["k"], "x", [0.1, 0.5, 0.9], n_splits=8).first()
    for p, name in ((0.1, "p10"), (0.5, "p50"), (0.9, "p90")):
        assert math.isclose(q[name], float(np.quantile(vals, p)), rel_tol=1e-12)


def test_dq_report_strict_raises(spark):
    df = spark.createDataFrame([(1, 5, 3)], "id int, a int, b int")
    rep = {r.rule: r.violations for r in quality.dq_report(df, ["id"], [("a", "b")], {}).collect()}
    assert rep["order:a<=b"] == 1
    with pytest.raises(quality.DataQualityError):
        quality.dq_report(df, ["id"], [("a", "b")], {}, strict=True)


def test_rows_at_ranks_with_hot_value(spark):
    import hashlib

    from tenurelens.operators.quantiles import rows_at_ranks
    vals = [(f"id{i}", 3.0 if i % 3 == 0 else float(i)) for i in range(900)]
    df = spark.createDataFrame(vals, "id string, v double").withColumn("h", F.md5("id"))
    ranks = [0, 100, 250, 450, 899]
    got = {r.r: r.id for r in rows_at_ranks(df, "v", "h", ranks, n_splits=8).collect()}
    order = sorted(vals, key=lambda x: (x[1], hashlib.md5(x[0].encode()).hexdigest()))
    assert got == {k: order[k][0] for k in ranks}


def _dealt_to_the_end(sizes, key):
    """Groups of all places, drawn from both ends until none is left."""
    import hashlib
    left, places, low, high = list(sizes), [None] * sum(sizes), 0, sum(sizes) - 1
    for draw in range(sum(sizes)):
        bag = [g for g, n in enumerate(left) for _ in range(n)]
        g = bag[int(hashlib.md5(f"{key}|{draw}".encode()).hexdigest()[:8], 16) * len(bag) >> 32]
        left[g] -= 1
        places[high if draw % 2 else low] = g
        low, high = (low, high - 1) if draw % 2 else (low + 1, high)
    return places


def test_permutation_test_matches_python(spark):
    """Ends found early equal those of the whole dealing; places are uniform."""
    import datetime

    from tenurelens.operators.rates import dealt_ends, permutation_test
    rnd = random.Random(9)
    exits = [(rnd.choice("AABC"), f"2000-0{rnd.randint(1, 9)}-1{rnd.randint(0, 9)}") for _ in range(40)] + [("D", "2000-05-05")]
    r = permutation_test(spark.createDataFrame(exits, "g string, d string"), "g", "d", n_perm=25, seed=7).first()
    dates = sorted(datetime.date.fromisoformat(d) for _, d in exits)
    names = sorted({g for g, _ in exits})
    sizes = [sum(g == x for g, _ in exits) for x in names]

    def pooled(groups):
        return sum((max(v) - min(v)).days for v in groups) / (len(exits) - len(names))
    observed = pooled([[datetime.date.fromisoformat(d) for g, d in exits if g == x] for x in names])
    stats = []
    for p in range(25):
        places = _dealt_to_the_end(sizes, f"7|{p}")
        stats.append(pooled([[dates[i] for i, g in enumerate(places) if g == x] for x in range(len(names))]))
    assert math.isclose(r.observed, observed) and math.isclose(r.expected, sum(stats) / 25)
    assert math.isclose(r.p_value, sum(x <= observed for x in stats) / 25)
    first = [dealt_ends([3, 2], 5, f"k{i}")[1] for i in range(4000)]  # 10 pairs of places, all as likely
    seen = {pair: first.count(pair) for pair in set(first)}
    assert len(seen) == 10 and all(330 < n < 470 for n in seen.values())


def test_shuffle_test_deals_every_exit(spark):
    """The whole shuffle against plain Python, with windows that miss, an exit
    without a date, one without a group and one without an id."""
    import datetime
    import hashlib

    from tenurelens.operators.rates import shuffle_test
    rnd = random.Random(9)
    exits = [(rnd.choice("AABC"), f"2000-0{rnd.randint(1, 9)}-1{rnd.randint(0, 9)}", f"e{i}") for i in range(60)]
    exits += [("A", None, "e60"), (None, "2001-01-01", "e61"), (None, "2001-01-05", "e62"), ("B", "1999-01-01", None)]
    day = lambda d: None if d is None else datetime.date.fromisoformat(d)
    slots = sorted((g for g, _, _ in exits), key=lambda g: (g is None, g))

    def pooled(dealt):
        groups = {}
        for g, d in dealt:
            groups.setdefault(g, []).extend([] if d is None else [day(d)])
        return sum((max(v) - min(v)).days for v in groups.values() if v) / (len(exits) - len(groups))

    def order(p):
        return lambda x: (x[2] is None, hashlib.md5(f"7|{p}|{x[2]}".encode()).hexdigest())

    observed = pooled([(g, d) for g, d, _ in exits])
    stats = [pooled([(g, x[1]) for g, x in zip(slots, sorted(exits, key=order(p)), strict=True)]) for p in range(25)]
    df = spark.createDataFrame(exits, "g string, d string, id string")
    for width in (0.01, 4.5):
        r = shuffle_test(df, "g", "d", "id", n_perm=25, seed=7, width=width).first()
        assert math.isclose(r.observed, observed) and math.isclose(r.expected, sum(stats) / 25)
        assert math.isclose(r.p_value, sum(x <= observed for x in stats) / 25)


def _py_dist(x, y):
    m = 0.0 if (x[2] == y[2] and x[2] != "") else 1.0
    dep = 0.0 if x[1] == y[1] else 1.0
    p = 0.0 if x[3] == y[3] else 1.0
    g = 0.0 if x[4] == y[4] else 1.0
    if x[5] is not None and y[5] is not None:
        cat = 0.5 * g + 0.5 * (0.0 if x[5] == y[5] else 1.0)
    else:
        cat = g
    return 0.6 * (m / 3 + dep / 3 + p / 3) + 0.2 * cat + 0.2 * (0.5 * abs(x[6] - y[6]) + 0.5 * abs(x[7] - y[7]))


def test_knn_matches_brute_force_with_ties_and_hot_groups(spark):
    from tenurelens.operators.knn import knn
    rnd = random.Random(21)
    rows = []
    for i in range(260):
        dept = "D1" if i < 200 else "D2"
        mgr = "M0" if i % 3 == 0 else f"M{rnd.randint(1, 12)}"        # one hot manager
        tier = rnd.choice(["High", "Low", None])
        an = 0.5 if i % 7 == 0 else rnd.randint(0, 20) / 20           # repeated coordinates
        rows.append((f"e{i:03d}", dept, mgr, f"P{rnd.randint(0, 3)}", rnd.choice("FM"), tier, an, rnd.random()))
    schema = ("id string, department string, manager_id string, project string, gender string, tier string, "
              "age_norm double, risk_norm double")
    got = {(r.a, r.rank): r.b for r in knn(spark.createDataFrame(rows, schema)).collect()}
    want = {}
    for x in rows:
        peers = [y for y in rows if y[1] == x[1] and y[0] != x[0]]
        k = max(3, min(20, math.ceil(0.1 * (len(peers) + 1))))
        ranked = sorted(peers, key=lambda y: (_py_dist(x, y), y[0]))[:k]
        for rk, y in enumerate(ranked, 1):
            want[(x[0], rk)] = y[0]
    assert got == want


def test_knn_of_many_alike_and_of_many_blocks(spark, monkeypatch):
    """Small blocks: a group alike in everything stays linear, sparse members
    are found at any distance."""
    from tenurelens.operators import knn as K
    monkeypatch.setattr(K, "BLOCK", 32)
    rnd = random.Random(5)
    rows = [(f"a{i:04d}", "D", f"M{rnd.randint(0, 40)}", "P0", "F", "High", 0.5, 0.5) for i in range(700)]
    rows += [(f"b{i:04d}", "D", rnd.choice(["M0", "M1", ""]), f"P{rnd.randint(0, 2)}", rnd.choice(["F", "M"]),
              rnd.choice(["High", "Low", None]), rnd.random(), rnd.random()) for i in range(300)]
    schema = ("id string, department string, manager_id string, project string, gender string, tier string, "
              "age_norm double, risk_norm double")
    stats = []
    got = {(r.a, r.rank): r.b for r in K.knn(spark.createDataFrame(rows, schema).repartition(3), stats).collect()}
    want = {}
    for x in rows:
        near = sorted((y for y in rows if y[0] != x[0]), key=lambda y: (_py_dist(x, y), y[0]))[:20]
        want.update({(x[0], rk): y[0] for rk, y in enumerate(near, 1)})
    assert got == want
    assert sum(stats) < 0.5 * len(rows) ** 2


def test_stratified_split_membership_matches_sort(spark):
    import hashlib
    ids = [f"c{i}" for i in range(3000)]
    df = spark.createDataFrame([(i, int(i[1:]) % 4 == 0) for i in ids], "id string, e boolean") \
        .withColumn("e", F.col("e").cast("int"))
    got = {r.id: r.split for r in feat.stratified_split(df, "id", "e", 0.2, 42).collect()}
    want = {}
    for e in (0, 1):
        members = [i for i in ids if (int(i[1:]) % 4 == 0) == bool(e)]
        members.sort(key=lambda i: (int(hashlib.md5(f"42|{i}".encode()).hexdigest(), 16) % (1 << 30), i))
        n_train = len(members) - math.ceil(len(members) * 0.2)
        for k, i in enumerate(members):
            want[i] = "train" if k < n_train else "test"
    assert got == want


def test_knn_under_one_manager_compares_few_blocks(spark):
    """Members of one large manager: most pairs of their blocks are never
    compared (all were, at every size), and the neighbours stay exact."""
    from tenurelens.operators.knn import knn
    rnd = random.Random(4)
    rows = [(f"m{i:04d}", "D", "boss", f"P{i % 3}", "FM"[i % 2], None, rnd.random(), rnd.random()) for i in range(2400)]
    rows += [(f"s{i:04d}", "D", f"b{i // 3}", "P0", "F", None, rnd.random(), rnd.random()) for i in range(90)]
    stats: list = []
    df = spark.createDataFrame(rows, "id string, department string, manager_id string, project string, gender string, tier string, "
                                     "age_norm double, risk_norm double")
    got = {(r.a, r["rank"]): (r.b, r.distance) for r in knn(df, stats).collect()}
    assert stats[1] < 2400 * 2400 / 2
    assert len(got) == len(rows) * 20
    for x in rows[:2400:300] + rows[2400::13]:
        near = sorted((0.6 * ((0.0 if x[2] == y[2] else 1.0) / 3.0 + 0.0 / 3.0 + (0.0 if x[3] == y[3] else 1.0) / 3.0)
                       + 0.2 * (0.0 if x[4] == y[4] else 1.0) + 0.2 * (0.5 * abs(x[6] - y[6]) + 0.5 * abs(x[7] - y[7])), y[0])
                      for y in rows if y[0] != x[0])[:20]
        assert [got[x[0], k + 1][0] for k in range(20)] == [b for _, b in near]
